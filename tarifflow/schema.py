"""Tables of the model and the values that their columns accept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
FILE_FORMATS = ("pdf", "scan_pdf", "docx", "xlsx")
PARSE_STATUSES = ("pending", "processing", "done", "error", "needs_review")
CURRENCIES = ("KZT", "USD", "RUB")
MATCH_STATUSES = ("auto", "needs_review", "unmatched")
MATCH_METHODS = ("code", "exact", "fuzzy_semantic", "none")
DEFAULT_CURRENCY = "KZT"


PARTNER = "name string, city string, address string, bin string, contact_email string, contact_phone string, is_active boolean, partner_id string, created_at timestamp, updated_at timestamp"
DOCUMENT = "partner_id string, file_name string, file_format string, effective_date date, parse_status string, parse_log string, raw_content string, doc_id string, parsed_at timestamp"
ITEM = (
    "doc_id string, partner_id string, service_name_raw string, service_code_source string, price_resident_kzt decimal(14,2), price_nonresident_kzt decimal(14,2), "
    "price_original decimal(14,2), currency_original string, is_verified boolean, verification_note string, effective_date date, is_active boolean, source_row int, "
    "source_sheet string, item_id string, service_id string, match_confidence double, match_status string, match_method string"
)
SERVICE = "service_id string, service_name string, category string, code string, tarificator_code string, synonyms array<string>"
#: Tables of the relational store, their key first.
STORED = {
    "service": "service_id string, service_name string, synonyms array<string>, category string, icd_code string, is_active boolean",
    "partner": "partner_id string, name string, city string, address string, bin string, contact_email string, contact_phone string, is_active boolean, created_at timestamp, updated_at timestamp",
    "price_document": "doc_id string, partner_id string, file_name string, file_format string, effective_date date, parsed_at timestamp, parse_status string, parse_log string, raw_content string, file_path string, created_at timestamp",
    "price_item": "item_id string, doc_id string, partner_id string, service_name_raw string, service_code_source string, service_id string, price_resident_kzt decimal(14,2), price_nonresident_kzt decimal(14,2), "
    "price_original decimal(14,2), currency_original string, is_verified boolean, verification_note string, match_confidence decimal(4,3), effective_date date, is_active boolean, created_at timestamp",
}
ISSUE = "doc_id string, kind string, ordinal bigint, message string"
CELLS = "doc_id string, sheet string, row_pos int, cells array<string>"
LINES = "doc_id string, page int, line_no int, text string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` in its order; missing ones are null, others go."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return df.select(*((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def outside(df: DataFrame, column: str, accepted: tuple[str, ...]) -> DataFrame:
    """Rows whose value isn't accepted."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*accepted))
