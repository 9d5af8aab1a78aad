"""From a folder or archive of price lists to partners, documents, items and a report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.files import stable_id
from ..functions.text import SECTION_PREFIXES
from ..operators import lines as L
from ..operators import tables as T
from ..operators import validate as V
from ..sources import archive, office

#: Errors of documents without items.
NO_ROWS = {"xlsx": "Workbook has no recognized price rows", "xls": "Workbook has no recognized price rows", "docx": "DOCX document has no recognized price rows", "pdf": "PDF has no recognized price rows", "scan_pdf": "OCR PDF has no recognized price rows"}
#: Old workbooks are kept as workbooks.
STORED_FORMATS = {"xls": "xlsx"}


@dataclass(frozen=True)
class Options:
    min_pdf_text_chars: int = 80
    parse_scan_pdf: bool = True
    text_extractor: office.Extractor | None = None
    #: called with the content, `dpi` and `max_pages`
    scan_extractor: office.Extractor | None = None
    ocr_dpi: int = 220
    max_ocr_pages: int | None = None
    section_prefixes: tuple[str, ...] = SECTION_PREFIXES


def pdf_lines(files: DataFrame, options: Options) -> DataFrame:
    """Lines of PDF files: their text, or that of their scans (`scanned`) where the first pages hold too little."""
    text = office.read_lines(files, options.text_extractor)
    if not (options.parse_scan_pdf and options.scan_extractor):
        return text.withColumn("scanned", F.lit(False))
    enough = L.has_enough_text(text.where("text IS NOT NULL"), characters=options.min_pdf_text_chars).where("enough").select("doc_id")
    scan = partial(options.scan_extractor, dpi=options.ocr_dpi, max_pages=options.max_ocr_pages)
    scans = office.read_lines(files.join(enough, "doc_id", "left_anti"), scan)
    if options.max_ocr_pages is not None:
        scans = scans.where(F.col("page").isNull() | (F.col("page") <= options.max_ocr_pages))
    scans = scans.withColumns({"error": F.concat(F.lit("OCR error: "), "error"), "scanned": F.lit(True)})
    return text.join(enough, "doc_id", "left_semi").withColumn("scanned", F.lit(False)).unionByName(scans)


def ingest_files(files: DataFrame, options: Options = Options(), as_of: Column | None = None) -> dict[str, DataFrame]:
    """Tables of the files: partners, documents, price_items, issues, parse_report."""
    files = archive.with_identity(files)
    about = files.drop("content")
    cells = office.read_cells(files)
    lines = pdf_lines(files, options)
    by_cell = T.items_of_tables(cells.where("error IS NULL"), sections=options.section_prefixes)
    by_line = L.items_of_lines(lines.where("error IS NULL"), sections=options.section_prefixes).withColumn("sheet", F.lit(None).cast("string"))
    items = by_cell.unionByName(by_line).join(about.select("doc_id", "partner_id", "effective_date", "file_format"), "doc_id")
    items = items.withColumns(
        {
            "item_id": stable_id(F.lit("item"), F.col("doc_id"), F.col("sheet"), F.col("source_row")),
            # tables of word-processor documents have no title
            "source_sheet": F.when(F.col("file_format") != "docx", F.col("sheet")),
            "is_verified": F.lit(False),
            "verification_note": F.lit(""),
            "is_active": F.lit(True),
        }
    )
    items = S.conform(items, S.ITEM)
    read = cells.where("error IS NOT NULL").select("doc_id", "error").unionByName(lines.where("error IS NOT NULL").select("doc_id", "error"))
    if options.parse_scan_pdf and options.scan_extractor:
        # what has no line of text has been scanned
        text = lines.where("NOT scanned").select("doc_id").distinct().withColumn("read", F.lit(True))
        is_scan = (F.col("file_format") == "pdf") & F.col("read").isNull() & F.col("error").isNull()
        about = about.join(text, "doc_id", "left").withColumn("file_format", F.when(is_scan, "scan_pdf").otherwise(F.col("file_format"))).drop("read")
    broken = about.where("error IS NOT NULL").select("doc_id", "error")
    other = about.where(F.col("error").isNull() & ~F.col("file_format").isin(*NO_ROWS)).select("doc_id", F.concat(F.lit("Unsupported file type: ."), "file_format").alias("error"))
    errors = read.unionByName(broken).unionByName(other)
    empty = about.join(items.select("doc_id").distinct(), "doc_id", "left_anti").join(errors.select("doc_id").distinct(), "doc_id", "left_anti")
    none = F.coalesce(*(F.when(F.col("file_format") == k, v) for k, v in NO_ROWS.items()))
    errors = errors.unionByName(empty.select("doc_id", none.alias("error")))
    found = V.issues(items, as_of).unionByName(errors.select("doc_id", F.lit("error").alias("kind"), F.lit(0).cast("bigint").alias("ordinal"), F.col("error").alias("message")))
    word = about.where("file_format = 'docx'").select("doc_id")
    paragraphs = office.read_lines(files, office.paragraph_lines, formats=("docx",)).where("error IS NULL")
    read_cells = cells.where("error IS NULL")
    sheets = T.raw_content(read_cells.join(word, "doc_id", "left_anti"))
    raw = sheets.unionByName(T.document_content(paragraphs, read_cells.join(word, "doc_id", "left_semi"))).unionByName(L.raw_content(lines.where("error IS NULL")))
    stored = F.col("file_format")
    for old, kept in STORED_FORMATS.items():
        stored = F.when(F.col("file_format") == old, kept).otherwise(stored)
    documents = about.select("doc_id", "partner_id", F.col("name").alias("file_name"), stored.alias("file_format"), "effective_date", F.current_timestamp().alias("parsed_at")).join(raw, "doc_id", "left")
    documents = S.conform(V.rolled_up(documents, found), S.DOCUMENT)
    now = F.current_timestamp()
    partners = about.select("partner_id", F.col("partner_name").alias("name"), F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at")).dropDuplicates(["partner_id"])
    return {"partners": S.conform(partners, S.PARTNER), "documents": documents, "price_items": items, "issues": found, "parse_report": V.parse_report(documents, items)}


def ingest(spark: SparkSession, path: str, options: Options = Options(), as_of: Column | None = None) -> dict[str, DataFrame]:
    return ingest_files(archive.read_files(spark, path), options, as_of)
