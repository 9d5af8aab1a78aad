"""Registered queries over the driver's tables, each with its SQL where SQL can say it.

The tables stand for those of the model: part for services, supplier with nation for
partners, orders for documents, lineitem for items, text of documents for lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import money as M
from ..functions import names
from ..functions import similarity as S
from ..functions import text as X
from ..operators import lines as L
from ..operators import matching as J
from ..operators import store
from ..operators import tables as T
from ..operators import trigram_index
from ..operators import validate as V
from ..operators.candidates import nearest
from ..operators.lemmas import complete
from ..sources.catalog import split_synonyms
from ..sources.shared import new_folder
from ..sources.snapshots import Table
from . import endpoints as E
from . import relational as R

AS_OF = "2000-01-01"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the model's tables

_SERVICE = "service AS (SELECT p_partkey AS service_id, p_name AS service_name, p_type AS category, p_brand AS code FROM part)"
_PARTNER = "partner AS (SELECT s_suppkey AS partner_id, s_name AS name, n_name AS city, s_acctbal >= 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_DOCUMENT = "document AS (SELECT o_orderkey AS doc_id, o_custkey AS partner_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'needs_review' ELSE 'error' END AS parse_status, CAST(o_orderdate AS DATE) AS effective_date FROM orders)"
_ITEM = """item AS (
  SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS doc_id, l_suppkey AS partner_id, p_name AS service_name_raw, p_brand AS service_code_source,
         CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS service_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS price_resident_kzt,
         CAST(CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(round(l_tax * 100) AS INT) - 3 AS DECIMAL(14,2)) AS price_nonresident_kzt,
         CAST(l_extendedprice AS DECIMAL(14,2)) AS price_original, CAST(l_shipdate AS DATE) AS effective_date, l_linestatus = 'O' AS is_active
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def services(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS service_id", "p_name AS service_name", "p_type AS category", "p_brand AS code")


def partners(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    return joined.selectExpr("s_suppkey AS partner_id", "s_name AS name", "n_name AS city", "s_acctbal >= 0 AS is_active")


def price_documents(spark, sf_dir):
    status = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'needs_review' ELSE 'error' END AS parse_status"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey AS partner_id", status, "CAST(o_orderdate AS DATE) AS effective_date")


def items(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return joined.selectExpr(
        "l_orderkey * 10 + l_linenumber AS item_id",
        "l_orderkey AS doc_id",
        "l_suppkey AS partner_id",
        "p_name AS service_name_raw",
        "p_brand AS service_code_source",
        "CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS service_id",
        "CAST(l_extendedprice AS DECIMAL(14,2)) AS price_resident_kzt",
        "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(round(l_tax * 100) AS INT) - 3 AS DECIMAL(14,2)) AS price_nonresident_kzt",
        "CAST(l_extendedprice AS DECIMAL(14,2)) AS price_original",
        "CAST(l_shipdate AS DATE) AS effective_date",
        "l_linestatus = 'O' AS is_active",
    )


def document_lines(spark, sf_dir):
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return split.withColumn("line_no", F.col("line_no") + 1)


_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)"


# -- validation and reports


@query(f"""WITH {_DOCUMENT}, {_ITEM}
SELECT (SELECT count(*) FROM document) AS documents_total, (SELECT count(*) FROM document WHERE parse_status = 'done') AS documents_done,
       (SELECT count(*) FROM document WHERE parse_status = 'needs_review') AS documents_need_review, (SELECT count(*) FROM document WHERE parse_status = 'error') AS documents_error,
       (SELECT count(*) FROM item) AS items_total""")
def doc_status_report(spark, sf_dir):
    return V.parse_report(price_documents(spark, sf_dir), items(spark, sf_dir))


@query(f"""WITH {_ITEM}
SELECT partner_id, lower(service_name_raw) AS name_key, effective_date, count(*) AS n, min(doc_id) AS doc_id, 'duplicate position: ' || lower(service_name_raw) AS message
FROM item GROUP BY partner_id, lower(service_name_raw), effective_date HAVING count(*) > 1""")
def duplicate_positions(spark, sf_dir):
    return V.duplicate_positions(items(spark, sf_dir))


@query(f"""WITH {_ITEM}, month AS (SELECT doc_id, partner_id, lower(left(service_name_raw, 1)) AS name_key FROM item)
SELECT doc_id, partner_id, name_key, CAST(NULL AS DATE) AS effective_date, count(*) AS n, 'duplicate position: ' || name_key AS message FROM month GROUP BY doc_id, partner_id, name_key HAVING count(*) > 1""")
def document_duplicates(spark, sf_dir):
    """Duplicates within a document; names are cut to a letter and dates left out, so that there are some."""
    cut = items(spark, sf_dir).withColumns({"service_name_raw": F.left("service_name_raw", F.lit(1)), "effective_date": F.lit(None).cast("date")})
    return V.duplicate_positions(cut, within=("doc_id",))


@query(f"""WITH {_ITEM}, marked AS (SELECT *, CASE WHEN item_id % 7 <> 0 THEN effective_date END AS day FROM item),
ranked AS (SELECT *, row_number() OVER (PARTITION BY partner_id, service_name_raw, day ORDER BY item_id, price_resident_kzt) AS n FROM marked WHERE is_active AND day IS NOT NULL)
SELECT item_id, partner_id, service_name_raw, day, price_resident_kzt FROM ranked WHERE n = 1
UNION ALL SELECT item_id, partner_id, service_name_raw, day, price_resident_kzt FROM marked WHERE NOT (is_active AND day IS NOT NULL)""")
def active_dedup(spark, sf_dir):
    marked = items(spark, sf_dir).withColumn("day", F.when(F.col("item_id") % 7 != 0, F.col("effective_date")))
    kept = store.active_once(marked, [F.col("item_id"), F.col("price_resident_kzt")], ("partner_id", "service_name_raw", "day"))
    return kept.select("item_id", "partner_id", "service_name_raw", "day", "price_resident_kzt")


_TEST_ITEM = """test_item AS (SELECT item_id, doc_id, partner_id, CASE WHEN item_id % 11 = 0 THEN '  ' ELSE service_name_raw END AS service_name_raw,
  CASE WHEN item_id % 13 <> 0 THEN price_resident_kzt END AS price_resident_kzt, CASE WHEN item_id % 13 <> 0 THEN price_nonresident_kzt END AS price_nonresident_kzt,
  CASE WHEN item_id % 13 <> 0 THEN price_original END AS price_original, effective_date FROM item)"""
_ISSUES = f"""issue AS (
  SELECT doc_id, item_id, CAST(0 AS INT) AS r, 'empty service name in item ' || item_id AS message FROM test_item WHERE trim(service_name_raw) = ''
  UNION ALL SELECT doc_id, item_id, 1, 'no positive price: ' || service_name_raw FROM test_item WHERE NOT (coalesce(price_resident_kzt > 0, false) OR coalesce(price_nonresident_kzt > 0, false) OR coalesce(price_original > 0, false))
  UNION ALL SELECT doc_id, item_id, 2, 'nonresident < resident: ' || service_name_raw FROM test_item WHERE price_nonresident_kzt < price_resident_kzt
  UNION ALL SELECT doc_id, item_id, 3, 'future price date: ' || service_name_raw FROM test_item WHERE effective_date > DATE '{AS_OF}')"""


def _test_items(spark, sf_dir):
    priced = F.col("item_id") % 13 != 0
    changed = {c: F.when(priced, F.col(c)) for c in ("price_resident_kzt", "price_nonresident_kzt", "price_original")}
    return items(spark, sf_dir).withColumns(changed | {"service_name_raw": F.when(F.col("item_id") % 11 == 0, "  ").otherwise(F.col("service_name_raw"))})


@query(f"WITH {_ITEM}, {_TEST_ITEM}, {_ISSUES} SELECT doc_id, item_id, message FROM issue")
def validation_issues(spark, sf_dir):
    return V.row_issues(_test_items(spark, sf_dir), F.lit(AS_OF).cast("date")).select("doc_id", "item_id", "message")


@query(f"""WITH {_DOCUMENT}, {_ITEM}, {_TEST_ITEM}, {_ISSUES},
twice AS (SELECT min(doc_id) AS doc_id, lower(service_name_raw) AS name_key FROM test_item GROUP BY partner_id, lower(service_name_raw), effective_date HAVING count(*) > 1),
found AS (SELECT doc_id, 0 AS k, 0 AS part, CAST(item_id AS VARCHAR) AS place, r, message FROM issue
          UNION ALL SELECT doc_id, 0, 1, name_key, 0, 'duplicate position: ' || name_key FROM twice
          UNION ALL SELECT doc_id, 1, 2, '', 0, 'document is unreadable' FROM document WHERE parse_status = 'error'),
logs AS (SELECT doc_id, max(k) AS worst, string_agg(message, chr(10) ORDER BY k, part, place, r, message) AS log FROM found GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN worst = 1 THEN 'error' WHEN worst = 0 THEN 'needs_review' ELSE 'done' END AS parse_status, coalesce(log, '') AS parse_log
FROM document d LEFT JOIN logs ON d.doc_id = logs.doc_id""")
def document_rollup(spark, sf_dir):
    documents = price_documents(spark, sf_dir)
    errors = documents.where("parse_status = 'error'").selectExpr("doc_id", "'error' AS kind", "CAST(0 AS BIGINT) AS ordinal", "'document is unreadable' AS message")
    # duplicates over all documents of a partner, as the SQL says
    found = V.issues(_test_items(spark, sf_dir), F.lit(AS_OF).cast("date"), within=()).unionByName(errors)
    return V.rolled_up(documents, found).select("doc_id", "parse_status", "parse_log")


# -- money in SQL

_PARSED = """regexp_replace(translate({c}, 'OОоCСсIІl', '000000111'), '[^0-9,.-]', '', 'g')"""


def _digits(column: str) -> str:
    return _PARSED.format(c=column)


def _pointed(column: str) -> str:
    return f"replace(CASE WHEN length({column}) - length(replace({column}, ',', '')) = 1 AND NOT contains({column}, '.') THEN replace({column}, ',', '.') ELSE {column} END, ',', '')"


def _valued(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN try_cast({column} AS DECIMAL(38,10)) END"


# -- lines


@query(f"""WITH {_LINES}, marked AS (SELECT doc_id, line_no, trim(text) AS text, trim(text) = '' AS skip, len(regexp_extract_all(text, '[0-9]{{3,}}')) > 0 AS priced FROM lines),
held AS (SELECT *, coalesce(sum(CAST(skip OR priced AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM marked)
SELECT doc_id, max(line_no) AS source_row, string_agg(text, ' ' ORDER BY line_no) FILTER (NOT skip AND text <> '') AS name, CAST(arg_max(len(regexp_extract_all(text, '[0-9]{{3,}}')), line_no) AS INT) AS n_prices
FROM held GROUP BY doc_id, island HAVING arg_max(priced AND NOT skip, line_no)""")
def line_fold(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    found = F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))
    folded = L.fold(lines, "doc_id", "line_no", F.trim("text") == "", F.trim("text"), found)
    return folded.select("doc_id", "source_row", "name", F.size("prices").alias("n_prices"))


_LISTED = "regexp_extract_all(line, '(?:[0-9IІlOОСC]{1,3}(?:[\\s.,][0-9OОСC]{3})+|[0-9IІlOОСC]{3,})(?:[.,][0-9]{1,2})?')"


# the first line is a section and the second has no price, so the third, which is spelled below, gives the item
@query(f"""WITH listed AS (SELECT p_partkey, p_size, p_name, p_brand || ' ' || CAST(floor(p_retailprice) AS BIGINT) || ' КZT 15OO' AS line FROM part),
tokens AS (SELECT p_partkey, unnest({_LISTED}) AS token, unnest(range(0, len({_LISTED}))) AS place FROM listed),
digits AS (SELECT *, {_digits('token')} AS d FROM tokens), pointed AS (SELECT *, {_pointed('d')} AS e FROM digits), valued AS (SELECT *, {_valued('e')} AS amount FROM pointed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY place DESC) AS back FROM valued WHERE amount > 0),
paid AS (SELECT p_partkey, arg_min(amount, place) AS one, arg_max(amount, place) AS two, count(*) AS n FROM ranked WHERE back <= 3 GROUP BY p_partkey)
SELECT p_partkey AS doc_id, p_name || rtrim(' ' || line[1:strpos(line, {_LISTED}[1]) - 1]) AS service_name_raw, 'B' || p_size AS service_code_source, CAST(one AS DECIMAL(14,2)) AS price_resident_kzt,
  CAST(CASE WHEN n > 1 THEN two END AS DECIMAL(14,2)) AS price_nonresident_kzt, CAST(one AS DECIMAL(14,2)) AS price_original, 'KZT' AS currency_original, CAST(2 AS INT) AS source_row FROM listed JOIN paid USING (p_partkey)""")
def line_items(spark, sf_dir):
    """Flagship: price lists made of part names and prices, read as text lines."""
    parts = table(spark, sf_dir, "part")
    text = F.concat_ws("\n", F.concat(F.lit("Раздел "), "p_type"), F.concat_ws(" ", F.concat(F.lit("B"), F.col("p_size").cast("string")), "p_name"), F.concat_ws(" ", "p_brand", F.col("p_retailprice").cast("int").cast("string"), F.lit("КZT"), F.lit("15OO")))
    lines = parts.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return L.items_of_lines(lines)


@query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS raw_content FROM lines WHERE line_no <= 5 GROUP BY doc_id")
def raw_content(spark, sf_dir):
    return L.raw_content(document_lines(spark, sf_dir), most=5)


@query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS raw_content FROM lines WHERE line_no <= 3000 GROUP BY doc_id")
def whole_raw_content(spark, sf_dir):
    return L.raw_content(document_lines(spark, sf_dir))


@query(f"""WITH {_LINES} SELECT doc_id, coalesce(length(trim(string_agg(trim(text), ' ' ORDER BY line_no) FILTER (line_no <= 2))), 0) >= 80 AS enough FROM lines GROUP BY doc_id""")
def text_probe(spark, sf_dir):
    return L.has_enough_text(document_lines(spark, sf_dir), page="line_no")


# -- money and text

_MONEY_TEXT = """money AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS w, CASE p_partkey % 8 WHEN 0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)
  WHEN 1 THEN CAST(floor(p_retailprice) AS BIGINT) || ',50' WHEN 2 THEN CAST(floor(p_retailprice) AS BIGINT) || ',500,000' WHEN 3 THEN '1' || 'O' || CAST(floor(p_retailprice) AS BIGINT)
  WHEN 4 THEN '-' || CAST(floor(p_retailprice) AS BIGINT) WHEN 5 THEN CAST(floor(p_retailprice) AS BIGINT) || '-2000' WHEN 6 THEN CAST(floor(p_retailprice) AS BIGINT) || ' 000 тг.' ELSE 'l' || CAST(floor(p_retailprice) AS BIGINT) || '.5' END AS raw FROM part)"""


def _parsed(column: str) -> str:
    text = _PARSED.format(c=column)
    text = f"replace(CASE WHEN length({text}) - length(replace({text}, ',', '')) = 1 AND NOT contains({text}, '.') THEN replace({text}, ',', '.') ELSE {text} END, ',', '')"
    value = f"CASE WHEN regexp_full_match({text}, '([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN try_cast({text} AS DECIMAL(38,10)) END"
    return f"CASE WHEN {value} > 0 THEN {value} END"


def _money_text():
    whole = F.floor("p_retailprice").cast("bigint").cast("string")
    forms = (whole, F.concat(whole, F.lit(",50")), F.concat(whole, F.lit(",500,000")), F.concat(F.lit("1O"), whole), F.concat(F.lit("-"), whole), F.concat(whole, F.lit("-2000")), F.concat(whole, F.lit(" 000 тг.")), F.concat(F.lit("l"), whole, F.lit(".5")))
    text = forms[-1]
    for k, form in enumerate(forms[:-1]):
        text = F.when(F.col("p_partkey") % 8 == k, form).otherwise(text)
    return text


@query(f"WITH {_MONEY_TEXT} SELECT p_partkey, raw, {_parsed('raw')} AS amount FROM money")
def parse_money(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", _money_text().alias("raw"))
    return rows.withColumn("amount", M.parse_money(F.col("raw")))


_TOKENS = "regexp_extract_all(line, '(?:[0-9IІlOОСC]{1,3}(?:[\\s.,][0-9OОСC]{3})+|[0-9IІlOОСC]{3,})(?:[.,][0-9]{1,2})?')"


@query(f"""WITH spelled AS (SELECT p_partkey, p_name || ' - ' || CAST(floor(p_retailprice) AS BIGINT) || '.50 / ' || p_size || ' 000 / 15OO' AS line FROM part),
tokens AS (SELECT p_partkey, unnest({_TOKENS}) AS token, CAST(unnest(range(0, len({_TOKENS}))) AS INT) AS place FROM spelled)
SELECT p_partkey, place, {_parsed('token')} AS amount FROM tokens""")
def extract_prices(spark, sf_dir):
    spelled = F.concat("p_name", F.lit(" - "), F.floor("p_retailprice").cast("bigint").cast("string"), F.lit(".50 / "), F.col("p_size").cast("string"), F.lit(" 000 / 15OO"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(M.extract_prices(spelled)).alias("place", "amount"))


_KEY_TEXT = "CASE p_partkey % 5 WHEN 0 THEN 'Раздел ' WHEN 1 THEN 'Приложение №' WHEN 2 THEN 'Ёлка-' WHEN 3 THEN '2024 год' ELSE '' END || CASE WHEN p_partkey % 5 = 3 THEN '' ELSE p_brand || ' / ' || upper(p_name) END"
_NOISY = " OR ".join(f"starts_with(k, '{p}')" for p in X.NOISE_PREFIXES)
_SECTION = " OR ".join(f"starts_with(k, '{p}')" for p in X.SECTION_PREFIXES)


@query(f"""WITH keyed AS (SELECT p_partkey, trim(regexp_replace(replace(lower({_KEY_TEXT}), 'ё', 'е'), '[^0-9a-zа-яё]+', ' ', 'g')) AS k FROM part)
SELECT p_partkey, k AS name_key, k = '' OR {_NOISY} OR regexp_full_match(k, '20[0-9]{{2}}( год| года)?') AS is_noise, {_SECTION} AS is_section FROM keyed""")
def clean_key(spark, sf_dir):
    begin = F.lit("")
    for k, word in enumerate(("Раздел ", "Приложение №", "Ёлка-", "2024 год")):
        begin = F.when(F.col("p_partkey") % 5 == k, word).otherwise(begin)
    rest = F.when(F.col("p_partkey") % 5 == 3, "").otherwise(F.concat("p_brand", F.lit(" / "), F.upper("p_name")))
    # the number sign has a compatibility form of letters, so NFKC is left out here as SQL has none
    rows = table(spark, sf_dir, "part").select("p_partkey", X.normalize_key(F.concat(begin, rest), compatibility=False).alias("name_key"))
    return rows.select("p_partkey", "name_key", X.is_noise(F.col("name_key")).alias("is_noise"), X.is_section(F.col("name_key")).alias("is_section"))


@query("""WITH named AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'price ' || s_name || ' 20' || (10 + s_suppkey % 20) || '.xlsx' WHEN 1 THEN s_name || '_2025.xlsx' WHEN 2 THEN '2025.xlsx' ELSE 'PRICE-' || s_name || '.pdf' END AS file_name FROM supplier),
told AS (SELECT *, regexp_extract(file_name, '\\b(20[0-9]{2})\\b', 1) AS y, regexp_replace(file_name, '[.][^.]*$', '') AS stem FROM named)
SELECT s_suppkey, file_name, try_cast(y AS INT) AS file_year, CASE WHEN y <> '' THEN make_date(CAST(y AS BIGINT), 1, 1) END AS effective_date,
       coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)\\b(price|20[0-9]{2})\\b', ' ', 'g'), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), stem) AS partner_name FROM told""")
def year_and_partner(spark, sf_dir):
    key = F.col("s_suppkey") % 4
    name = (
        F.when(key == 0, F.concat(F.lit("price "), "s_name", F.lit(" 20"), (F.col("s_suppkey") % 20 + 10).cast("string"), F.lit(".xlsx")))
        .when(key == 1, F.concat("s_name", F.lit("_2025.xlsx")))
        .when(key == 2, F.lit("2025.xlsx"))
        .otherwise(F.concat(F.lit("PRICE-"), "s_name", F.lit(".pdf")))
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("file_name"))
    told = {"file_year": N.guess_year(F.col("file_name")), "effective_date": N.guess_effective_date(F.col("file_name")), "partner_name": N.guess_partner_name(F.col("file_name"))}
    return rows.withColumns(told)


@query("""SELECT event_id, CAST(len(list_filter(regexp_split_to_array(trim('[' || event_type || '; "' || user_id || '" |, ' || event_id || ']', '[]'), '[;,\\n|]+'), lambda p: trim(p) <> '')) AS INT) AS n_synonyms,
trim(trim(list_filter(regexp_split_to_array(trim('[' || event_type || '; "' || user_id || '" |, ' || event_id || ']', '[]'), '[;,\\n|]+'), lambda p: trim(p) <> '')[2]), '"') AS second FROM events""")
def synonym_split(spark, sf_dir):
    text = F.concat(F.lit("["), "event_type", F.lit('; "'), F.col("user_id").cast("string"), F.lit('" |, '), F.col("event_id").cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "events").select("event_id", split_synonyms(text).alias("s"))
    return rows.select("event_id", F.size("s").alias("n_synonyms"), F.element_at("s", 2).alias("second"))


def _words(text: str, *dictionaries) -> str:
    """Whole words between single spaces, one entry after the other."""
    text = f"' ' || replace({text}, ' ', '  ') || ' '"
    for old, new in (entry for words in dictionaries for entry in words.items()):
        text = f"replace({text}, ' {old} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({text}, ' +', ' ', 'g'))"


_DICTIONARY = [*names.TYPOS, *names.ABBREVIATIONS, *names.REWRITES]
_PICK = "[{words}][CAST(p_partkey * {k} % {n} + 1 AS BIGINT)]"
_PICKED = [_PICK.format(words=", ".join(f"'{w}'" for w in _DICTIONARY), k=k, n=len(_DICTIONARY)) for k in (1, 7)]
_NOISE_LIST = ", ".join(f"'{w}'" for w in names.NOISE_WORDS)


@query(f"""WITH named AS (SELECT p_partkey, {_PICKED[0]} || ' ' || p_name || ' ' || {_PICKED[1]} || ' (1 усл) №5' AS raw FROM part),
plain AS (SELECT *, trim(regexp_replace(replace(regexp_replace(replace(lower(raw), 'ё', 'е'), '\\([^)]*\\)', ' ', 'g'), '№', ' '), ' +', ' ', 'g')) AS t FROM named),
typed AS (SELECT *, {_words('t', names.TYPOS)} AS t1 FROM plain), long AS (SELECT *, {_words('t1', names.ABBREVIATIONS)} AS t2 FROM typed), told AS (SELECT *, {_words('t2', names.REWRITES)} AS t3 FROM long)
SELECT p_partkey, raw, coalesce(array_to_string(list_filter(string_split(t3, ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_NOISE_LIST})), ' '), '') AS normalized,
  {_words('lower(raw)', names.SYNONYMS)} AS expanded FROM told""")
def normalized_names(spark, sf_dir):
    """Russian names made of the dictionaries' words."""
    words = F.array(*(F.lit(w) for w in (*names.TYPOS, *names.ABBREVIATIONS, *names.REWRITES)))
    pick = lambda k: F.element_at(words, (F.col("p_partkey") * k % F.size(words) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", pick(1), "p_name", pick(7), F.lit("(1 усл) №5")).alias("raw"))
    return rows.select("p_partkey", "raw", names.normalize_name(F.col("raw")).alias("normalized"), names.expand_synonyms(F.lower("raw")).alias("expanded"))


# -- tables of cells

_CELLS = """sheet_rows AS (SELECT l_orderkey AS doc_id, 'Прайс' AS sheet, CAST(2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS row_pos,
    [p_brand, p_name, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_extendedprice) AS BIGINT) || ',5' ELSE '' END] AS cells FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT l_orderkey, 'Прайс', 0, ['Прейскурант', '', '', ''] FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 'Прайс', 1, ['Код', 'Наименование', 'Цена', 'Цена'] FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 'Прайс', 2, ['', 'услуги', 'резидент', 'нерезидент СНГ'] FROM lineitem)"""
_KEYED = "trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^0-9a-zа-яё]+', ' ', 'g'))"
_SCORE = " + ".join(f"CAST(contains({_KEYED.format(c='list_aggregate(cells, $$string_agg$$, $$ $$)')}, '{s}') AS INT)" for s in T.HEADER_STEMS)
_HEADER = f"header AS (SELECT doc_id, sheet, row_pos AS header FROM (SELECT doc_id, sheet, row_pos, score, row_number() OVER (PARTITION BY doc_id, sheet ORDER BY score DESC, row_pos DESC) AS n FROM (SELECT *, {_SCORE} AS score FROM sheet_rows WHERE row_pos < 80)) WHERE n = 1 AND score >= 2)"
_TITLES = f"""titles AS (SELECT doc_id, sheet, col, {_KEYED.format(c="string_agg(trim(cell), ' ' ORDER BY row_pos)")} AS k FROM
  (SELECT r.doc_id, r.sheet, row_pos, CAST(unnest(range(0, len(cells))) AS INT) AS col, unnest(cells) AS cell FROM sheet_rows r JOIN header h ON r.doc_id = h.doc_id AND r.sheet = h.sheet WHERE row_pos BETWEEN header AND header + 2)
  WHERE trim(cell) <> '' GROUP BY doc_id, sheet, col)"""


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _price_col(needles) -> str:
    price = _any("k", T.PRICE_WORDS)
    ranked = ", ".join(f"min(col) FILTER ({price} AND contains(k, '{n}'))" for n in needles)
    return f"coalesce({ranked}, min(col) FILTER ({price}))"


_MAP = f"""map AS (SELECT doc_id, sheet, min(col) FILTER ({_any('k', T.NAME_NEEDLES)}) AS name_col, min(col) FILTER ({_any('k', T.CODE_NEEDLES)}) AS code_col,
  {_price_col(T.RESIDENT_NEEDLES)} AS resident_col, {_price_col(T.NONRESIDENT_NEEDLES)} AS nonresident_col, {_price_col(T.ORIGINAL_NEEDLES)} AS original_col FROM titles GROUP BY doc_id, sheet)"""


def sheet_rows(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    whole = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"
    place = "CAST(2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS row_pos"
    rows = lineitem.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).selectExpr(
        "l_orderkey AS doc_id", "'Прайс' AS sheet", place, f"array(p_brand, p_name, {whole}, IF(l_linenumber % 2 = 0, concat({whole}, ',5'), '')) AS cells"
    )
    for k, cells in enumerate((("Прейскурант", "", "", ""), ("Код", "Наименование", "Цена", "Цена"), ("", "услуги", "резидент", "нерезидент СНГ"))):
        heads = lineitem.select(F.col("l_orderkey").alias("doc_id")).distinct()
        rows = rows.unionByName(heads.select("doc_id", F.lit("Прайс").alias("sheet"), F.lit(k).alias("row_pos"), F.array(*map(F.lit, cells)).alias("cells")))
    return rows


@query(f"WITH {_CELLS}, {_HEADER} SELECT doc_id, sheet, header FROM header")
def header_pick(spark, sf_dir):
    return T.pick_headers(sheet_rows(spark, sf_dir), compatibility=False)


@query(f"WITH {_CELLS}, {_HEADER}, {_TITLES}, {_MAP} SELECT * FROM map")
def column_map(spark, sf_dir):
    rows = sheet_rows(spark, sf_dir)
    # NFKC is left out here as SQL has none
    return T.column_map(T.merged_headers(rows, T.pick_headers(rows, compatibility=False), compatibility=False))


@query(f"""WITH {_CELLS}, {_HEADER}, {_TITLES}, {_MAP},
found AS (SELECT r.doc_id, r.sheet, CAST(row_pos + 1 AS INT) AS source_row, coalesce(trim(cells[name_col + 1]), '') AS name, nullif(coalesce(trim(cells[code_col + 1]), ''), '') AS code,
  cells[resident_col + 1] AS r_text, cells[nonresident_col + 1] AS n_text, cells[original_col + 1] AS o_text FROM sheet_rows r JOIN header h ON r.doc_id = h.doc_id AND r.sheet = h.sheet JOIN map m ON r.doc_id = m.doc_id AND r.sheet = m.sheet WHERE row_pos > header),
digits AS (SELECT *, {_digits('r_text')} AS r0, {_digits('n_text')} AS n0, {_digits('o_text')} AS o0, {_KEYED.format(c='name')} AS k FROM found),
pointed AS (SELECT *, {_pointed('r0')} AS r1, {_pointed('n0')} AS n1, {_pointed('o0')} AS o1 FROM digits),
valued AS (SELECT *, {_valued('r1')} AS r2, {_valued('n1')} AS n2, {_valued('o1')} AS o2 FROM pointed),
priced AS (SELECT *, CASE WHEN r2 > 0 THEN r2 END AS r, CASE WHEN n2 > 0 THEN n2 END AS n, CASE WHEN o2 > 0 THEN o2 END AS o FROM valued)
SELECT doc_id, sheet, source_row, name AS service_name_raw, code AS service_code_source, CAST(coalesce(r, o) AS DECIMAL(14,2)) AS price_resident_kzt, CAST(n AS DECIMAL(14,2)) AS price_nonresident_kzt,
  CAST(coalesce(o, r, n) AS DECIMAL(14,2)) AS price_original, 'KZT' AS currency_original FROM priced
WHERE name <> '' AND NOT (k = '' OR {_NOISY} OR regexp_full_match(k, '20[0-9]{{2}}( год| года)?') OR {_SECTION}) AND coalesce(r, n, o) IS NOT NULL""")
def rows_to_items(spark, sf_dir):
    return T.items_of_tables(sheet_rows(spark, sf_dir), compatibility=False)


# -- matching

_LAST_CODE = "by_code AS (SELECT lower(trim(code)) AS code_key, arg_max(service_id, service_id) AS service_id, arg_max(service_name, service_id) AS service_name, arg_max(category, service_id) AS category FROM service GROUP BY 1)"
_LAST_NAME = "by_name AS (SELECT lower(service_name) AS choice, arg_max(service_id, service_id) AS service_id, arg_max(category, service_id) AS category FROM service GROUP BY 1)"


@query(f"WITH {_SERVICE}, {_ITEM}, {_LAST_CODE} SELECT item_id, c.service_id AS matched_id, c.service_name AS matched_name FROM item LEFT JOIN by_code c ON lower(trim(service_code_source)) = code_key")
def code_match(spark, sf_dir):
    index = J.code_index(services(spark, sf_dir).withColumn("ordinal", F.col("service_id")))
    rows = items(spark, sf_dir).withColumn("code_key", F.lower(F.trim("service_code_source"))).drop("service_id")
    return rows.join(index, "code_key", "left").select("item_id", F.col("service_id").alias("matched_id"), F.col("service_name").alias("matched_name"))


@query(f"WITH {_SERVICE}, {_ITEM}, {_LAST_NAME} SELECT item_id, n.service_id AS matched_id, n.category AS matched_category FROM item LEFT JOIN by_name n ON lower(service_name_raw) = choice")
def exact_match(spark, sf_dir):
    index = J.name_index(services(spark, sf_dir).withColumn("ordinal", F.col("service_id")))
    rows = J.with_normalized(items(spark, sf_dir).drop("service_id"), "service_name_raw", "choice")
    return rows.join(index, "choice", "left").select("item_id", F.col("service_id").alias("matched_id"), F.col("category").alias("matched_category"))


def name_pairs(spark, sf_dir):
    found = table(spark, sf_dir, "part").select("p_name").distinct()
    # a catalogue's distinct names; sized before it is broadcast
    choices = found.withColumnRenamed("p_name", "choice")
    return J.candidate_pairs(found.withColumnRenamed("p_name", "query"), choices, blocked=None)


_PAIRS = "names AS (SELECT DISTINCT p_name AS name FROM part), pairs AS (SELECT a.name AS query, b.name AS choice FROM names a CROSS JOIN names b)"
_GRAMS = "grams AS (SELECT name, substr(' ' || name || ' ', CAST(i AS BIGINT), 3) AS g, count(*) AS n FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM names) GROUP BY 1, 2), norms AS (SELECT name, sqrt(sum(n * n)) AS norm FROM grams GROUP BY 1), dots AS (SELECT a.name AS query, b.name AS choice, sum(a.n * b.n) AS dot FROM grams a JOIN grams b ON a.g = b.g GROUP BY 1, 2)"


@query(f"WITH {_PAIRS} SELECT query, choice, round(len(list_intersect(string_split(query, ' '), string_split(choice, ' '))) / len(list_distinct(list_concat(string_split(query, ' '), string_split(choice, ' ')))), 6) AS jaccard FROM pairs")
def token_jaccard(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("query", "choice", F.round(S.token_jaccard(F.col("query"), F.col("choice")), 6).alias("jaccard"))


@query(f"""WITH {_PAIRS}, said AS (SELECT *, list_filter(list_distinct(string_split(query, ' ')), lambda t: t NOT IN ('red', 'blue')) AS a, list_filter(list_distinct(string_split(choice, ' ')), lambda t: t NOT IN ('red', 'blue')) AS b FROM pairs)
SELECT query, choice, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round((len(list_intersect(a, b)) / len(a) + len(list_intersect(a, b)) / len(b)) / 2, 6) END AS coverage FROM said""")
def token_coverage(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("query", "choice", F.round(S.token_coverage(F.col("query"), F.col("choice"), ("red", "blue")), 6).alias("coverage"))


@query(f"WITH {_PAIRS}, {_GRAMS} SELECT p.query, p.choice, round(coalesce(dot, 0) / (x.norm * y.norm), 6) AS cosine FROM pairs p JOIN norms x ON p.query = x.name JOIN norms y ON p.choice = y.name LEFT JOIN dots d ON p.query = d.query AND p.choice = d.choice")
def trigram_cosine(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("query", "choice", F.round(S.trigram_cosine(F.col("query"), F.col("choice")), 6).alias("cosine"))


@query(f"""WITH {_PAIRS}, {_GRAMS}, scored AS (SELECT p.query, p.choice, round(coalesce(dot, 0) / (x.norm * y.norm), 4) AS trigram,
  round(len(list_intersect(string_split(p.query, ' '), string_split(p.choice, ' '))) / len(list_distinct(list_concat(string_split(p.query, ' '), string_split(p.choice, ' ')))), 4) AS jaccard
  FROM pairs p JOIN norms x ON p.query = x.name JOIN norms y ON p.choice = y.name LEFT JOIN dots d ON p.query = d.query AND p.choice = d.choice),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY trigram DESC, choice) AS t, row_number() OVER (PARTITION BY query ORDER BY jaccard DESC, choice) AS j FROM scored),
merged AS (SELECT query, choice, greatest(CASE WHEN t <= 5 THEN trigram END, CASE WHEN j <= 5 THEN jaccard END) AS fuzzy FROM ranked WHERE t <= 5 OR j <= 5)
SELECT query, choice, fuzzy, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fuzzy DESC, choice) AS place FROM merged) WHERE place <= 5""")
def topk_candidates(spark, sf_dir):
    q, c = F.col("query"), F.col("choice")
    scored = name_pairs(spark, sf_dir).withColumns({"trigram": F.round(S.trigram_cosine(q, c), 4), "jaccard": F.round(S.token_jaccard(q, c), 4)})
    return J.top_candidates(scored, order="choice", limit=5, scorers=("trigram", "jaccard")).select("query", "choice", "fuzzy", "place")


_LCS = """lcs AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b)), lambda k: 0) AS row FROM texts
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN 1 + CASE WHEN k = 1 THEN 0 ELSE row[k - 1] END ELSE row[k] END))) FROM lcs WHERE i < length(a)),
indel AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2 * coalesce(row[length(b)], 0) / (length(a) + length(b)) END AS ratio FROM lcs WHERE i = length(a))"""


@query(f"WITH RECURSIVE {_PAIRS}, texts AS (SELECT DISTINCT query AS a, choice AS b FROM pairs), {_LCS} SELECT a AS query, b AS choice, round(ratio, 6) AS ratio FROM indel")
def indel_ratio(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("query", "choice", F.round(S.indel_ratio("query", "choice"), 6).alias("ratio"))


def _asked(spark, sf_dir):
    # a third of the items have no code, and some names are misspelled
    rows = items(spark, sf_dir).drop("service_id").withColumns(
        {
            "service_code_source": F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" "), F.upper("service_code_source"))),
            "service_name_raw": F.when(F.col("item_id") % 5 == 0, F.concat(F.translate("service_name_raw", "ei", "ie"), F.lit(" (1)"))).otherwise(F.col("service_name_raw")),
        }
    )
    catalogue = services(spark, sf_dir).withColumns({"ordinal": F.col("service_id"), "service_id": F.col("service_id").cast("string"), "synonyms": F.array(F.concat(F.lit("new "), "service_name"))})
    return rows, catalogue


def _matched(spark, sf_dir):
    return J.match(*_asked(spark, sf_dir))


_SCORERS = ("weighted", "token_set", "token_sort", "partial")
_TELLING = "list_filter({c}, lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in S.LOW_VALUE_TOKENS) + "))"
_NORMAL = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)', ' ', 'g'), '[ ,.;:|/_+*-]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')), ' ')"
_CASCADE = f"""{_SERVICE}, {_ITEM},
asked AS (SELECT item_id, doc_id, partner_id, CASE WHEN item_id % 3 = 0 THEN lower(trim(service_code_source)) END AS code_key, CASE WHEN item_id % 5 = 0 THEN translate(service_name_raw, 'ei', 'ie') || ' (1)' ELSE service_name_raw END AS raw FROM item),
spelled AS (SELECT raw, {_NORMAL.format(c='raw')} AS query FROM (SELECT DISTINCT raw FROM asked)),
choices AS (SELECT {_NORMAL.format(c='n')} AS choice, max(service_id) AS ordinal FROM (SELECT service_name AS n, service_id FROM service UNION ALL SELECT 'new ' || service_name, service_id FROM service) GROUP BY 1),
by_code AS (SELECT lower(trim(code)) AS code_key, max(service_id) AS ordinal FROM service GROUP BY 1),
open_names AS (SELECT DISTINCT query FROM spelled WHERE query <> '' AND query NOT IN (SELECT choice FROM choices)),
pairs AS (SELECT query, choice, ordinal, list_sort(list_distinct(string_split(query, ' '))) AS x, list_sort(list_distinct(string_split(choice, ' '))) AS y,
  array_to_string(list_sort(string_split(query, ' ')), ' ') AS qs, array_to_string(list_sort(string_split(choice, ' ')), ' ') AS cs, CASE WHEN length(query) <= length(choice) THEN query ELSE choice END AS short, CASE WHEN length(query) <= length(choice) THEN choice ELSE query END AS long FROM open_names, choices),
sets AS (SELECT *, list_filter(x, lambda t: list_contains(y, t)) AS common, list_filter(x, lambda t: NOT list_contains(y, t)) AS xs, list_filter(y, lambda t: NOT list_contains(x, t)) AS ys FROM pairs),
forms AS (SELECT *, array_to_string(common, ' ') AS shared, array_to_string(list_concat(common, xs), ' ') AS one, array_to_string(list_concat(common, ys), ' ') AS two FROM sets),
parts AS (SELECT DISTINCT short, long FROM forms),
windows AS (SELECT short, long, long[i:i + length(short) - 1] AS w FROM (SELECT *, unnest(range(1, length(long) - length(short) + 2)) AS i FROM parts)
  UNION SELECT short, long, long[1:i] FROM (SELECT *, unnest(range(1, length(short))) AS i FROM parts) UNION SELECT short, long, long[length(long) - i + 1:] FROM (SELECT *, unnest(range(1, length(short))) AS i FROM parts)),
texts AS (SELECT query AS a, choice AS b FROM forms UNION SELECT qs, cs FROM forms UNION SELECT one, two FROM forms UNION SELECT shared, one FROM forms UNION SELECT shared, two FROM forms UNION SELECT short, w FROM windows),
{_LCS},
partials AS (SELECT short, long, max(ratio) AS partial FROM windows JOIN indel ON a = short AND b = w GROUP BY short, long),
rated AS (SELECT f.*, p.partial, q.ratio AS whole, s.ratio AS token_sort, CASE WHEN len(common) > 0 AND (len(xs) = 0 OR len(ys) = 0) THEN 1.0 ELSE greatest(t.ratio, CASE WHEN len(common) > 0 THEN u.ratio ELSE 0.0 END, CASE WHEN len(common) > 0 THEN v.ratio ELSE 0.0 END) END AS token_set
  FROM forms f JOIN partials p ON p.short = f.short AND p.long = f.long JOIN indel q ON q.a = query AND q.b = choice JOIN indel s ON s.a = qs AND s.b = cs JOIN indel t ON t.a = one AND t.b = two JOIN indel u ON u.a = shared AND u.b = one JOIN indel v ON v.a = shared AND v.b = two),
weighed AS (SELECT *, CASE WHEN length(long) / length(short) < 1.5 THEN best ELSE greatest(best, CASE WHEN length(long) / length(short) <= 8 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END * partial) END AS weighted FROM (SELECT *, greatest(whole, CAST(0.95 AS DOUBLE) * greatest(token_sort, token_set)) AS best FROM rated)),
ranked AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY query ORDER BY {c} DESC, ordinal) AS r_{c}' for c in _SCORERS)} FROM weighed),
taken AS (SELECT *, greatest({', '.join(f'CASE WHEN r_{c} <= 30 THEN {c} END' for c in _SCORERS)}) AS fuzzy FROM ranked WHERE least({', '.join(f'r_{c}' for c in _SCORERS)}) <= 30),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fuzzy DESC, ordinal) AS place, {_TELLING.format(c='x')} AS xt, {_TELLING.format(c='y')} AS yt FROM taken),
named AS (SELECT query AS name FROM open_names UNION SELECT choice FROM choices),
grams AS (SELECT name, substr(' ' || name || ' ', CAST(i AS BIGINT), 3) AS g, count(*) AS n FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM named) GROUP BY 1, 2),
norms AS (SELECT name, sqrt(sum(n * n)) AS norm FROM grams GROUP BY 1), dots AS (SELECT a.name AS query, b.name AS choice, sum(a.n * b.n) AS dot FROM grams a JOIN grams b ON a.g = b.g GROUP BY 1, 2),
combined AS (SELECT p.query, p.choice, p.ordinal, place, round(CAST(0.2 AS DOUBLE) * fuzzy + CAST(0.2 AS DOUBLE) * token_set + CAST(0.15 AS DOUBLE) * token_sort + CAST(0.15 AS DOUBLE) * partial + CAST(0.1 AS DOUBLE) * (len(common) / (len(common) + len(xs) + len(ys)))
    + CAST(0.15 AS DOUBLE) * CASE WHEN len(xt) = 0 OR len(yt) = 0 THEN 0.0 ELSE (len(list_intersect(xt, yt)) / len(xt) + len(list_intersect(xt, yt)) / len(yt)) / 2 END + CAST(0.05 AS DOUBLE) * (coalesce(dot, 0) / (m.norm * k.norm)), 4) AS score
  FROM placed p JOIN norms m ON m.name = p.query JOIN norms k ON k.name = p.choice LEFT JOIN dots d ON d.query = p.query AND d.choice = p.choice WHERE place <= 30),
best AS (SELECT query, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS n FROM combined WHERE score > 0) WHERE n = 1),
found AS (SELECT a.item_id, a.raw, s.query, c.ordinal AS code_id, n.ordinal AS name_id, b.ordinal AS near_id, b.score AS near_score FROM asked a JOIN spelled s ON a.raw = s.raw LEFT JOIN by_code c ON a.code_key = c.code_key LEFT JOIN choices n ON n.choice = s.query LEFT JOIN best b ON b.query = s.query),
judged AS (SELECT item_id, raw, query, CASE WHEN query = '' THEN NULL ELSE coalesce(code_id, name_id, CASE WHEN near_score >= 0.55 THEN near_id END) END AS id, near_id,
  CASE WHEN query = '' THEN 0.0 WHEN code_id IS NOT NULL THEN 0.98 WHEN name_id IS NOT NULL THEN 1.0 ELSE coalesce(near_score, 0.0) END AS score,
  CASE WHEN query = '' THEN 'none' WHEN code_id IS NOT NULL THEN 'code' WHEN name_id IS NOT NULL THEN 'exact' WHEN near_id IS NOT NULL THEN 'fuzzy_semantic' ELSE 'none' END AS method FROM found),
stated AS (SELECT *, CASE WHEN score >= 0.78 THEN 'auto' WHEN score >= 0.55 THEN 'needs_review' ELSE 'unmatched' END AS status FROM judged),
matched AS (SELECT item_id, raw, query AS normalized_name, CAST(id AS VARCHAR) AS service_id, s.service_name, CAST(score AS DOUBLE) AS score, status, method,
  CASE WHEN query = '' THEN 'empty_name' WHEN method = 'code' THEN 'matched by source code' WHEN method = 'exact' THEN 'exact normalized name' WHEN near_id IS NULL THEN 'no_best_candidate' WHEN id IS NULL THEN 'best candidate: ' || n.service_name || '; score=' || printf('%.3f', score) ELSE 'score=' || printf('%.3f', score) END AS reason
  FROM stated LEFT JOIN service s ON s.service_id = id LEFT JOIN service n ON n.service_id = near_id)"""


@query(f"WITH RECURSIVE {_CASCADE.replace('DESC, ordinal)', 'DESC, ordinal, choice)')} SELECT query, choice, ordinal, fuzzy, token_set, token_sort, partial, CAST(place AS INT) AS place FROM placed WHERE place <= 30")
def fuzzy_candidates(spark, sf_dir):
    rows, catalogue = _asked(spark, sf_dir)
    choices = J.name_index(catalogue)
    names = J.distinct_normalized(rows, "service_name_raw", "query").select("query").where("query <> ''").distinct()
    open_names = names.join(choices.select(F.col("choice").alias("query")), "query", "left_anti")
    top = J.top_candidates(nearest(open_names, choices, J.CANDIDATES))
    return top.select("query", "choice", "ordinal", "fuzzy", "token_set", "token_sort", "partial", "place")


@query(f"WITH RECURSIVE {_CASCADE} SELECT item_id, normalized_name, service_id, service_name, score, status, method, reason FROM matched")
def match_cascade(spark, sf_dir):
    return _matched(spark, sf_dir).select("item_id", "normalized_name", "service_id", "service_name", "score", "status", "method", "reason")


@query(f"""WITH RECURSIVE {_CASCADE} SELECT count(*) AS total, count(*) FILTER (status = 'auto') AS auto_matched, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'unmatched') AS unmatched,
  coalesce(round(count(*) FILTER (status = 'auto') / count(*) * 100, 2), 0) AS auto_rate FROM matched""")
def match_report(spark, sf_dir):
    return J.match_report(_matched(spark, sf_dir))


@query(f"WITH RECURSIVE {_CASCADE} SELECT raw AS raw_name, service_id, status AS match_status, score AS match_confidence, status || ': ' || coalesce(service_name, 'None') || '; ' || reason AS verification_note FROM matched WHERE status <> 'auto'")
def review_queue(spark, sf_dir):
    return J.review_queue(_matched(spark, sf_dir))


@query("""WITH scored AS (SELECT o_orderkey, round(o_totalprice % 101 / 100, 4) AS score FROM orders)
SELECT o_orderkey, score, CASE WHEN score >= 0.78 THEN 'auto' WHEN score >= 0.55 THEN 'needs_review' ELSE 'unmatched' END AS status FROM scored""")
def status_thresholds(spark, sf_dir):
    scored = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") % 101 / 100, 4).alias("score"))
    return scored.withColumn("status", J.status_of(F.col("score")))


# -- store and endpoints


@query(f"WITH {_SERVICE} SELECT * FROM service WHERE category = 'ECONOMY'")
def services_by_category(spark, sf_dir):
    return E.services(services(spark, sf_dir), "ECONOMY")


@query(f"WITH {_PARTNER}, {_ITEM} SELECT p.partner_id, name, city, service_id, price_resident_kzt, price_nonresident_kzt, effective_date FROM item i JOIN partner p ON i.partner_id = p.partner_id WHERE service_id = 7 AND i.is_active")
def service_partners(spark, sf_dir):
    return E.service_partners(items(spark, sf_dir), partners(spark, sf_dir), 7)


@query(f"WITH {_SERVICE}, {_ITEM} SELECT s.service_id, service_name, category, price_resident_kzt, price_nonresident_kzt, effective_date FROM item i JOIN service s ON i.service_id = s.service_id WHERE partner_id = 3 AND is_active")
def partner_services(spark, sf_dir):
    return E.partner_services(items(spark, sf_dir), services(spark, sf_dir), 3)


@query(f"WITH {_PARTNER} SELECT * FROM partner WHERE city = 'NATION_7' AND is_active")
def partners_by_city(spark, sf_dir):
    return E.partners(partners(spark, sf_dir), "NATION_7", True)


@query(f"WITH {_ITEM} SELECT item_id, doc_id, partner_id, service_name_raw, price_resident_kzt FROM item WHERE service_id IS NULL AND is_active")
def unmatched_queue(spark, sf_dir):
    return E.unmatched(items(spark, sf_dir)).select("item_id", "doc_id", "partner_id", "service_name_raw", "price_resident_kzt")


@query(f"""WITH {_DOCUMENT}, {_ITEM} SELECT (SELECT count(*) FROM document) AS documents_total, (SELECT count(*) FROM document WHERE parse_status = 'done') AS documents_done,
(SELECT count(*) FROM document WHERE parse_status = 'needs_review') AS documents_needs_review, (SELECT count(*) FROM document WHERE parse_status = 'error') AS documents_error,
count(*) AS items_total, count(service_id) AS items_matched, coalesce(round(count(service_id) / count(*) * 100, 2), 0) AS normalized_percent FROM item WHERE is_active""")
def stats(spark, sf_dir):
    return E.stats(price_documents(spark, sf_dir), items(spark, sf_dir))


_PADDED = "(SELECT DISTINCT {k}, substr('  ' || w || ' ', CAST(unnest(range(1, length(w) + 2)) AS BIGINT), 3) AS g FROM (SELECT {k}, unnest(regexp_split_to_array(lower({c}), '[^a-z0-9_]+')) AS w FROM {t}) WHERE w <> '')"


@query(f"""WITH {_SERVICE}, {_PARTNER}, named AS (SELECT 'service' AS kind, CAST(service_id AS VARCHAR) AS id, service_name AS name FROM service UNION ALL SELECT 'partner', CAST(partner_id AS VARCHAR), name FROM partner),
asked AS (SELECT 1 AS one, 'red widgets' AS q), g AS {_PADDED.format(k='kind, id', c='name', t='named')}, h AS {_PADDED.format(k='one', c='q', t='asked')},
counted AS (SELECT kind, id, count(*) AS n, count(*) FILTER (g IN (SELECT g FROM h)) AS common FROM g GROUP BY kind, id)
SELECT c.kind, c.id, named.name, common / (n + (SELECT count(*) FROM h) - common) AS similarity FROM counted c JOIN named ON c.kind = named.kind AND c.id = named.id WHERE common / (n + (SELECT count(*) FROM h) - common) >= 0.3""")
def trigram_search(spark, sf_dir):
    return E.search(services(spark, sf_dir), partners(spark, sf_dir), "red widgets")


@query(f"""WITH {_SERVICE}, {_PARTNER}, named AS (SELECT 'service' AS kind, CAST(service_id AS VARCHAR) AS id, service_name AS name FROM service UNION ALL SELECT 'partner', CAST(partner_id AS VARCHAR), name FROM partner),
said AS (SELECT DISTINCT name FROM named), asked AS (SELECT DISTINCT translate(p_name, 'ei', 'ie') || ' ' || p_type AS q FROM part UNION SELECT DISTINCT 'partner ' || s_name FROM supplier),
g AS {_PADDED.format(k='name', c='name', t='said')}, h AS {_PADDED.format(k='q', c='q', t='asked')}, m AS (SELECT name, count(*) AS n FROM g GROUP BY 1), k AS (SELECT q, count(*) AS n FROM h GROUP BY 1),
shared AS (SELECT q, name, count(*) AS common FROM g JOIN h ON g.g = h.g GROUP BY 1, 2),
near AS (SELECT q, name, common / (m.n + k.n - common) AS similarity FROM shared JOIN m USING (name) JOIN k USING (q))
SELECT q AS text, kind, id, name, similarity FROM near JOIN named USING (name) WHERE similarity >= 0.3""")
def indexed_search(spark, sf_dir):
    path = new_folder(spark, "trigram-index")
    trigram_index.build(E.named(services(spark, sf_dir), partners(spark, sf_dir)), path)
    asked = table(spark, sf_dir, "part").select(F.concat(F.translate("p_name", "ei", "ie"), F.lit(" "), "p_type").alias("text"))
    asked = asked.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("partner "), "s_name")))
    return trigram_index.search(spark, path, asked)


@query(f"WITH {_ITEM} SELECT * FROM item WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def fk_cascade(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return store.cascade(items(spark, sf_dir), parents, "doc_id")


@query(f"WITH {_ITEM} SELECT item_id, CASE WHEN partner_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN partner_id END AS partner_id, price_resident_kzt FROM item")
def fk_set_null(spark, sf_dir):
    parents = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("partner_id"))
    return store.set_null(items(spark, sf_dir).select("item_id", "partner_id", "price_resident_kzt"), parents, "partner_id")


# items as they come to the store, with rows that break a rule each
_INCOMING = """incoming AS (SELECT concat_ws('-', item_id, partner_id, price_resident_kzt, effective_date) AS item_id, item_id AS n, CASE WHEN item_id % 83 = 0 THEN -1 ELSE doc_id END AS doc_id, partner_id,
  CASE WHEN item_id % 97 <> 0 THEN service_name_raw END AS service_name_raw, service_id, CASE WHEN item_id % 79 = 0 THEN 1e15 ELSE CAST(price_original AS DOUBLE) END AS price_original,
  CASE WHEN item_id % 89 = 0 THEN 'EUR' WHEN item_id % 5 = 0 THEN 'USD' END AS currency_original, CASE WHEN item_id % 7 <> 0 THEN effective_date END AS effective_date, is_active FROM item)"""
_JUDGED = f"""{_ITEM}, {_INCOMING},
ruled AS (SELECT *, list_filter([CASE WHEN price_original >= 1e12 THEN 'type of price_original' END, CASE WHEN service_name_raw IS NULL THEN 'service_name_raw is null' END, CASE WHEN currency_original = 'EUR' THEN 'value of currency_original' END,
  CASE WHEN doc_id NOT IN (SELECT o_orderkey FROM orders) THEN 'doc_id without a row' END], lambda v: v IS NOT NULL) AS rules FROM incoming),
ranked AS (SELECT *, row_number() OVER (PARTITION BY partner_id, service_name_raw, effective_date, len(rules) = 0 AND is_active AND effective_date IS NOT NULL ORDER BY item_id) AS place FROM ruled),
judged AS (SELECT *, CASE WHEN len(rules) = 0 AND is_active AND effective_date IS NOT NULL AND place > 1 THEN ['partner_id, service_name_raw, effective_date again'] ELSE rules END AS violations FROM ranked)"""


def _stored(spark, sf_dir):
    text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in df.columns if c.endswith("_id")})
    target = R.Store(spark, new_folder(spark, "store"))
    R.insert(target, "service", text(services(spark, sf_dir)))
    R.insert(target, "partner", text(partners(spark, sf_dir)))
    documents = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "'list ' || o_orderkey || '.pdf' AS file_name", "'pdf' AS file_format")
    R.insert(target, "price_document", text(documents))
    number = F.col("item_id")
    incoming = items(spark, sf_dir).withColumns(
        {
            "item_id": F.concat_ws("-", number, "partner_id", "price_resident_kzt", "effective_date"),
            "doc_id": F.when(number % 83 == 0, -1).otherwise(F.col("doc_id")),
            "service_name_raw": F.when(number % 97 != 0, F.col("service_name_raw")),
            "price_original": F.when(number % 79 == 0, 1e15).otherwise(F.col("price_original").cast("double")),
            "currency_original": F.when(number % 89 == 0, "EUR").when(number % 5 == 0, "USD"),
            "effective_date": F.when(number % 7 != 0, F.col("effective_date")),
        }
    )
    R.insert(target, "price_item", text(incoming))
    return target


# literal rows of a document, and the names that they belong to
_LITERAL = """matched_rows AS (SELECT * FROM (VALUES ('checked item', 3500, 4200, TRUE, 0.97), ('another item', 10, 20, FALSE, 0.6)) AS v(service_name_raw, price_resident_kzt, price_nonresident_kzt, is_verified, match_confidence)),
open_rows AS (SELECT * FROM (VALUES ('an item of no service', 5000, 6000)) AS v(service_name_raw, price_resident_kzt, price_nonresident_kzt))"""
_STORED = "{p}service_name_raw, CAST(price_resident_kzt AS DECIMAL(14,2)) AS price_resident_kzt, CAST(price_nonresident_kzt AS DECIMAL(14,2)) AS price_nonresident_kzt"


@query(f"""WITH {_SERVICE}, {_PARTNER}, {_LITERAL},
p AS (SELECT CAST(partner_id AS VARCHAR) AS partner_id FROM partner WHERE name = 'Supplier#000000001' ORDER BY CAST(partner_id AS VARCHAR) LIMIT 1), s AS (SELECT CAST(service_id AS VARCHAR) AS service_id FROM service WHERE service_name = 'red widget' ORDER BY CAST(service_id AS VARCHAR) LIMIT 1)
SELECT partner_id, service_id, {_STORED.format(p='')}, is_verified, CAST(match_confidence AS DOUBLE) AS match_confidence, 'KZT' AS currency_original, TRUE AS is_active FROM matched_rows CROSS JOIN p CROSS JOIN s
UNION ALL SELECT partner_id, NULL, {_STORED.format(p='')}, FALSE, NULL, 'KZT', TRUE FROM open_rows CROSS JOIN p""")
def seeded_document(spark, sf_dir):
    text = lambda df, key: df.withColumn(key, F.col(key).cast("string"))
    target = R.Store(spark, new_folder(spark, "seeded"))
    R.insert(target, "service", text(services(spark, sf_dir), "service_id"))
    R.insert(target, "partner", text(partners(spark, sf_dir), "partner_id"))
    matched, rest = (spark.sql(f"WITH {_LITERAL} SELECT * FROM {t}") for t in ("matched_rows", "open_rows"))
    stored = R.seed(target, "Supplier#000000001", "red widget", "list.xlsx", matched, rest)
    return stored.select("partner_id", "service_id", "service_name_raw", "price_resident_kzt", "price_nonresident_kzt", "is_verified", F.col("match_confidence").cast("double").alias("match_confidence"), "currency_original", "is_active")


@query(f"WITH {_JUDGED} SELECT item_id, array_to_string(list_sort(violations), '; ') AS violations FROM judged WHERE len(violations) > 0")
def rejected_items(spark, sf_dir):
    return _stored(spark, sf_dir).rejects("price_item").select("item_id", F.array_join(F.array_sort("violations"), "; ").alias("violations"))


@query(f"""WITH {_JUDGED} SELECT item_id, CASE WHEN service_id IS NULL AND n % 3 = 0 THEN '7' ELSE CAST(service_id AS VARCHAR) END AS service_id, CASE WHEN service_id IS NULL AND n % 3 = 0 THEN CAST(0.9 AS DOUBLE) END AS match_confidence,
CAST(price_original AS DECIMAL(14,2)) AS price_original, coalesce(currency_original, 'KZT') AS currency_original, false AS is_verified FROM judged WHERE len(violations) = 0""")
def stored_items(spark, sf_dir):
    target = _stored(spark, sf_dir)
    found = target.read("price_item").where(F.col("service_id").isNull() & (F.element_at(F.split("item_id", "-"), 1).cast("bigint") % 3 == 0))
    R.set_match(target, found.select("item_id", F.lit("7").alias("service_id"), F.lit(0.9).alias("match_confidence")))
    return target.read("price_item").select("item_id", "service_id", F.col("match_confidence").cast("double").alias("match_confidence"), "price_original", "currency_original", "is_verified")


@query(f"""WITH {_ITEM}, {_INCOMING}, ranked AS (SELECT *, row_number() OVER (PARTITION BY partner_id, service_name_raw, effective_date ORDER BY item_id) AS place FROM incoming WHERE is_active AND effective_date IS NOT NULL AND service_name_raw IS NOT NULL)
SELECT item_id, partner_id, service_name_raw, effective_date, is_active FROM ranked WHERE place = 1
UNION ALL SELECT item_id, partner_id, service_name_raw, effective_date, is_active FROM incoming WHERE NOT (is_active AND effective_date IS NOT NULL AND service_name_raw IS NOT NULL)""")
def active_by_batches(spark, sf_dir):
    state = Table(spark, new_folder(spark, "active"), "item_id string, partner_id bigint, service_name_raw string, effective_date date, is_active boolean", ("partner_id", "service_name_raw", "effective_date"))
    number = F.col("item_id")
    rows = items(spark, sf_dir).select(
        F.concat_ws("-", number, "partner_id", "price_resident_kzt", "effective_date").alias("item_id"),
        F.col("partner_id").cast("bigint").alias("partner_id"),
        F.when(number % 97 != 0, F.col("service_name_raw")).alias("service_name_raw"),
        F.when(number % 7 != 0, F.col("effective_date")).alias("effective_date"),
        "is_active",
    )
    for k in (2, 0, 1):
        R.upsert_active(state, rows.where(F.pmod(F.crc32(F.col("item_id").cast("binary")), F.lit(3)) == k), [F.col("item_id")])
    return state.read()


# words of all documents; forms in s, d, ed, ing are taught by words that are there without them, and a quarter of the words is left out to be found
_TAUGHT = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS token FROM documents),
forms AS (SELECT token, lemma FROM (SELECT token AS lemma, token || unnest(['', 's', 'd', 'ed', 'ing']) AS token FROM words WHERE length(token) >= 3) JOIN words USING (token)),
known AS (SELECT token, min(lemma) AS lemma FROM forms WHERE ascii(token) % 4 <> 1 GROUP BY 1),
shared AS (SELECT *, list_max(list_transform(range(0, least(length(token), length(lemma)) + 1), lambda k: CASE WHEN left(token, k) = left(lemma, k) THEN k ELSE 0 END)) AS common FROM known),
cuts AS (SELECT token, CAST(length(token) - common AS INT) AS cut, substr(lemma, common + 1) AS put FROM shared WHERE common >= 2),
endings AS (SELECT right(token, k) AS ending, cut, put, count(*) AS n FROM (SELECT *, unnest(range(greatest(cut, 1), least(6, length(token) - 2) + 1)) AS k FROM cuts) GROUP BY 1, 2, 3),
rules AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, put DESC) AS place FROM endings) WHERE place = 1 AND n >= 2),
asked AS (SELECT token FROM words WHERE token NOT IN (SELECT token FROM known)),
found AS (SELECT token, cut, put, row_number() OVER (PARTITION BY token ORDER BY length(ending) DESC) AS place FROM (SELECT token, right(token, k) AS e FROM (SELECT token, unnest(range(1, least(6, length(token) - 2) + 1)) AS k FROM asked)) JOIN rules ON e = ending WHERE length(token) - cut >= 2)"""


@query(f"WITH {_TAUGHT} SELECT token, lemma FROM known UNION ALL SELECT token, left(token, length(token) - cut) || put FROM found WHERE place = 1")
def unseen_lemmas(spark, sf_dir):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    bases = words.where(F.length("token") >= 3).select(F.col("token").alias("lemma"), F.explode(F.array(*(F.concat("token", F.lit(e)) for e in ("", "s", "d", "ed", "ing")))).alias("token"))
    lemmas = bases.join(words, "token").where(F.ascii("token") % 4 != 1)
    return complete(words, lemmas)


@query(f"WITH {_ITEM} SELECT partner_id, service_name_raw, count(*) AS count FROM item GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return store.repeated_keys(items(spark, sf_dir), "partner_id", "service_name_raw")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_document(spark, sf_dir):
    return store.first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query(f"WITH {_SERVICE} SELECT service_id, service_name, category FROM service WHERE service_id % 3 <> 0 UNION ALL SELECT service_id, 'new ' || service_name, category FROM service WHERE service_id % 3 = 0")
def insert_on_conflict(spark, sf_dir):
    held = services(spark, sf_dir).select("service_id", "service_name", "category")
    offered = held.withColumn("service_name", F.concat(F.lit("new "), "service_name"))
    return store.insert_new(held.where("service_id % 3 <> 0"), offered, "service_id")


@query(f"WITH {_ITEM} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN coalesce(doc_id, service_id) ELSE service_id END AS service_id, CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE END AS match_confidence FROM (SELECT DISTINCT item_id, doc_id, service_id FROM item)")
def manual_match(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", "doc_id", "service_id").distinct().withColumn("match_confidence", F.lit(None).cast("double"))
    decided = rows.where("item_id % 2 = 0").select("item_id", F.col("doc_id").alias("service_id"), F.lit(1.0).alias("match_confidence")).distinct()
    return store.set_match(rows, decided).select("item_id", "service_id", "match_confidence")


#: Seed rows: services, partners, and one document with a matched and an open item.
_SEED = """WITH service AS (SELECT * FROM (VALUES (1, 'Общий анализ крови', 'лаборатория'), (2, 'УЗИ брюшной полости', 'диагностика'), (3, 'Консультация терапевта', 'консультация')) AS v(service_id, service_name, category)),
partner AS (SELECT * FROM (VALUES (1, 'Клиника Самал', 'Алматы'), (2, 'Медцентр Астана', 'Астана')) AS v(partner_id, name, city)),
p AS (SELECT partner_id FROM partner WHERE name = 'Клиника Самал' ORDER BY partner_id LIMIT 1),
d AS (SELECT 1 AS doc_id, partner_id, 'samal_2025.xlsx' AS file_name FROM p),
s AS (SELECT service_id FROM service WHERE service_name = 'Общий анализ крови' ORDER BY service_id LIMIT 1)
SELECT d.doc_id, d.partner_id, 'ОАК (клинический анализ крови)' AS service_name_raw, s.service_id, CAST(3500 AS DECIMAL(14,2)) AS price_resident_kzt, CAST(4200 AS DECIMAL(14,2)) AS price_nonresident_kzt, TRUE AS is_verified, CAST(0.97 AS DECIMAL(4,3)) AS match_confidence FROM d CROSS JOIN s
UNION ALL SELECT d.doc_id, d.partner_id, 'Анализ крови развёрнутый', NULL, CAST(5000 AS DECIMAL(14,2)), CAST(6000 AS DECIMAL(14,2)), FALSE, NULL FROM d"""


@query(_SEED)
def seed_pipeline(spark, sf_dir):
    return spark.sql(_SEED)
