"""Lines, tables, validation, matching, store and sources on small fixtures."""

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarifflow.operators import lines, matching, store, tables, validate
from tarifflow.plans import endpoints, ingest
from tarifflow.sources import archive, catalog, office
from tarifflow.sources import tables as sinks
from tarifflow.streaming import incremental


def price_lines(spark, *texts):
    return spark.createDataFrame([("d", n, t) for n, t in enumerate(texts, 1)], "doc_id string, line_no int, text string")


def test_line_fold(spark):
    rows = price_lines(spark, "Раздел 1. Анализы", "Общий анализ", "крови 3500 4200", "", "УЗИ 7000")
    got = lines.items_of_lines(rows).orderBy("source_row").collect()
    assert [(r["source_row"], r["service_name_raw"], r["price_resident_kzt"], r["price_nonresident_kzt"]) for r in got] == [(3, "Общий анализ крови", 3500, 4200), (5, "УЗИ", 7000, None)]
    rows = price_lines(spark, "Общий анализ", "", "крови 3500", "B02 Осмотр 1500", "ab 500", None)
    got = lines.items_of_lines(rows).orderBy("source_row").collect()
    assert [(r["service_code_source"], r["service_name_raw"]) for r in got] == [(None, "крови"), ("B02", "Осмотр")]


def sheet(spark, *rows):
    return spark.createDataFrame([("d", "s", n, list(r)) for n, r in enumerate(rows)], "doc_id string, sheet string, row_pos int, cells array<string>")


def test_header_tie_takes_the_later(spark):
    head = ("Код", "Наименование услуги", "Цена")
    assert tables.pick_headers(sheet(spark, head, head, ("1", "Анализ", "500"))).first()["header"] == 1
    assert tables.pick_headers(sheet(spark, ("a", "b"))).count() == 0


def test_columns_and_items(spark):
    rows = sheet(spark, ("Код", "Наименование", "Цена"), ("A1", "Анализ крови", "1 500"), ("", "Раздел 2", "10"), ("A2", "Осмотр", ""), ("A3", "Снимок", "2000", "лишнее"))
    got = tables.items_of_tables(rows).orderBy("source_row").collect()
    assert [(r["source_row"], r["service_code_source"], r["service_name_raw"], r["price_resident_kzt"], r["price_nonresident_kzt"], r["price_original"]) for r in got] == [
        (2, "A1", "Анализ крови", 1500, 1500, 1500),
        (5, "A3", "Снимок", 2000, 2000, 2000),
    ]


def test_needle_priority(spark):
    rows = sheet(spark, ("Название", "Цена нерезидент", "Цена резидент", "Код"), ("x", "1", "2", "3"))
    found = tables.column_map(tables.merged_headers(rows, tables.pick_headers(rows))).first()
    # the resident needle is part of the nonresident word, and the first column wins
    assert (found["resident_col"], found["nonresident_col"], found["name_col"], found["code_col"]) == (1, 1, 0, 3)


def test_plural_header_gives_no_name(spark):
    assert tables.items_of_tables(sheet(spark, ("Услуги", "Цена"), ("Анализ", "500"))).count() == 0


ITEM = "item_id string, doc_id string, partner_id string, service_name_raw string, price_resident_kzt decimal(14,2), price_nonresident_kzt decimal(14,2), price_original decimal(14,2), effective_date date"


def test_validation_and_rollup(spark):
    rows = [
        ("1", "a", "p", "Анализ", 100, 90, 100, None),
        ("2", "b", "q", "УЗИ", 5, None, 5, None),
        ("3", "c", "r", " ", None, None, None, dt.date(2030, 1, 1)),
        ("4", "d", "s", "Снимок", 5, 5, 5, None),
        ("5", "d", "s", "СНИМОК", 5, 5, 5, None),
    ]
    items = spark.createDataFrame([tuple(Decimal(v) if isinstance(v, int) else v for v in r) for r in rows], ITEM)
    found = validate.issues(items, F.lit("2025-01-01").cast("date"))
    errors = spark.createDataFrame([("a", "error", 0, "broken")], "doc_id string, kind string, ordinal bigint, message string")
    documents = spark.createDataFrame([(x,) for x in "abcde"], "doc_id string")
    got = {r["doc_id"]: (r["parse_status"], r["parse_log"]) for r in validate.rolled_up(documents, found.unionByName(errors)).collect()}
    assert got["a"] == ("error", "nonresident < resident: Анализ\nbroken")
    assert got["b"] == ("done", "") == got["e"]
    assert got["c"] == ("needs_review", "empty service name in item 3\nno positive price:  \nfuture price date:  ")
    assert got["d"] == ("needs_review", "duplicate position: снимок")


def services(spark):
    rows = [("1", "Общий анализ крови", "lab", "A1", "T1", ["ОАК"], 1), ("2", "УЗИ почек", "us", "A2", None, None, 2), ("3", "Общий анализ крови", "lab", "a1 ", None, None, 3)]
    return spark.createDataFrame(rows, "service_id string, service_name string, category string, code string, tarificator_code string, synonyms array<string>, ordinal int")


def test_matching_cascade(spark):
    rows = [(1, "", "A2"), (2, "что угодно", " a2 "), (3, "общий анализ КРОВИ", None), (4, "анализ крови общий", None), (5, "zzz", None), (6, None, None), (7, "любой", "T1")]
    got = {r["i"]: r for r in matching.match(spark.createDataFrame(rows, "i int, service_name_raw string, service_code_source string"), services(spark)).collect()}
    assert [(got[i]["service_id"], got[i]["status"], got[i]["method"], got[i]["score"]) for i in (1, 2, 3)] == [(None, "unmatched", "none", 0.0), ("2", "auto", "code", 0.98), ("3", "auto", "exact", 1.0)]
    assert got[4]["method"] == "fuzzy_semantic" and got[4]["service_id"] == "3"
    assert got[5]["status"] == "unmatched" and got[5]["service_id"] is None
    assert got[6]["reason"] == "empty_name" and got[7]["service_id"] == "1"
    report = matching.match_report(spark.createDataFrame([], "status string")).first()
    assert (report["total"], report["auto_rate"]) == (0, 0.0)


def test_thresholds(spark):
    got = spark.createDataFrame([(0.78,), (0.55,), (0.5499,)], "s double").select(matching.status_of(F.col("s"))).collect()
    assert [r[0] for r in got] == ["auto", "needs_review", "unmatched"]


def test_blocked_candidates_are_those_that_share_a_trigram(spark):
    queries = spark.createDataFrame([("abc",), ("xyz",)], "query string")
    choices = spark.createDataFrame([("abcd",), ("q",)], "choice string")
    assert matching.candidate_pairs(queries, choices, blocked=False).count() == 4
    assert [tuple(r) for r in matching.candidate_pairs(queries, choices, blocked=True).collect()] == [("abcd", "abc")]


def test_large_catalogues_keep_all_pairs(spark):
    queries = spark.createDataFrame([("abc",), ("xyz",)], "query string")
    choices = spark.createDataFrame([("abcd",), ("q",)], "choice string")
    want = sorted((q, c) for q in ("abc", "xyz") for c in ("abcd", "q"))
    for size in (1, 8 << 20):
        assert sorted(tuple(r) for r in matching.candidate_pairs(queries, choices, broadcast_bytes=size).collect()) == want


def test_active_once_exempts_nulls(spark):
    rows = [(1, "p", "x", dt.date(2025, 1, 1), True), (2, "p", "x", dt.date(2025, 1, 1), True), (3, "p", "x", None, True), (4, "p", "x", None, True), (5, "p", "x", dt.date(2025, 1, 1), False)]
    items = spark.createDataFrame(rows, "item_id int, partner_id string, service_name_raw string, effective_date date, is_active boolean")
    assert sorted(r["item_id"] for r in store.active_once(items, [F.col("item_id")]).collect()) == [1, 3, 4, 5]


def test_endpoints(spark):
    partner = spark.createDataFrame([(1, "Клиника Самал", "Алматы", True)], "partner_id int, name string, city string, is_active boolean")
    service = services(spark)
    assert endpoints.search(service, partner, "самал").first()["kind"] == "partner"
    assert endpoints.services(service, "us").count() == 1
    assert endpoints.partners(partner, "Алматы", False).count() == 0


# -- files


def workbook() -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = [("A1", "s", 0), ("B1", "s", 1), ("C1", "s", 2), ("A3", "inlineStr", "B7"), ("B3", "s", 3), ("C3", None, 1500)]
    rows: dict[str, str] = {}
    for at, kind, value in cells:
        body = f"<is><t>{value}</t></is>" if kind == "inlineStr" else f"<v>{value}</v>"
        rows[at[1:]] = rows.get(at[1:], "") + f'<c r="{at}"' + (f' t="{kind}"' if kind else "") + f">{body}</c>"
    sheet = f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{n}">{c}</row>' for n, c in rows.items()) + "</sheetData></worksheet>"
    strings = f'<sst xmlns="{main}">' + "".join(f"<si><t>{t}</t></si>" for t in ("Код", "Наименование", "Цена", "Анализ крови")) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Лист" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def word_document() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in (("Наименование", "Стоимость"), ("Осмотр", "2 500")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Цены</w:t></w:r></w:p><w:tbl>{rows}</w:tbl></w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/Клиника 2025.XLSX").write_bytes(workbook())
    with zipfile.ZipFile(tmp_path / "in/lists.ZIP", "w") as z:
        z.writestr("../#U041F.docx", word_document())
        z.writestr("sub/old.xls", b"x")
        z.writestr("readme.txt", "hello")
        z.writestr("text.pdf", b"Header\nBlood test 1500 2000")
    (tmp_path / "in/broken.xlsx").write_bytes(b"no archive")
    return tmp_path


def test_word_documents_keep_their_text(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    said = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = lambda n, name: "<w:tbl>" + "".join(f"<w:tr><w:tc>{said(f'{name} {k}')}</w:tc><w:tc><w:p/></w:tc><w:tc>{said('é  5')}</w:tc></w:tr>" for k in range(n)) + "</w:tbl>"
    bodies = {"words.docx": said("first") + said(" ") + said("second<w:br/> line".replace("<w:br/>", "</w:t><w:br/><w:t>")), "table.docx": said("before") + table(40, "a") + said("after"), "long.docx": "".join(table(60, f"t{k}") for k in range(11))}
    for name, body in bodies.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    got = {r["file_name"]: r["raw_content"] for r in ingest.ingest(spark, str(tmp_path))["documents"].collect()}
    assert got["words.docx"] == "first\nsecond line"
    assert got["table.docx"].split("\n") == ["before", "after", *(f"a {k} |  | é 5" for k in range(40))]
    assert got["long.docx"].split("\n") == [f"t{k // 60} {k % 60} |  | é 5" for k in range(500)]


def test_ingest(spark, folder):
    got = ingest.ingest(spark, str(folder / "in"), ingest.Options(text_extractor=lambda content: [(1, content.decode())]))
    documents = {r["file_name"]: r for r in got["documents"].collect()}
    status = {k: v["parse_status"] for k, v in documents.items()}
    assert status == {"Клиника 2025.XLSX": "done", "П.docx": "done", "old.xls": "error", "readme.txt": "error", "text.pdf": "done", "broken.xlsx": "error"}
    assert documents["old.xls"]["parse_log"] == office.XLS_ERROR
    assert documents["Клиника 2025.XLSX"]["effective_date"] == dt.date(2025, 1, 1)
    items = {r["service_name_raw"]: r for r in got["price_items"].collect()}
    assert set(items) == {"Анализ крови", "Осмотр", "Header Blood test"}
    assert (items["Анализ крови"]["service_code_source"], items["Анализ крови"]["source_row"], items["Анализ крови"]["source_sheet"]) == ("B7", 3, "Лист")
    assert items["Осмотр"]["price_original"] == 2500 and items["Осмотр"]["source_sheet"] is None
    assert (documents["old.xls"]["file_format"], documents["text.pdf"]["file_format"]) == ("xlsx", "pdf")
    report = got["parse_report"].first()
    assert (report["documents_total"], report["documents_done"], report["documents_error"], report["items_total"]) == (6, 3, 3, 3)
    sinks.write_all({**got}, str(folder / "out"))
    assert spark.read.option("header", "true").csv(str(folder / "out/price_items.csv")).count() == 3


def test_scans(spark, tmp_path):
    """Files without enough text are read by the other extractor, which gets its options."""
    for name, text in {"said.pdf": "Blood test 1500 " * 9, "scan.pdf": "x", "none.pdf": "y", "bad.pdf": "z"}.items():
        (tmp_path / name).write_bytes(text.encode())

    def scan(content, dpi, max_pages):
        if content == b"z" or dpi != 300:
            raise ValueError("no image")
        return [(k, f"Scanned {'abc'[k - 1]} {k}000") for k in range(1, 4)] if content == b"x" else []

    options = ingest.Options(text_extractor=lambda content: [(1, content.decode())], scan_extractor=scan, ocr_dpi=300, max_ocr_pages=2)
    got = ingest.ingest(spark, str(tmp_path), options)
    documents = {r["file_name"]: (r["file_format"], r["parse_status"], r["parse_log"]) for r in got["documents"].collect()}
    assert documents["said.pdf"] == ("pdf", "done", "")
    assert documents["scan.pdf"][:2] == ("scan_pdf", "done")
    assert documents["none.pdf"] == ("scan_pdf", "error", "OCR PDF has no recognized price rows")
    assert documents["bad.pdf"] == ("scan_pdf", "error", "OCR error: no image")
    assert got["price_items"].where("service_name_raw LIKE 'Scanned%'").count() == 2


def test_sheets_in_the_order_of_the_workbook(spark):
    rows = [("d", k, title, 0, [title, " "]) for k, title in enumerate(("b", "table 10", "a"))]
    frame = spark.createDataFrame(rows, "doc_id string, sheet_no int, sheet string, row_pos int, cells array<string>")
    assert tables.raw_content(frame).first()["raw_content"] == "# b\nb\n# table 10\ntable 10\n# a\na"


def test_compatibility_forms_in_cells(spark):
    rows = [("d", "s", 0, ["Ｎ", "Ｎаименование", "Цена"]), ("d", "s", 1, ["Ａ１", "Анализ №\u00a0２", "1500"])]
    frame = spark.createDataFrame(rows, "doc_id string, sheet string, row_pos int, cells array<string>")
    got = tables.items_of_tables(spark.createDataFrame([("d", "s", 0, ["Ｃode", "наименование", "Цена"]), rows[1]], frame.schema)).first()
    assert (got["service_name_raw"], got["price_original"]) == ("Анализ No 2", 1500)
    assert tables.items_of_tables(spark.createDataFrame([("d", "s", 0, ["код", "наименование", "Цена"]), rows[1]], frame.schema)).first()["service_code_source"] == "A1"


def test_duplicates_within_a_document(spark):
    rows = [("1", "d", "p", "A", 1, None, 1, None), ("2", "e", "p", "a", 1, None, 1, None), ("3", "e", "p", "A", 1, None, 1, None)]
    items = spark.createDataFrame([tuple(Decimal(v) if isinstance(v, int) else v for v in r) for r in rows], ITEM)
    assert [r["doc_id"] for r in validate.issues(items).collect()] == ["e"]
    assert validate.duplicate_positions(items).first()["n"] == 3


def test_lemmas_in_matching(spark):
    lemmas = spark.createDataFrame([("анализы", "анализ"), ("почки", "почка"), ("почек", "почка")], "token string, lemma string")
    items = spark.createDataFrame([(1, "УЗИ почки", None), (2, "Общие анализы", None), (3, None, None)], "i int, service_name_raw string, service_code_source string")
    got = {r["i"]: r for r in matching.match(items, services(spark), lemmas=lemmas).collect()}
    assert (got[1]["service_id"], got[1]["method"], got[1]["normalized_name"]) == ("2", "exact", "ультразвуковое исследование почка")
    assert got[2]["normalized_name"] == "общие анализ" and got[3]["reason"] == "empty_name"


def test_streaming_ingest(spark, folder):
    query = incremental.start(spark, str(folder / "in"), str(folder / "tables"), str(folder / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(folder / "tables/documents")).count() == 6


def test_archive_names():
    assert archive.decode_name("#U041F#u0041.x") == "П#u0041.x"
    assert archive.safe_name("../a\\./b//c.pdf") == "a/b/c.pdf"
    assert list(archive.members(b"junk"))[0][2].startswith("archive")


def test_catalogue(spark):
    rows = spark.createDataFrame([(0, ["Name_ru", "code", "Синонимы"]), (1, ["Анализ", "A1", '["ОАК"; \'CBC\'|x]']), (2, [" ", "A2", None])], "row_pos int, cells array<string>")
    got = catalog.services(catalog.from_cells(rows), "row_pos").collect()
    assert [(r["service_name"], r["code"], r["synonyms"]) for r in got] == [("Анализ", "A1", ["ОАК", "CBC", "x"])]
