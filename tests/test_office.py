"""Typed cells of workbooks and merged cells of word-processor tables, down to their items."""

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest

from tarifflow.plans import ingest
from tarifflow.sources import office

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Styles: plain, a built-in date, a date of its own, a currency with quoted and bracketed letters, a duration, a percentage, time of day.
FORMATS = {164: "dd.mm.yyyy", 165: '#,##0.00\\ "дней" [$USD-409];[Red]-#,##0.00', 166: "[hh]:mm:ss"}
STYLES = (0, 14, 164, 165, 166, 9, 21)


def workbook(rows, epoch_1904=False):
    """rows of (text, kind, style)."""
    cell = lambda r, c, x: f'<c r="{chr(65 + c)}{r}" t="{x[1]}" s="{x[2]}">' + (f"<is><t>{x[0]}</t></is>" if x[1] == "inlineStr" else f"<v>{x[0]}</v>") + "</c>"
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, x) for c, x in enumerate(row) if x) + "</row>" for r, row in enumerate(rows, 1))
    formats = "".join(f'<numFmt numFmtId="{k}" formatCode="{v.replace(chr(34), "&quot;")}"/>' for k, v in FORMATS.items())
    styles = f'<styleSheet xmlns="{MAIN}"><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in STYLES) + "</cellXfs></styleSheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(epoch_1904)}"/><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@pytest.mark.parametrize(
    ("text", "kind", "style", "want"),
    [
        ("1.5E4", "n", 0, "15000.0"),
        ("1500", "n", 0, "1500"),
        ("1500.50", "n", 3, "1500.5"),
        ("0.25", "n", 5, "0.25"),
        ("45658", "n", 1, "2025-01-01 00:00:00"),
        ("45658.75", "n", 2, "2025-01-01 18:00:00"),
        ("59", "n", 1, "1900-02-28 00:00:00"),
        ("61", "n", 1, "1900-03-01 00:00:00"),
        ("0.5", "n", 6, "12:00:00"),
        ("1.5", "n", 4, "1 day, 12:00:00"),
        ("1e300", "n", 1, office.NO_DATE),
        ("#N/A", "e", 0, "#N/A"),
        ("7 500", "str", 0, "7 500"),
        ("1", "b", 0, "True"),
        ("2025-03-04", "d", 0, "2025-03-04"),
        ("2025-03-04T05:06:07Z", "d", 0, "2025-03-04 05:06:07"),
        ("05:06:07", "d", 0, "05:06:07"),
    ],
)
def test_cell_values(text, kind, style, want):
    assert list(office.workbook_rows(workbook([[(text, kind, style)]]))) == [("s", 0, [want])]


def test_the_other_calendar():
    assert list(office.workbook_rows(workbook([[("0", "n", 4), ("1", "n", 1)]], epoch_1904=True))) == [("s", 0, ["0:00:00", "1904-01-02 00:00:00"])]


@pytest.mark.parametrize(("code", "want"), [("General", None), ("0.00E+00", None), ("[Red]0", None), ('0"d"', None), ("0\\d", None), ("yyyy;0", "date"), ("0;yyyy", None), ("mm:ss", "date"), ("[mm]:ss", "duration"), ("[$-419]D MMMM", "date"), ("_d0*y", None)])
def test_formats(code, want):
    assert office.shown_as(200, code) == want


def test_items_of_typed_cells(spark, tmp_path):
    said = lambda t: (t, "inlineStr", 0)
    rows = [
        [said("Код"), said("Наименование услуги"), said("Цена, резидент"), said("Цена, нерезидент")],
        [("101", "n", 0), said("Анализ"), ("1.5E4", "n", 0), ("2E4", "n", 3)],
        [("102.0", "n", 0), said("Осмотр"), ("45658", "n", 1), ("46000", "n", 2)],
        [said("A3"), said("Прием"), ("#REF!", "e", 0), ("1234.5", "n", 3)],
        [said("A4"), said("Массаж"), ("2025-01-01", "d", 0), ("0", "n", 0)],
        [said("A5"), said("Уколы"), ("0", "b", 0), ("300", "str", 0)],
    ]
    (tmp_path / "typed.xlsx").write_bytes(workbook(rows))
    got = {r["service_name_raw"]: (r["service_code_source"], r["price_resident_kzt"], r["price_nonresident_kzt"], r["source_row"]) for r in ingest.ingest(spark, str(tmp_path))["price_items"].collect()}
    # the l of False is read as a 1, as everywhere in prices
    assert got == {"Анализ": ("101", Decimal(15000), Decimal(20000), 2), "Прием": ("A3", None, Decimal("1234.5"), 4), "Уколы": ("A5", Decimal(1), Decimal(300), 6)}


def cell(text, span=1, merge=None):
    about = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ({None: "", "restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>", "said": '<w:vMerge w:val="continue"/>'}[merge])
    return f"<w:tc><w:tcPr>{about}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def document(*tables):
    row = lambda cells: f"<w:tr><w:trPr>{cells[0]}</w:trPr>{''.join(cells[1:])}</w:tr>" if cells[0].startswith("<w:grid") else f"<w:tr>{''.join(cells)}</w:tr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>' + "".join("<w:tbl>" + "".join(map(row, t)) + "</w:tbl>" for t in tables) + "</w:body></w:document>")
    return out.getvalue()


def test_merged_cells():
    table = [
        [cell("Группа", merge="restart"), cell("Наименование", 2, "restart"), cell("Цена")],
        [cell("", merge="continue"), cell("", 2, "said"), cell("тенге")],
        [cell("Анализы", merge="restart"), cell("Кровь"), cell("общий", merge="restart"), cell("1500")],
        [cell("ignored", merge="continue"), cell("Моча"), cell("", merge="continue"), cell("700")],
        [cell("", merge="continue"), cell("Мазок"), cell("особый", merge="restart"), cell("900")],
        ['<w:gridBefore w:val="1"/>', cell("Сыворотка"), cell("", merge="continue"), cell("950")],
        [cell("", merge="continue"), cell("Прочее"), cell("x"), cell("1")],
    ]
    got = [c for _, _, c in office.document_rows(document(table, [[cell("own", merge="continue")]]))]
    assert got == [
        ["Группа", "Наименование", "Наименование", "Цена"],
        ["Группа", "Наименование", "Наименование", "тенге"],
        ["Анализы", "Кровь", "общий", "1500"],
        ["Анализы", "Моча", "общий", "700"],
        ["Анализы", "Мазок", "особый", "900"],
        ["Сыворотка", "особый", "950"],
        ["", "Прочее", "x", "1"],
        ["own"],
    ]


def test_items_of_merged_cells(spark, tmp_path):
    table = [
        [cell("Код"), cell("Наименование услуги", 2), cell("Стоимость", 2)],
        [cell("B1"), cell("Осмотр врача", 2, "restart"), cell("1000", merge="restart"), cell("первый")],
        [cell("B2"), cell("", 2, "continue"), cell("", merge="continue"), cell("второй")],
        [cell("B3"), cell("", 2, "continue"), cell("2500"), cell("третий")],
        [cell("B4"), cell("Массаж", 2), cell("", merge="continue"), cell("нет цены выше")],
    ]
    (tmp_path / "merged.docx").write_bytes(document(table))
    got = sorted((r["service_code_source"], r["service_name_raw"], r["price_original"], r["source_row"]) for r in ingest.ingest(spark, str(tmp_path))["price_items"].collect())
    assert got == [("B1", "Осмотр врача", Decimal(1000), 2), ("B2", "Осмотр врача", Decimal(1000), 3), ("B3", "Осмотр врача", Decimal(2500), 4), ("B4", "Массаж", Decimal(2500), 5)]


def test_dates_are_no_prices():
    assert office.date_text(45658, "date", office.EPOCHS["1900"]) == str(dt.datetime(2025, 1, 1))
