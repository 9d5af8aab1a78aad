"""Cells of workbooks and word-processor tables, and lines of documents, from file contents.

Workbooks and word-processor documents are zipped XML and read with the standard
library.  Text of PDF files comes from an extractor that the caller gives; without one,
as for old .xls files, a document has an error that says so.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "doc_id string, sheet_no int, sheet string, row_pos int, cells array<string>, error string"
LINES = "doc_id string, page int, line_no int, text string, error string"
XLS_ERROR = "Cannot read .xls: install xlrd or LibreOffice"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_COLUMN = re.compile("[A-Z]+")

#: Built-in number formats that show a date or a time, and the one that shows a duration.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
DURATION_FORMATS = (46,)
#: What a format shows as it stands: quoted, escaped, spaced or filled characters, and brackets other than [h], [m], [s].
_LITERAL = re.compile(r'"[^"]*"|\\.|[_*].|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)
_DURATION = re.compile(r"\[(h+|m+|s+)\]", re.IGNORECASE)
#: Day 0 of both calendars; the first counts a 29 February 1900 that never was.
EPOCHS = {"1900": dt.datetime(1899, 12, 30), "1904": dt.datetime(1904, 1, 1)}
NO_DATE = "#VALUE!"


def _column(reference: str) -> int:
    n = 0
    for c in _COLUMN.match(reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def shown_as(number: int, code: str | None) -> str | None:
    """date, duration or None (a number) of a format's number and, if it isn't built in, its code."""
    if code is None:
        return "duration" if number in DURATION_FORMATS else "date" if number in DATE_FORMATS else None
    first = _LITERAL.sub("", code.split(";")[0])
    return "duration" if _DURATION.search(first) else "date" if re.search("[dmyhs]", first, re.IGNORECASE) else None


def style_kinds(content: bytes) -> list[str | None]:
    """What each cell style shows its numbers as."""
    root = ElementTree.fromstring(content)
    codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    used = root.find(f"{_MAIN}cellXfs")
    numbers = [] if used is None else [int(x.get("numFmtId") or 0) for x in used.findall(f"{_MAIN}xf")]
    return [shown_as(n, codes.get(n)) for n in numbers]


def date_text(serial: float, kind: str, epoch: dt.datetime) -> str:
    """A serial number as the date, time of day or duration that it stands for; as an error if it stands for none."""
    days, part = divmod(serial, 1)
    rest = dt.timedelta(milliseconds=round(part * 86_400_000))
    try:
        if kind == "duration":
            return str(dt.timedelta(days=days) + rest)
        if 0 <= serial < 1 and not rest.days:
            return str((dt.datetime.min + rest).time())
        if 0 < serial < 60 and epoch == EPOCHS["1900"]:
            days += 1
        return str(epoch + dt.timedelta(days=days) + rest)
    except OverflowError:
        return NO_DATE


def iso_text(text: str) -> str:
    """A date, time of day or both in ISO form, as text of the value."""
    for kind in (dt.date, dt.time, dt.datetime):
        try:
            return str(kind.fromisoformat(text.removesuffix("Z")))
        except ValueError:
            continue
    raise ValueError(f"no date: {text}")


def cell_text(kind: str, text: str, shown: str | None, strings: list[str], epoch: dt.datetime) -> str:
    """The text of a cell's value: numbers as numbers, whatever their notation in the file, and dates by their format."""
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return str(bool(int(text)))
    if kind == "d":
        return iso_text(text)
    if kind != "n":  # strings of formulas, errors
        return text
    number = float(text) if re.search("[.eE]", text) else int(text)
    return str(number) if shown is None else date_text(number, shown, epoch)


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of every sheet, values only; rows left out of the file are empty."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    strings = []
    if "xl/sharedStrings.xml" in names:
        strings = [_text(s) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    kinds = style_kinds(archive.read("xl/styles.xml")) if "xl/styles.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    about = book.find(f"{_MAIN}workbookPr")
    epoch = EPOCHS["1904" if about is not None and about.get("date1904") in ("1", "true") else "1900"]
    for sheet in book.iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        place = 0
        for _, row in ElementTree.iterparse(io.BytesIO(archive.read(target if target.startswith("xl/") else f"xl/{target}"))):
            if row.tag != f"{_MAIN}row":
                continue
            at = int(row.get("r") or place + 1) - 1
            for k in range(place, at):
                yield sheet.get("name"), k, []
            place, cells = at + 1, []
            for cell in row.iter(f"{_MAIN}c"):
                k = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (k - len(cells))
                kind, value, style = cell.get("t") or "n", cell.find(f"{_MAIN}v"), int(cell.get("s") or 0)
                if kind == "inlineStr":
                    cells.append(_text(cell))
                elif value is None or not value.text:
                    cells.append(None)
                else:
                    cells.append(cell_text(kind, value.text, kinds[style] if style < len(kinds) else None, strings, epoch))
            yield sheet.get("name"), at, cells
            row.clear()


def _paragraph(node) -> str:
    return "".join({f"{_WORD}t": n.text or "", f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}.get(n.tag, "") for n in node.iter())


def _body(content: bytes):
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")


def _number(node, path: str, default: int) -> int:
    found = node.find("/".join(f"{_WORD}{p}" for p in path.split("/")))
    return default if found is None else int(found.get(f"{_WORD}val") or default)


def document_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row from 0, cells) of every table of the body.

    A cell over several columns counts for each; one that goes on from the row above has that row's cell, with its columns.
    """
    for number, table in enumerate(_body(content).findall(f"{_WORD}tbl")):
        above: dict[int, tuple[str, int]] = {}
        for k, row in enumerate(table.findall(f"{_WORD}tr")):
            cells, at, here = [], _number(row, "trPr/gridBefore", 0), {}
            for cell in row.findall(f"{_WORD}tc"):
                span, merge = _number(cell, "tcPr/gridSpan", 1), cell.find(f"{_WORD}tcPr/{_WORD}vMerge")
                held = "\n".join(_paragraph(p) for p in cell.findall(f"{_WORD}p")), span
                if merge is not None and merge.get(f"{_WORD}val", "continue") == "continue":
                    held = above.get(at, held)
                here[at] = held
                cells += [held[0]] * held[1]
                at += span
            above = here
            yield f"table {number + 1}", k, cells


def document_paragraphs(content: bytes) -> list[str]:
    return [_paragraph(p) for p in _body(content).findall(f"{_WORD}p")]


def paragraph_lines(content: bytes) -> Iterator[tuple[int, str]]:
    """(1, paragraph as one line) for `read_lines`."""
    return ((1, " ".join(p.split())) for p in document_paragraphs(content))


READERS = {"xlsx": workbook_rows, "docx": document_rows}


def read_cells(files: DataFrame) -> DataFrame:
    """(doc_id, sheet, row_pos, cells, error) of workbooks and word-processor documents; a file that can't be read has one row with the error."""

    def run(batches):
        for batch in batches:
            for doc, kind, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, error = [], None
                try:
                    if kind == "xls":
                        raise ValueError(XLS_ERROR)
                    rows = list(READERS[kind](content))
                except (ValueError, KeyError, IndexError, AttributeError, TypeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows, error = [], str(e) or type(e).__name__
                n = len(rows) + (error is not None)
                order: dict[str, int] = {}
                for name, _, _ in rows:
                    order.setdefault(name, len(order))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": [doc] * n,
                        "sheet_no": pa.array([order[s] for s, _, _ in rows] + [None] * (error is not None), pa.int32()),
                        "sheet": pa.array([s for s, _, _ in rows] + [None] * (error is not None), pa.string()),
                        "row_pos": pa.array([k for _, k, _ in rows] + [None] * (error is not None), pa.int32()),
                        "cells": pa.array([c for _, _, c in rows] + [None] * (error is not None), pa.list_(pa.string())),
                        "error": pa.array([None] * len(rows) + [error] * (error is not None), pa.string()),
                    }
                )

    wanted = files.where(F.col("content").isNotNull() & F.col("file_format").isin("xlsx", "xls", "docx"))
    return wanted.select("doc_id", "file_format", "content").mapInArrow(run, CELLS)


Extractor = Callable[[bytes], Iterable[tuple[int, str]]]


def read_lines(files: DataFrame, extractor: Extractor | None = None, formats=("pdf",), unavailable: str = "no text extractor for this format") -> DataFrame:
    """(doc_id, page, line_no, text, error) through an extractor that gives (page, text) of a content."""

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, error = [], None if extractor else unavailable
                if extractor:
                    try:
                        lines = [(page, line) for page, text in extractor(content) for line in text.splitlines()]
                    except Exception as e:  # noqa: BLE001  whatever the extractor raises is the document's error
                        error = str(e) or type(e).__name__
                n, more = len(lines), error is not None
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": [doc] * (n + more),
                        "page": pa.array([p for p, _ in lines] + [None] * more, pa.int32()),
                        "line_no": pa.array([*range(1, n + 1)] + [None] * more, pa.int32()),
                        "text": pa.array([t for _, t in lines] + [None] * more, pa.string()),
                        "error": pa.array([None] * n + [error] * more, pa.string()),
                    }
                )

    return files.where(F.col("content").isNotNull() & F.col("file_format").isin(*formats)).select("doc_id", "content").mapInArrow(run, LINES)
