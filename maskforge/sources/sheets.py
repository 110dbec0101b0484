"""Spreadsheets of reports: one sheet of plain cells in an Office Open XML file.

A sheet is a report for readers, so it is a file of the driver's; its rows are streamed
through the driver, and a sheet has at most ``MAX_ROWS`` of them by the format.
"""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: The parts of a file with one sheet besides the sheet itself.
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets><sheet name="report" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATION}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(value) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = ";".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))}</t></is></c>'


def write_sheet(df: DataFrame, path: str) -> int:
    """Writes column names and rows in order of the DataFrame; the number of rows. Arrays are joined with ``;``; nulls and numbers that aren't finite are empty cells."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in PARTS.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            line = lambda cells: sheet.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())
            sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            line(df.columns)
            for n, row in enumerate(df.toLocalIterator(), 1):
                if n >= MAX_ROWS:
                    raise ValueError(f"a sheet has at most {MAX_ROWS} rows")
                line(row)
            sheet.write(b"</sheetData></worksheet>")
    return n


def _rows(book: zipfile.ZipFile) -> Iterator[dict[int, object]]:
    """Rows of the first sheet, as values by column number."""
    tag = lambda name: f"{{{MAIN}}}{name}"
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in item.iter(tag("t"))) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(tag("si"))]
    first = min((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    with book.open(first) as sheet:
        for _, row in ElementTree.iterparse(sheet):
            if row.tag != tag("row"):
                continue
            out, place = {}, -1
            for cell in row.iter(tag("c")):
                place = _column(cell.get("r")) if cell.get("r") else place + 1
                kind, value = cell.get("t"), cell.find(tag("v"))
                if kind == "inlineStr":
                    out[place] = "".join(t.text or "" for t in cell.iter(tag("t")))
                elif value is not None and value.text is not None:
                    out[place] = shared[int(value.text)] if kind == "s" else bool(int(value.text)) if kind == "b" else value.text if kind in ("str", "e") else float(value.text)
            yield out
            row.clear()


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, its first row as column names. Numbers are double; a column with any text is string."""
    with zipfile.ZipFile(path) as book:
        rows = list(_rows(book))
    names = [str(rows[0].get(i, f"_{i}")) for i in range(max(rows[0]) + 1)] if rows and rows[0] else []
    if not names:
        raise ValueError(f"{path} has no column names")
    values = [[r.get(i) for i in range(len(names))] for r in rows[1:]]
    kinds = []
    for i in range(len(names)):
        seen = {type(r[i]) for r in values} - {type(None)}
        kinds.append("boolean" if seen == {bool} else "double" if seen == {float} else "string")
    typed = [[v if v is None or k != "string" else str(v) for v, k in zip(r, kinds, strict=True)] for r in values]
    return spark.createDataFrame(typed, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True)))


def read_sheets(spark: SparkSession, paths: dict[str, str], value: str = "value") -> DataFrame:
    """Several sheets of like columns under each other, with the key of each in the column ``value``."""
    parts = [read_sheet(spark, path).withColumn(value, F.lit(key)) for key, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)
