"""Workbooks: cells of every sheet as rows, typed by their cell types and styles.

Files come as rows (path, content), as Spark's binaryFile reader gives them; a file is read by one
task, its sheets row by row, so that only shared strings and one batch of cells are held. A number
whose style is a date is a time; days count from 1899-12-30, or from 1904-01-01 where the workbook
says so. Empty cells are left out; a file that is no workbook is one row that says why.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.plans.steps import written
from tidemark.sources.analogues import table

CELLS = "path string, sheet string, row int, col int, kind string, text string, number double, time timestamp_ntz"
#: Built-in number formats that are dates or times.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
BATCH = 5000


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(z: zipfile.ZipFile, name: str) -> Iterator[ET.Element]:
    """Elements of a part as they end; each is emptied once it has been seen."""
    if name in z.namelist():
        with z.open(name) as f:
            for _, e in ET.iterparse(f):
                yield e


def text_of(e: ET.Element) -> str:
    """The runs of a string, without phonetic hints."""
    return "".join(t.text or "" for p in e if local(p.tag) != "rPh" for t in ([p] if local(p.tag) == "t" else p) if local(t.tag) == "t")


def is_date(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.split(";")[0].lower())))


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    custom, out = {}, set()
    for e in children(z, "xl/styles.xml"):
        if local(e.tag) == "numFmt":
            custom[int(e.get("numFmtId"))] = e.get("formatCode", "")
        elif local(e.tag) == "cellXfs":
            kinds = [int(x.get("numFmtId", 0)) for x in e]
            out = {k for k, n in enumerate(kinds) if (is_date(custom[n]) if n in custom else n in DATES)}
    return out


def column(ref: str) -> int:
    """A of A1 is 0."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def cells(path: str, content: bytes) -> Iterator[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = [text_of(e) for e in children(z, "xl/sharedStrings.xml") if local(e.tag) == "si"]
    targets = {e.get("Id"): e.get("Target", "") for e in children(z, "xl/_rels/workbook.xml.rels") if local(e.tag) == "Relationship"}
    dates, sheets, start = date_styles(z), [], datetime(1899, 12, 30)
    for e in children(z, "xl/workbook.xml"):
        if local(e.tag) == "sheet":
            sheets.append((e.get("name"), next(v for k, v in e.attrib.items() if local(k) == "id" and k != "id")))
        elif local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true"):
            start = datetime(1904, 1, 1)
    for name, rel in sheets:
        target = targets[rel]
        at, row = target.lstrip("/") if target.startswith("/") else f"xl/{target}", 0
        for e in children(z, at):
            if local(e.tag) != "row":
                continue
            row = int(e.get("r", row + 1))
            col = -1
            for c in e:
                col = column(c.get("r")) if c.get("r") else col + 1
                kind, v = c.get("t", "n"), next((x.text for x in c if local(x.tag) == "v"), None)
                if kind == "inlineStr":
                    v = "".join(text_of(x) for x in c if local(x.tag) == "is")
                if v is None:
                    continue
                if kind == "s":
                    yield path, name, row, col, "text", shared[int(v)], None, None
                elif kind in ("str", "inlineStr", "e"):
                    yield path, name, row, col, "error" if kind == "e" else "text", v, None, None
                elif kind == "b":
                    yield path, name, row, col, "boolean", None, float(v), None
                elif kind == "d":
                    yield path, name, row, col, "time", None, None, datetime.fromisoformat(v)
                elif int(c.get("s", 0)) in dates:
                    yield path, name, row, col, "time", None, float(v), start + timedelta(microseconds=round(float(v) * 86_400_000_000))
                else:
                    yield path, name, row, col, "number", None, float(v), None
            e.clear()


def read_cells(files: DataFrame) -> DataFrame:
    """files: (path, content). Rows (path, sheet, row, col, kind, text, number, time)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    for c in cells(path, bytes(content)):
                        out.append(c)
                        if len(out) == BATCH:
                            yield framed(out)
                            out = []
                except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
                    out.append((path, None, None, None, "unreadable", str(e)[:200], None, None))
                yield framed(out)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "kind", "text", "number", "time"])
        return df.astype({"row": "Int32", "col": "Int32", "number": "float64", "time": "datetime64[us]"})

    return files.select("path", "content").mapInPandas(scan, CELLS)


def records(found: DataFrame, header: int = 1) -> DataFrame:
    """Cells as maps (path, sheet, row, values) from the header row's names to what the cells say as text; columns without a name are left out, and of columns with one name all but the first. Files are read once: their cells are written, and so are the header rows, whose size tells Spark whether they are few."""
    found = written(found, "cells")
    says = F.coalesce("text", F.col("time").cast("string"), F.col("number").cast("string"))
    heads = written(found.where(F.col("row") == header).groupBy("path", "sheet", says.alias("name")).agg(F.min("col").alias("col")), "heads")
    body = found.where(F.col("row") > header).select("path", "sheet", "row", "col", says.alias("says")).join(heads, ["path", "sheet", "col"])
    return body.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "says")))).alias("values"))


def workbook(rows: list[list], sheet: str = "data") -> bytes:
    """A small workbook of one sheet: strings are shared, dates have a date style, None is no cell."""
    from xml.sax.saxutils import escape, quoteattr

    strings: dict[str, int] = {}
    lines = []
    for r, values in enumerate(rows, 1):
        out = []
        for v in values:
            if v is None:
                out.append("<c/>")
            elif isinstance(v, str):
                out.append(f'<c t="s"><v>{strings.setdefault(v, len(strings))}</v></c>')
            elif isinstance(v, datetime):
                out.append(f'<c s="1"><v>{(v - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>')
            else:
                out.append(f"<c><v>{v!r}</v></c>")
        lines.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {ns}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in strings)}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>",
    }
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


@query("src_xlsx", "SELECT o_orderkey AS key, o_orderpriority AS priority, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day FROM orders")
def src_xlsx(spark, sf_dir):
    """Orders, written as workbooks of 2000 rows at most, read back cell by cell."""
    o = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 2000").alias("book"), "o_orderkey", "o_orderpriority", "o_totalprice", F.expr("cast(o_orderdate AS timestamp_ntz)").alias("day"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [["key", "priority", "price", "day"], *([int(k), p, float(x), d.to_pydatetime()] for k, p, x, d in zip(pdf["o_orderkey"], pdf["o_orderpriority"], pdf["o_totalprice"], pdf["day"]))]
        return pd.DataFrame({"path": [f"book-{pdf['book'].iat[0]}.xlsx"], "content": [workbook(rows)]})

    books = o.groupBy("book").applyInPandas(write, "path string, content binary")  # a book's keys are 2000 at most
    v = F.col("values")
    return records(read_cells(books)).select(v["key"].cast("double").cast("long").alias("key"), v["priority"].alias("priority"), v["price"].cast("double").alias("price"), F.to_date(F.substring(v["day"], 1, 10)).alias("day"))
