"""Workbooks: written by the test, read back; types from cells and styles."""

import io
import zipfile
from datetime import datetime

from tidemark.sources import workbooks

ROWS = [["year", "note", "day", None, "n", "note"], [1999, "a <b> & é", datetime(2024, 2, 29), None, -1.5, "again"], [2000, "", datetime(1999, 12, 31, 12, 30), 7, None]]


def test_round_trip_through_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook(ROWS, "s & t"))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r.path[-6:], r.row, r.col): (r.sheet, r.kind, r.text if r.kind == "text" else r.time if r.kind == "time" else r.number) for r in workbooks.read_cells(files).collect() if r.kind != "unreadable"}
    want = {("a.xlsx", i, j): ("s & t", "text" if isinstance(v, str) else "time" if isinstance(v, datetime) else "number", v) for i, row in enumerate(ROWS, 1) for j, v in enumerate(row) if v is not None}
    assert got == want
    bad = workbooks.read_cells(files).where("kind = 'unreadable'").collect()
    assert len(bad) == 1 and bad[0].path.endswith("b.xlsx")
    recs = {r.row: r["values"] for r in workbooks.records(workbooks.read_cells(files)).collect()}
    assert recs[2] == {"year": "1999.0", "note": "a <b> & é", "day": "2024-02-29 00:00:00", "n": "-1.5"} and set(recs[3]) == {"year", "note", "day"}
    assert workbooks.read_cells(files.limit(0)).count() == 0


def test_odd_cells():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    raw = io.BytesIO(workbooks.workbook([["x"]]))
    out = io.BytesIO()
    sheet = f'<worksheet {ns}><sheetData><row><c r="AB3" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh><t>no</t></rPh></is></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>f</v></c><c s="1"/><c s="0"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(raw) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, sheet if n.endswith("sheet1.xml") else a.read(n).decode().replace("<sheets>", '<workbookPr date1904="1"/><sheets>'))
    got = [c[2:7] for c in workbooks.cells("p", out.getvalue())]
    assert got == [(1, 27, "text", "inline", None), (1, 28, "boolean", None, 1.0), (1, 29, "error", "#N/A", None), (1, 30, "text", "f", None), (1, 32, "number", None, 3.0)]
    assert workbooks.is_date("[$-409]d-mmm-yy") and not workbooks.is_date('0.00"days"') and not workbooks.is_date("#,##0;[Red]-#") and workbooks.column("AA1") == 26
