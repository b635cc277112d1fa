import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.sources import workbook as wb


def test_round_trip(spark, tmp_path):
    rows = [(1, 2.5, "a < b & \"c\"", True), (2, None, " space ", False), (3, -1e20, "é\n日", None)]
    df = spark.createDataFrame(rows, "k int, x double, s string, b boolean").coalesce(1)
    assert [r.rows for r in wb.write_workbooks(df, str(tmp_path), rows=2).collect()] == [2, 1]
    cells = wb.read_cells(spark, str(tmp_path))
    got = wb.read_table(cells, "Sheet1", {"k": (1, "number"), "x": (2, "number"), "s": (3, "text"), "b": (4, "logical")})
    assert sorted((int(r.k), r.x, r.s, r.b) for r in got.collect()) == rows
    assert cells.filter((F.col("row") == 1) & (F.col("kind") == "text")).count() == 8


def sheet(tmp_path, cells, shared=""):
    base = wb._package([], [], "S")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            if not n.endswith("sheet1.xml"):
                new.writestr(n, old.read(n))
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData><row r="2">{cells}</row></sheetData></worksheet>')
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="x">{shared}</sst>')
    (tmp_path / "f.xlsx").write_bytes(out.getvalue())
    return str(tmp_path)


def test_cell_kinds(spark, tmp_path):
    cells = '<c r="A2" t="s"><v>1</v></c><c r="B2"><v>.5</v></c><c t="b"><v>1</v></c><c r="D2" t="e"><v>#N/A</v></c><c r="E2" t="str"><f>A2&amp;"x"</f><v>yx</v></c><c r="F2" t="d"><v>2024-01-02</v></c><c r="G2"/><c r="AA2"><f>1+1</f></c>'
    got = wb.read_cells(spark, sheet(tmp_path, cells, "<si><t>no</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si>")).orderBy("col").collect()
    assert [(r.row, r.col, r.kind) for r in got] == [(2, 1, "text"), (2, 2, "number"), (2, 3, "logical"), (2, 4, "error"), (2, 5, "text"), (2, 6, "date"), (2, 27, "blank")]
    assert got[0].text == "rich" and got[1].number == 0.5 and got[2].logical and got[3].error == "#N/A" and got[4].formula == 'A2&"x"' and got[6].formula == "1+1"


def test_limits_and_unknown_types_are_refused(tmp_path):
    raw = (tmp_path / "f.xlsx") if sheet(tmp_path, '<c r="A1" t="zz"><v>1</v></c>') else None
    with pytest.raises(ValueError, match="unknown cell type"):
        list(wb._rows("f", raw.read_bytes(), wb.Limits()))
    with pytest.raises(ValueError):
        list(wb._rows("f", raw.read_bytes(), wb.Limits(archive=10)))
    with pytest.raises(ValueError):
        wb.place("XFE1")
    assert wb.place("AA10") == (10, 27) and wb.column_letters(27) == "AA"
