"""Cell values of workbooks as DataFrames, and DataFrames as workbooks."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The grid's limit.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
CELLS = "path string, sheet string, row int, col int, kind string, number double, text string, logical boolean, error string, formula string"
_TYPES = {"path": pa.string(), "sheet": pa.string(), "row": pa.int32(), "col": pa.int32(), "kind": pa.string(), "number": pa.float64(), "text": pa.string(), "logical": pa.bool_(), "error": pa.string(), "formula": pa.string()}


@dataclass(frozen=True)
class Limits:
    """What a package may hold; beyond, it is refused before it is unpacked."""

    archive: int = 128 << 20
    entries: int = 10_000
    entry: int = 64 << 20
    total: int = 256 << 20
    ratio: int = 1000


def _checked(raw: bytes, limits: Limits) -> zipfile.ZipFile:
    if len(raw) > limits.archive:
        raise ValueError("the package is larger than allowed")
    z = zipfile.ZipFile(io.BytesIO(raw))
    infos = z.infolist()
    if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total:
        raise ValueError("the package has more content than allowed")
    for i in infos:
        if i.file_size > limits.entry or i.file_size > limits.ratio * max(1, i.compress_size):
            raise ValueError(f"{i.filename} unpacks to more than allowed")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def _string(e: ElementTree.Element) -> str:
    """Text of a shared or inline string: its runs without phonetic ones."""
    out = []
    for child in e:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def place(reference: str) -> tuple[int, int]:
    """(row, column) of an A1 reference."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([1-9][0-9]*)", reference)
    if not m:
        raise ValueError(f"{reference!r} is no cell")
    col = 0
    for c in m[1]:
        col = 26 * col + ord(c) - 64
    if col > MAX_COLUMNS or int(m[2]) > MAX_ROWS:
        raise ValueError(f"{reference} is outside the grid")
    return int(m[2]), col


def column_letters(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the worksheets in tab order."""
    links = {e.get("Id"): e.get("Target", "") for e in _tree(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for e in _tree(z, "xl/workbook.xml").iter():
        if _local(e.tag) == "sheet":
            target = links[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "id")]
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return [(n, p) for n, p in out if p in z.namelist()]


def _cell(e: ElementTree.Element, shared: list[str]) -> dict:
    """The value of a cell element by its type; an unknown type is refused."""
    parts = {_local(c.tag): c for c in e}
    raw = parts["v"].text if "v" in parts else None
    kind = e.get("t", "n")
    out: dict = {"formula": parts["f"].text if "f" in parts else None}
    if kind == "inlineStr":
        out |= {"kind": "text", "text": _string(parts["is"]) if "is" in parts else ""}
    elif raw is None:
        out["kind"] = "blank"
    elif kind == "n":
        out |= {"kind": "number", "number": float(raw)}
    elif kind == "b":
        out |= {"kind": "logical", "logical": raw.strip() in ("1", "true")}
    elif kind == "e":
        out |= {"kind": "error", "error": raw}
    elif kind == "s":
        out |= {"kind": "text", "text": shared[int(raw)]}
    elif kind in ("str", "d"):
        out |= {"kind": "date" if kind == "d" else "text", "text": raw}
    else:
        raise ValueError(f"unknown cell type {kind!r}")
    return out


def _rows(path: str, raw: bytes, limits: Limits) -> Iterator[dict]:
    z = _checked(raw, limits)
    shared = [_string(e) for e in _tree(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    for sheet, part in _sheets(z):
        row = 0
        for e in _tree(z, part).iter():
            if _local(e.tag) != "row":
                continue
            row, col = int(e.get("r", row + 1)), 0
            for c in e:
                if _local(c.tag) == "c":
                    row, col = place(c.get("r")) if c.get("r") else (row, col + 1)
                    found = _cell(c, shared)
                    if found["kind"] != "blank" or found["formula"]:
                        yield {"path": path, "sheet": sheet, "row": row, "col": col, **found}


def read_cells(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """One row per cell with a value or formula of every workbook below ``path``.

    kind is number, text, logical, error, date or blank (a formula without a cached value). A
    workbook is one task's work, at most ``limits`` large; many workbooks are read in parallel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _TYPES.items()], list(_TYPES))

        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content")):
                rows: list[dict] = []
                for r in _rows(name, raw.as_py(), limits):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, CELLS)


def read_table(cells: DataFrame, sheet: str, columns: dict[str, tuple[int, str]], header_rows: int = 1) -> DataFrame:
    """A sheet's cells as a table (path, row, columns): ``columns`` maps a name to its column number and
    the field that holds its values, such as number or text."""
    body = cells.filter((F.col("sheet") == sheet) & (F.col("row") > header_rows))
    return body.groupBy("path", "row").agg(*[F.max(F.when(F.col("col") == i, F.col(field))).alias(n) for n, (i, field) in columns.items()])


def _xml(value, reference: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


_NS = "http://schemas.openxmlformats.org"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _package(names: list[str], rows: list[list], sheet: str) -> bytes:
    lines = [names, *rows]
    body = "".join(f'<row r="{i}">{"".join(_xml(v, f"{column_letters(j)}{i}") for j, v in enumerate(r, 1))}</row>' for i, r in enumerate(lines, 1))
    main, rel = f"{_NS}/spreadsheetml/2006/main", f"{_NS}/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, _HEAD + xml)
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, sheet: str = "Sheet1", rows: int = 100_000) -> DataFrame:
    """Writes ``df`` as workbooks of at most ``rows`` rows below ``folder``; returns (path, rows) when run.

    Each task writes its own files under a name of its partition, moved into place whole, so a
    repeated attempt replaces what it wrote. Columns are numbers, logicals or texts; others are
    cast to text. ``folder`` is a URI that all executors can write to.
    """
    if rows >= MAX_ROWS or len(df.columns) > MAX_COLUMNS:
        raise ValueError("a sheet can't hold so much")
    plain = {"byte", "short", "int", "integer", "long", "bigint", "smallint", "tinyint", "float", "double", "boolean", "string"}
    df = df.select(*[F.col(c) if k in plain else F.col(c).cast("string").alias(c) for c, k in df.dtypes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        part, done, held = TaskContext.get().partitionId(), [], []

        def flush() -> None:
            name = f"{root}/part-{part:05d}-{len(done):03d}.xlsx"
            with fs.open_output_stream(temp := f"{root}/_tmp-{uuid.uuid4().hex}") as out:
                out.write(_package(names, held, sheet))
            fs.move(temp, name)
            done.append((name, len(held)))
            held.clear()

        for b in batches:
            names = b.schema.names
            for r in zip(*(c.to_pylist() for c in b.columns)):
                held.append(r)
                if len(held) == rows:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "rows"])

    return df.mapInArrow(run, "path string, rows long")
