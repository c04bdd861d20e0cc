"""Excel workbooks (xlsx) as tables of texts: zipped XML, read a row at a time where the file's task is.

Cells are texts: numbers as they are stored, booleans as TRUE or FALSE, errors and absent cells as
null. The first row names the columns: a name that comes again gets .1, .2 and so on, an empty one is
`Unnamed: i`. Files of a folder are matched by column name; a column that a file lacks is null there.
Empty rows are left out. A workbook without the sheet raises; one without rows gives none.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 4096


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _said(element: ElementTree.Element) -> str:
    """Text of an element with runs; readings (rPh) are left out."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Path of the named sheet, or of the first one."""
    targets = {r.get("Id"): r.get("Target") or "" for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet" and sheet in (None, e.get("name")):
            target = targets[next(v for k, v in e.attrib.items() if _local(k) == "id" and "}" in k)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


def _place(reference: str) -> int:
    """Column of a cell's name: A1 is 0, AA1 is 26."""
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[dict[int, str | None]]:
    """Cells by column of each row that has any."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path = _sheet_path(book, sheet)
        shared = [_said(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        with book.open(path) as stream:
            for _, e in ElementTree.iterparse(stream):
                if _local(e.tag) != "row":
                    continue
                row, at = {}, -1
                for cell in e:
                    at = _place(cell.get("r") or "") if cell.get("r") else at + 1
                    kind, parts = cell.get("t"), {_local(x.tag): x for x in cell}
                    raw = parts["v"].text if "v" in parts else None
                    if kind == "inlineStr":
                        value = _said(parts["is"]) if "is" in parts else None
                    elif kind == "s":
                        value = None if raw is None else shared[int(raw)]
                    else:
                        value = None if kind == "e" else {"0": "FALSE", "1": "TRUE"}.get(raw or "", raw) if kind == "b" else raw
                    if value is not None:
                        row[at] = value
                e.clear()
                if row:
                    yield row


def _names(header: dict[int, str | None]) -> dict[int, str]:
    names: dict[int, str] = {}
    taken: dict[str, int] = {}
    for i in range(max(header, default=-1) + 1):
        name = header.get(i) or f"Unnamed: {i}"
        n = taken.get(name, 0)
        taken[name] = n + 1
        names[i] = f"{name}.{n}" if n else name
    return names


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All rows of a sheet (the first, or the one named) of one workbook or of a folder of them.

    `columns` saves the look at a first file for its names.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("content"):
                yield pa.record_batch([pa.array([list(_names(next(rows_of(c.as_py(), sheet), {})).values())], pa.list_(pa.string()))], names=["names"])

    if columns is None:
        columns = list(files.limit(1).mapInArrow(header, "names array<string>").first()["names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("content"):
                rows = rows_of(c.as_py(), sheet)
                place = {name: i for i, name in _names(next(rows, {})).items()}
                kept: list[dict[int, str | None]] = []
                for row in rows:
                    kept.append(row)
                    if len(kept) == ROWS_PER_BATCH:
                        yield table(kept, place)
                        kept = []
                if kept:
                    yield table(kept, place)

    def table(rows: list[dict[int, str | None]], place: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(place.get(c, -1)) for r in rows], pa.string()) for c in columns], names=columns)

    return files.mapInArrow(run, ", ".join(f"`{c.replace('`', '``')}` string" for c in columns))
