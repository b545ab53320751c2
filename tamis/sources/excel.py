"""Excel workbooks (.xlsx) as tables, read by Spark's tasks without another package: a workbook is a zip of XML files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise

#: Cells passed on at once.
CELLS = 200_000
# Number formats that are dates or times by their id, and the first day of both calendars.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
FIRST_DAY = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
_NOT_LETTERS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')
_CELL = "array<struct<kind: string, text: string>>"


def _name(element: Element) -> str:
    """A tag without its namespace."""
    return element.tag.rpartition("}")[2]


def _attribute(element: Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _parts(archive: zipfile.ZipFile, path: str, tag: str) -> Iterator[Element]:
    """The elements of that tag in a file of the archive, one after the other; none if it isn't there."""
    if path not in archive.namelist():
        return
    with archive.open(path) as file:
        for _, element in iterparse(file):
            if _name(element) == tag:
                yield element
                element.clear()


def _text(element: Element) -> str:
    """The text of a string item, its runs one after the other, without what tells how it is pronounced."""
    return "".join(t.text or "" for child in element for t in ([child] if _name(child) == "t" else child if _name(child) == "r" else []) if _name(t) == "t")


def _sheet(archive: zipfile.ZipFile, wanted: str | int) -> str:
    sheets = [(s.get("name"), _attribute(s, "id")) for s in _parts(archive, "xl/workbook.xml", "sheet")]
    found = [r for i, (n, r) in enumerate(sheets) if wanted in (i, n)]
    if not found:
        raise ValueError(f"there is no sheet {wanted!r}; there are {[n for n, _ in sheets]}")
    target = next(r.get("Target") for r in _parts(archive, "xl/_rels/workbook.xml.rels", "Relationship") if r.get("Id") == found[0])
    return target[1:] if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """Of each cell style, whether its number format is one of dates."""
    own = {int(f.get("numFmtId")): bool(re.search("[dmyhs]", _NOT_LETTERS.sub("", f.get("formatCode", "")).lower())) for f in _parts(archive, "xl/styles.xml", "numFmt")}
    out: list[bool] = []
    for styles in _parts(archive, "xl/styles.xml", "cellXfs"):
        out = [own.get(i, i in DATE_FORMATS) for i in (int(x.get("numFmtId", 0)) for x in styles)]
    return out


def _position(reference: str | None, before: int) -> int:
    """The number of a cell's column from its reference, as "AB7"; the next one without."""
    if not reference:
        return before + 1
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n - 1


def _value(cell: Element, shared: list[str], dates: list[bool], first_day: datetime) -> tuple[str, str] | None:
    """Kind and text of a cell: number, date, boolean or string; None for an empty one or an error."""
    kind, raw = cell.get("t", "n"), next((c.text for c in cell if _name(c) == "v"), None)
    if kind == "inlineStr":
        return "string", "".join(_text(c) for c in cell if _name(c) == "is")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return "string", shared[int(raw)]
    if kind == "b":
        return "boolean", "true" if raw.strip() == "1" else "false"
    if kind == "d":
        return "date", datetime.fromisoformat(raw).isoformat(sep=" ")
    if kind == "str":
        return "string", raw
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return "date", (first_day + timedelta(seconds=round(float(raw) * 86_400, 3))).isoformat(sep=" ")
    number = float(raw)
    return ("integer", str(int(number))) if number.is_integer() and abs(number) < 2**53 else ("number", repr(number))


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """Number and cells of each row of a workbook's sheet that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        path = _sheet(archive, sheet)
        later = any(w.get("date1904", "0") in ("1", "true") for w in _parts(archive, "xl/workbook.xml", "workbookPr"))
        shared = [_text(s) for s in _parts(archive, "xl/sharedStrings.xml", "si")]
        dates, number = _date_styles(archive), 0
        for row in _parts(archive, path, "row"):
            number = int(row.get("r", number + 1))
            cells: list[tuple[str, str] | None] = []
            at = -1
            for cell in row:
                at = _position(cell.get("r"), at)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(cell, shared, dates, FIRST_DAY[later])
            if any(cells):
                yield number, cells


def _batch(rows: list[tuple[str, int, list[Any]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    cells = [[None if c is None else {"kind": c[0], "text": c[1]} for c in cells] for _, _, cells in rows]
    return pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in rows], pa.string()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array(cells, kind)], ["file", "row", "cells"])


def _cells(sheet: str | int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held, size = [], 0
                for number, cells in sheet_rows(content, sheet):
                    held.append((file, number, cells))
                    size += len(cells)
                    if size >= CELLS:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return run


def _typed(cell: Column, kinds: set[str]) -> Column:
    """A column's cells in the type that all of them have; text if they have several."""
    text = cell["text"]
    if kinds <= {"integer"} and kinds:
        return text.cast("bigint")
    if kinds <= {"integer", "number"} and kinds:
        return text.cast("double")
    if kinds in ({"date"}, {"boolean"}):
        return text.cast("timestamp" if kinds == {"date"} else "boolean")
    return text


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A workbook's sheet, by name or number, as a table: the first row has the names, column types are those of all cells.

    path may be a folder or a pattern of workbooks with the same first row, in any store that Spark reads. A workbook is read by one task, as
    a zip can't be split; a sheet has a million rows at most. Errors and empty cells are null, empty rows are left out, and the order of rows is not kept.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = materialise(files.mapInArrow(_cells(sheet), f"file string, row bigint, cells {_CELL}"), "excel")
    tops = cells.groupBy("file").agg(F.min("row").alias("row"))
    # As many rows as workbooks.
    names = cells.join(F.broadcast(tops), ["file", "row"]).select(F.transform("cells", lambda c: c["text"]).alias("names")).distinct().limit(2).collect()
    if not names:
        return spark.createDataFrame([], "struct<>")
    if len(names) > 1:
        raise ValueError("the workbooks have different first rows")
    data = cells.join(F.broadcast(tops.withColumnRenamed("row", "top")), "file").where("row > top")
    found = data.select(F.posexplode("cells").alias("at", "cell")).where("cell is not null").groupBy("at").agg(F.collect_set("cell.kind").alias("kinds")).collect()
    kinds = {r["at"]: set(r["kinds"]) for r in found}
    width = max([len(names[0]["names"]), *(i + 1 for i in kinds)])
    labels = _labels([*names[0]["names"], *[None] * (width - len(names[0]["names"]))])
    return data.select(*(_typed(F.get("cells", F.lit(i)), kinds.get(i, set())).alias(n) for i, n in enumerate(labels)))


def _labels(names: list[str | None]) -> list[str]:
    """Names of columns, all different: those without get their number, repeated ones a count."""
    out: list[str] = []
    for i, n in enumerate(names):
        name, k = n if n not in (None, "") else f"column_{i + 1}", 1
        while name in out:
            name, k = f"{n}.{k}", k + 1
        out.append(name)
    return out
