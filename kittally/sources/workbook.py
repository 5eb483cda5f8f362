"""Workbooks into cells: one row per non-empty cell, one task per file.

A workbook is a zip of XML parts and can only be read as a whole, so the unit of work is the
file. The reader below is a small helper; all further work happens on the resulting tables.
"""

from __future__ import annotations

import datetime as dt
import io
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import list_cards

CELL_SCHEMA = (
    "entity string, file_id string, sheet_idx int, sheet string, row int, col int, value string, num double, "
    "kind string, strike boolean, max_row int, max_col int, name string, size long, crc_ok boolean, "
    "has_data boolean, rel_name string, error string"
)
ARROW_TYPE = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
ARROW = pa.schema([(name, ARROW_TYPE[kind]) for name, kind in (c.split() for c in CELL_SCHEMA.split(", "))])
REF = re.compile(r"^([A-Z]+)([0-9]+)$")
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Workbook files below ``path`` (S1); the file bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return list_cards(files.select("path", "length"))


def position(ref: str) -> tuple[int, int]:
    """Row and column of a cell reference."""
    letters, digits = REF.match(ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def _xml(book: zipfile.ZipFile, name: str):
    return ET.fromstring(book.read(name)) if name in book.namelist() else None


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _styles(book: zipfile.ZipFile) -> tuple[list[bool], list[bool]]:
    """Per cell format: struck through, and shown as a date."""
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return [], []
    fonts = [
        (s := f.find(f"{MAIN}strike")) is not None and s.get("val", "1") not in ("0", "false")
        for f in root.iterfind(f"{MAIN}fonts/{MAIN}font")
    ]
    dated = {
        int(n.get("numFmtId"))
        for n in root.iterfind(f"{MAIN}numFmts/{MAIN}numFmt")
        if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "").lower()))
    } | DATE_FORMATS
    xfs = list(root.iterfind(f"{MAIN}cellXfs/{MAIN}xf"))
    struck = [i < len(fonts) and fonts[i] for i in (int(x.get("fontId", 0)) for x in xfs)]
    return struck, [int(x.get("numFmtId", 0)) in dated for x in xfs]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names and their parts, in order."""
    rels = _xml(book, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target", "") for r in rels}
    found = []
    for sheet in _xml(book, "xl/workbook.xml").iterfind(f"{MAIN}sheets/{MAIN}sheet"):
        target = targets.get(sheet.get(REL), "")
        found.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)))
    return found


def _typed(cell, kind: str, shared: list[str], dated: bool) -> tuple[str, float | None, str] | None:
    """Text, number and kind of a cell; nothing for empty, NaN and infinite ones."""
    if kind == "inlineStr":
        return _texts(cell), None, "s"
    raw = cell.findtext(f"{MAIN}v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)], None, "s"
    if kind in ("str", "e"):
        return raw, None, "s"
    if kind == "b":
        return ("True" if raw == "1" else "False"), float(raw == "1"), "b"
    if kind == "d":
        return raw, None, "d"
    number = float(raw)
    if math.isnan(number) or math.isinf(number):
        return None
    if dated:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(days=number)), None, "d"
    return (str(int(number)) if number.is_integer() else repr(number)), number, "n"


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str], struck: list[bool], dated: list[bool]) -> Iterator[dict]:
    """Cells, then merged rectangles, then the extent of one sheet, streamed from its XML."""
    max_row = max_col = 0
    with book.open(part) as stream:
        for _, node in ET.iterparse(stream):
            if node.tag == f"{MAIN}c":
                row, col = position(node.get("r"))
                max_row, max_col = max(max_row, row), max(max_col, col)
                style = int(node.get("s", 0))
                got = _typed(node, node.get("t", "n"), shared, style < len(dated) and dated[style])
                if got is not None:
                    yield {
                        "entity": "cell", "row": row, "col": col, "value": got[0], "num": got[1], "kind": got[2],
                        "strike": style < len(struck) and struck[style],
                    }
            elif node.tag == f"{MAIN}row":
                node.clear()
            elif node.tag == f"{MAIN}mergeCell":
                top, _, bottom = node.get("ref").partition(":")
                (r1, c1), (r2, c2) = position(top), position(bottom or top)
                yield {"entity": "merge", "row": r1, "col": c1, "max_row": r2, "max_col": c2}
    yield {"entity": "sheet", "max_row": max_row, "max_col": max_col}


def _entry_rows(book: zipfile.ZipFile) -> Iterator[dict]:
    """Members of the package, and drawing references with resolved targets."""
    for info in book.infolist():
        row = {"entity": "entry", "name": info.filename, "size": info.file_size, "crc_ok": True, "has_data": True}
        lower = info.filename.lower()
        try:
            sheet = info.filename.endswith(".xml") and "sheet" in lower and "_rels" not in lower
            count = None
            with book.open(info) as stream:
                if sheet:
                    tags = [n.tag for _, n in ET.iterparse(stream)]
                    count, row["has_data"] = tags.count(f"{MAIN}row"), f"{MAIN}sheetData" in tags
                else:
                    while stream.read(1 << 20):
                        pass
            row["row"] = count
        except (zipfile.BadZipFile, ET.ParseError, OSError, EOFError):
            row["crc_ok"] = False
        yield row
        if "drawing" in info.filename and info.filename.endswith(".rels") and row["crc_ok"]:
            base = posixpath.dirname(info.filename.replace("_rels/", ""))
            for rel in ET.fromstring(book.read(info)):
                if rel.get("Target"):
                    target = posixpath.normpath(posixpath.join(base, rel.get("Target")))
                    yield {"entity": "ref", "rel_name": info.filename, "value": target}


def explode(path: str, content: bytes) -> Iterator[dict]:
    """Every fact of one workbook; an unreadable one gives a single error row."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            for row in _entry_rows(book):
                yield row | {"file_id": path}
            strings = _xml(book, "xl/sharedStrings.xml")
            shared = [_texts(si) for si in strings] if strings is not None else []
            struck, dated = _styles(book)
            for i, (name, part) in enumerate(_sheets(book)):
                for row in _sheet_rows(book, part, shared, struck, dated):
                    yield row | {"file_id": path, "sheet_idx": i, "sheet": name}
    except Exception as exc:  # any unreadable file becomes a row, never a failed job
        yield {"entity": "error", "file_id": path, "error": f"{type(exc).__name__}: {exc}"}


def _explode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk: list[dict] = []
    for batch in batches:
        for file in batch.to_pylist():
            for row in explode(file["path"], file["content"]):
                chunk.append(row)
                if len(chunk) >= 20_000:
                    yield pa.RecordBatch.from_pylist(chunk, schema=ARROW)
                    chunk = []
    if chunk:
        yield pa.RecordBatch.from_pylist(chunk, schema=ARROW)


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """All facts of all workbooks below ``path`` in one table, told apart by ``entity``.

    Write it out partitioned by entity before use; see :func:`write_ingest`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return explode_files(list_cards(files))


def explode_files(files: DataFrame) -> DataFrame:
    """Facts of workbooks given as (path, content)."""
    return files.select("path", "content").mapInArrow(_explode_batches, CELL_SCHEMA)


def write_ingest(spark: SparkSession, path: str, out: str) -> None:
    """Parse once, store by entity; rows keep sheet and row order inside a file."""
    ingest(spark, path).write.partitionBy("entity").mode("overwrite").parquet(out)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """cells, merges, sheets, entries, refs and errors from the ingested facts."""

    def of(entity: str, *columns) -> DataFrame:
        return facts.filter(F.col("entity") == entity).select(*columns)

    where = ["file_id", "sheet_idx"]
    return {
        "cells": of("cell", *where, "sheet", "row", "col", "value", "num", "kind", "strike"),
        "merges": of(
            "merge", *where, F.col("row").alias("min_row"), "max_row", F.col("col").alias("min_col"), "max_col"
        ),
        "sheets": of("sheet", *where, "sheet", "max_row", "max_col"),
        "entries": of("entry", "file_id", "name", "size", "crc_ok", F.col("row").alias("row_count"), "has_data"),
        "refs": of("ref", "file_id", "rel_name", F.col("value").alias("target")),
        "errors": of("error", F.col("file_id").alias("card_path"), "error"),
    }
