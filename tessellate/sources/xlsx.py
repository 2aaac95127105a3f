"""Spreadsheets: the first sheet of XLSX files, read through Spark's own file access."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_SHEET = "xl/worksheets/sheet1.xml"


def column_number(ref: str) -> int:
    """The column of a cell reference, from 0: `B7` is 1."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells_of(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, as texts; an empty cell is null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        for row in ET.fromstring(z.read(_SHEET)).iterfind(".//m:row", _NS):
            out: dict[int, str | None] = {}
            for place, c in enumerate(row.iterfind("m:c", _NS)):
                v = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                out[column_number(c.get("r")) if c.get("r") else place] = text or None
            yield [out.get(i) for i in range(max(out, default=-1) + 1)]


def sheet_bytes(rows: list[list[object]]) -> bytes:
    """A file of one sheet with these rows."""
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(_SHEET, f'<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of all files at a path, as texts; the first row of each sheet names its columns, and one that lacks a column fails. A file is read whole by one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                head, *body = [*cells_of(bytes(data))] or [[]]
                names = [(h or "").strip() for h in head]
                if missing := [c for c in columns if c not in names]:
                    raise ValueError(f"{name} lacks {missing}")
                take = lambda r, c: r[names.index(c)] if names.index(c) < len(r) else None  # noqa: B023, E731
                yield pd.DataFrame([[take(r, c) for c in columns] for r in body if any(r)], columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))
