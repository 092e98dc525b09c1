"""Requirement workbooks (zipped XML) to raw rows."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.store import first_per_name
from ..schemas import RAW_ROWS

# Name spaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(ref: str) -> int:
    """A is 1, Z 26, AA 27; 0 without letters."""
    n = 0
    for ch in filter(str.isalpha, ref):
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _cell(cell, shared: list[str]) -> str:
    inline, value = cell.find(f"{_MAIN}is"), cell.find(f"{_MAIN}v")
    if inline is not None:
        return _texts(inline)
    raw = value.text if value is not None and value.text else ""
    if cell.get("t") == "s" and raw:
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    return raw


def read_workbook(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet, row number, cells) of each row that has any text; cells up to the last one in use."""
    from ..operators.clauses import _PLAIN

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda name: ElementTree.fromstring(z.read(name))
        shared = [_texts(si) for si in load("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels").iter(f"{_PACKAGE}Relationship")}
        for number, sheet in enumerate(load("xl/workbook.xml").iter(f"{_MAIN}sheet")):
            target = (targets.get(sheet.get(f"{_REL}id")) or "").lstrip("/")
            path = target if target.startswith("xl/") else posixpath.join("xl", target)
            if path not in names:
                continue
            for k, row in enumerate(load(path).iter(f"{_MAIN}row")):
                cells: dict[int, str] = {}
                for cell in row.iter(f"{_MAIN}c"):
                    text = " ".join(_cell(cell, shared).translate(_PLAIN).split())
                    if text and (n := column_number(cell.get("r") or "")):
                        cells[n] = text
                if cells:
                    yield number, (sheet.get("name") or "").strip(), k, [cells.get(i, "") for i in range(1, max(max(cells), 3) + 1)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in RAW_ROWS.split(", ")]
    for files in batches:
        for f in files.itertuples(index=False):
            rows = [(f.path.rsplit("/", 1)[-1], n, sheet, k, c[0], c[1], c[2], c) for n, sheet, k, c in read_workbook(f.content)]
            yield pd.DataFrame(rows, columns=names)


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, content) -> raw rows; a workbook is one task's row, and its order is in sheet_idx and row_idx."""
    return files.select("path", "content").mapInPandas(_parse, RAW_ROWS)


def find_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the workbooks below root, one for each name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(root)
    return files.join(first_per_name(files.select("path")), "path", "left_semi")
