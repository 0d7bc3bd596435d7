"""Crosstab workbooks (XLSX in ZIP or bare) as long rows.

Spark has no reader for workbooks, so each file is read by one task with the standard library, a file a row of
``binaryFile``. The sheets have a header of several rows with merged cells: the row with the key column names the
identity columns; above the value columns stand the labels of each level, which a vocabulary recognises wherever they
are, and a merged label holds for the columns to its right up to the next one.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources import manifest

# The names of the format's XML.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass(frozen=True)
class Layout:
    """``key`` names the row of identity columns; ``levels`` has, for each level of labels, what they are called in the
    output and the labels. ``sheets`` maps a word in a sheet's name to its kind; other sheets are left out."""

    key: str
    identity: tuple[str, ...]
    levels: tuple[tuple[str, tuple[str, ...]], ...]
    sheets: tuple[tuple[str, str], ...]
    total: str = "TOTAL"


def folded(value) -> str:
    text = unicodedata.normalize("NFKD", "" if value is None else str(value))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).upper().split())


def unwrapped(data: bytes) -> bytes:
    """The workbook itself; out of a ZIP with exactly one, that one."""
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    if "[Content_Types].xml" in names:
        return data
    books = [n for n in names if n.lower().endswith(".xlsx")]
    if len(books) != 1:
        raise ValueError(f"expected one workbook in the archive, found {len(books)}")
    return zipfile.ZipFile(io.BytesIO(data)).read(books[0])


def year_of(name: str) -> int | None:
    """The last year of the 20th or 21st century in a file name."""
    found = re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d)", name)
    return int(found[-1]) if found else None


def sheet_kind(name: str, layout: Layout) -> str | None:
    return next((kind for word, kind in layout.sheets if word in folded(name)), None)


def _place(reference: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(row) - 1, column - 1


def sheets(data: bytes) -> Iterator[tuple[str, dict[tuple[int, int], str | float]]]:
    """(name, cells by (row, column)) of each sheet; merged labels are filled to the right only."""
    book = zipfile.ZipFile(io.BytesIO(data))
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        path = targets[sheet.get(RELATION)].lstrip("/")
        root = ElementTree.fromstring(book.read(path if path.startswith("xl/") else f"xl/{path}"))
        cells: dict[tuple[int, int], str | float] = {}
        for c in root.iter(f"{MAIN}c"):
            value, inline = c.find(f"{MAIN}v"), c.find(f"{MAIN}is")
            if inline is not None:
                cells[_place(c.get("r"))] = "".join(t.text or "" for t in inline.iter(f"{MAIN}t"))
            elif value is not None and value.text is not None:
                kind = c.get("t")
                cells[_place(c.get("r"))] = strings[int(value.text)] if kind == "s" else value.text if kind in ("str", "e") else float(value.text)
        for m in root.iter(f"{MAIN}mergeCell"):
            (row, first), (_, last) = (_place(p) for p in m.get("ref").split(":"))
            if (row, first) in cells:
                for column in range(first + 1, last + 1):
                    cells[row, column] = cells[row, first]
        yield sheet.get("name"), cells


def long_rows(cells: dict[tuple[int, int], str | float], layout: Layout) -> Iterator[tuple]:
    """(identity values, labels of all levels, value) of each number in a column that has a label of every level."""
    header = min((r for (r, _), v in cells.items() if folded(v) == layout.key), default=None)
    if header is None:
        raise ValueError(f"no header row with {layout.key}")
    width, height = 1 + max(c for _, c in cells), 1 + max(r for r, _ in cells)
    identity = {folded(cells.get((header, c))): c for c in reversed(range(width))}
    columns = [identity.get(folded(n)) for n in layout.identity]
    labels: dict[int, list[str]] = {}
    for c in range(width):
        above = [folded(cells.get((r, c))) for r in range(header + 1)]
        found = [next((a for a in reversed(above) if a in {folded(x) for x in vocabulary}), None) for _, vocabulary in layout.levels]
        if all(found):
            labels[c] = found
    for r in range(header + 1, height):
        who = [cells.get((r, c)) if c is not None else None for c in columns]
        if folded(cells.get((r, identity[layout.key]))) in ("", layout.total):
            continue
        for c, names in labels.items():
            if isinstance(cells.get((r, c)), float):
                yield (*[None if v is None else str(v).strip() for v in who], *names, cells[r, c])


def read_crosstabs(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    """``path``, ``year``, ``sheet_kind``, the identity columns, the levels and ``value`` of all workbooks at a path, or at each of a list."""
    names = ["path", "year", "sheet_kind", *layout.identity, *[n for n, _ in layout.levels], "value"]
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "year" else T.DoubleType() if n == "value" else T.StringType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                for name, cells in sheets(unwrapped(content)):
                    kind = sheet_kind(name, layout)
                    if kind:
                        yield pd.DataFrame([(file, year_of(file.rpartition("/")[2]), kind, *row) for row in long_rows(cells, layout)], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def pending_workbooks(log: DataFrame, loaded: DataFrame | None, dataset: str | None = None) -> DataFrame:
    """The last good attempt at each resource whose digest isn't the one that ``loaded`` has rows of."""
    good = manifest.latest_attempts(log if dataset is None else log.where(F.col("dataset") == dataset)).where("landing_key is not null")
    if loaded is None:
        return good
    before = loaded.groupBy(F.col("_resource_id").alias("resource_id")).agg(F.max("_source_sha256").alias("sha256"))
    return manifest.pending(good, before)


def load_workbooks(spark: SparkSession, files: DataFrame, root: str, layout: Layout, loaded_at: Column, origin: str = "real") -> DataFrame | None:
    """The long rows of landed workbooks (rows of the manifest) with their lineage; none if there are no files.

    Only the landing keys reach the driver, as the paths to read; contents are read by the tasks.
    """
    keys = [r[0] for r in files.select("landing_key").distinct().collect()]
    if not keys:
        return None
    rows = read_crosstabs(spark, [f"{root.rstrip('/')}/{k}" for k in keys], layout)
    # a landing key has three parts: resource, date, file
    rows = rows.withColumn("_source_key", F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)).drop("path")
    lineage = files.select(
        F.col("resource_id").alias("_resource_id"), F.col("landing_key").alias("_source_key"), F.col("sha256").alias("_source_sha256"),
        F.col("ingest_date").alias("_ingest_date"),
    )
    return rows.join(lineage, "_source_key").withColumns({"_loaded_at": loaded_at, "data_origin": F.lit(origin)})
