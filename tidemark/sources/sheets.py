"""Spreadsheets as files: code lists that name each level of a hierarchy once."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
COLUMNS = "ABCDEFG"
LEVELS = "ABCDE"
FIRST_ROW = 5
ROWS = 4096


def cells(data: bytes, part: str = "xl/worksheets/sheet1.xml") -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, values by column) of a workbook's first sheet, row by row as the XML is read."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as file:
                for _, node in ElementTree.iterparse(file):
                    if node.tag == f"{MAIN}si":
                        shared.append("".join(t.text or "" for t in node.iter(f"{MAIN}t")))
                        node.clear()
        with book.open(part) as file:
            for _, node in ElementTree.iterparse(file):
                if node.tag != f"{MAIN}row":
                    continue
                values = {}
                for cell in node.iter(f"{MAIN}c"):
                    column, value = "".join(c for c in cell.get("r", "") if c.isalpha()), cell.find(f"{MAIN}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
                    if column in COLUMNS and text is not None:
                        values[column] = shared[int(text)] if cell.get("t") == "s" else text
                yield int(node.get("r", 0)), values
                node.clear()


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, n, A .. G) of all workbooks under path, opened in tasks, a file in one task; from row FIRST_ROW on. A file that
    is no workbook has one row with its error, so that it can't be missed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([("sheet", pa.string()), ("n", pa.int64()), *((c, pa.string()) for c in COLUMNS), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held = posixpath.basename(batch.column(0)[i].as_py()), []
                try:
                    for n, values in cells(batch.column(1)[i].as_py()):
                        if n >= FIRST_ROW:
                            held.append({"sheet": name, "n": n, **values})
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as error:
                    held.append({"sheet": name, "error": f"{type(error).__name__}: {error}"})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(run, "sheet string, n long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", error string")


def code_entries(rows: DataFrame) -> DataFrame:
    """(sheet, n, code, region_code, district_code, community_code, category, name) of sheet_rows: each level's code is
    carried down until that level or one above it is named again; the lowest level that holds is the row's own code. Rows
    without a code, a region, a category or a name are no entries."""
    out = rows.where(F.col("n").isNotNull())
    for i, column in enumerate(LEVELS):
        order = Window.partitionBy("sheet").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        above = [F.nullif(F.col(c), F.lit("")).isNotNull() for c in LEVELS[:i]]
        reset = F.lit(False)
        for mark in above:
            reset = reset | mark
        out = out.withColumn("_since", F.max(F.when(reset, F.col("n"))).over(order))
        last = F.max(F.when(F.nullif(F.col(column), F.lit("")).isNotNull(), F.struct("n", column))).over(order)
        out = out.withColumn(f"_{column}", F.when(last["n"] >= F.coalesce("_since", F.lit(0)), last[column]))
    code = F.coalesce(*(F.col(f"_{c}") for c in reversed(LEVELS)))
    found = out.select("sheet", "n", code.alias("code"), F.col("_A").alias("region_code"), F.col("_B").alias("district_code"), F.col("_C").alias("community_code"), F.col("F").alias("category"), F.trim("G").alias("name"))
    return found.where("code IS NOT NULL AND region_code IS NOT NULL AND category <> '' AND name <> ''")
