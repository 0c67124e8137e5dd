"""Excel workbooks, one workbook per task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import NULL_WORDS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS_PER_BATCH = 10_000


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _sheet_part(book: zipfile.ZipFile, sheet: int | str) -> str:
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = tree.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    names = [s.get("name") for s in sheets]
    chosen = sheets[sheet if isinstance(sheet, int) else names.index(sheet)]
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == chosen.get(_RELATION))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _sheet_rows(content: bytes, sheet: int | str) -> Iterator[dict[int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in items]
        with book.open(_sheet_part(book, sheet)) as part:
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{_MAIN}row":
                    continue
                row = {}
                for at, cell in enumerate(element.findall(f"{_MAIN}c")):
                    index = _column_index(cell.get("r")) if cell.get("r") else at
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    else:
                        text = value.text
                    row[index] = text
                yield row
                element.clear()


def _parse(sheet: int | str):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                header: dict[int, str] | None = None
                held: list[tuple[str, int, dict[str, str]]] = []
                for number, row in enumerate(_sheet_rows(bytes(content), sheet)):
                    if header is None:
                        header = row
                        continue
                    cells = {name: row[i] for i, name in header.items() if i in row}
                    held.append((path, number, cells))
                    if len(held) >= _ROWS_PER_BATCH:
                        yield pd.DataFrame(held, columns=["path", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "row", "cells"])

    return batches


def read_excel(
    spark: SparkSession, path: str, sheet: int | str = 0, source_file: bool = False
) -> DataFrame:
    """Rows of one sheet of every workbook under ``path`` (a file, folder or pattern), as text.

    The first row names the columns; workbooks with different columns are lined up by name.
    A sheet holds at most about a million rows, so a workbook fits a task.
    """
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = books.repartition(F.col("path")).mapInPandas(
        _parse(sheet), "path string, row long, cells map<string,string>"
    )
    names = rows.select(F.explode(F.map_keys("cells")).alias("name"), "path", "row").groupBy("name").agg(
        F.count("*").alias("n")
    )
    columns = sorted(r["name"] for r in names.collect())  # one row per column
    cells = [F.try_element_at("cells", F.lit(c)) for c in columns]
    cleaned = [F.when(~v.isin(*NULL_WORDS), v).alias(c) for c, v in zip(columns, cells)]
    extra = [F.col("path").alias("source_file"), F.col("row").alias("source_row")] if source_file else []
    return rows.select(*cleaned, *extra)


def read_excel_many(spark: SparkSession, paths: list[str], sheet: int | str = 0) -> dict[str, DataFrame]:
    """One table per workbook, named after the file."""
    return {p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]: read_excel(spark, p, sheet) for p in paths}
