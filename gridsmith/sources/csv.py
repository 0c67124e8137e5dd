"""CSV in and out. Files are read as text columns; typing is a separate step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import NULL_WORDS, ref

_SPARE, _RAW = "__spare_field", "__raw_record"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    multi_line: bool | None = None,
    source_file: bool = False,
) -> DataFrame:
    """All columns as text. Rows with too many fields are skipped, short ones padded.

    Without ``encoding`` UTF-8 is tried, then Latin-1 when undecodable bytes show up. Files
    are read in splits unless some line has an open quote, that is, a field with a line
    break (checked in one pass; say ``multi_line`` to skip the check).
    """
    if multi_line is None:
        multi_line = _has_open_quotes(spark, path)
    if encoding is None:
        encoding = "UTF-8" if _decodes_as_utf8(spark, path) else "ISO-8859-1"
    groups = _files_by_header(spark, path, encoding)
    parts = [_read_group(spark, files or path, encoding, multi_line, source_file) for files in groups]
    names = set(parts[0].columns)
    if any(set(part.columns) != names for part in parts):
        raise ValueError(f"the files of {path} have different columns")
    # Columns are lined up by name, whatever their order in a file.
    table = reduce(DataFrame.unionByName, parts)
    if table.isEmpty():
        raise ValueError(f"no rows in {path}")
    return table


def _files_by_header(spark: SparkSession, path: str | list[str], encoding: str) -> list[list[str] | None]:
    """The files that share a header line, group by group; None for all when they are alike."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.collect():  # one row per file
        groups.setdefault((row["header"] or "").strip().removeprefix("\ufeff"), []).append(row["file_path"])
    return [None] if len(groups) < 2 else [sorted(files) for _, files in sorted(groups.items())]


def _read_group(spark: SparkSession, path: str | list[str], encoding: str, multi_line: bool, source_file: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW)
        # The number of fields is seen only when whole rows are parsed.
        .option("columnPruning", False)
    )
    header = [c.removeprefix("\ufeff") for c in reader.csv(path).columns]
    if not header:
        raise ValueError(f"no columns in {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _SPARE, _RAW]])
    # Against one field more than the header a row of the right length, or a shorter one, does
    # not fit; a row with exactly one more does, even if that field is empty.
    rows = reader.schema(schema).csv(path).where(ref(_SPARE).isNull() & ref(_RAW).isNotNull())
    columns = [F.when(~ref(c).isin(*NULL_WORDS), ref(c)).alias(c) for c in header]
    if source_file:
        columns.append(F.input_file_name().alias("source_file"))
    return rows.select(*columns)


def read_csv_many(spark: SparkSession, paths: list[str], encoding: str | None = None) -> dict[str, DataFrame]:
    """One table per file, named after the file."""
    return {p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]: read_csv(spark, p, encoding) for p in paths}


def _has_open_quotes(spark: SparkSession, path: str | list[str]) -> bool:
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def _decodes_as_utf8(spark: SparkSession, path: str | list[str]) -> bool:
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with headers, without an index column."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
