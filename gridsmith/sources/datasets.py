"""Named datasets written side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "orc", "json")


def write_datasets(
    tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write each table to ``path/name``, for example raw, cleaned and ml_ready."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    for name, table in tables.items():
        writer = table.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path.rstrip('/')}/{name}")
