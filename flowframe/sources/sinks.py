"""Sinks: text, CSV, JSON Lines and Parquet. Each writes a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_file(df: DataFrame, path: str, column: str = "value", mode: str = "w") -> None:
    """One line a row; null is written as an empty line. Mode "w" replaces, "a" appends."""
    rows = df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
    rows.write.mode({"w": "overwrite", "a": "append"}[mode]).text(path)


def to_csv(df: DataFrame, path: str, headers: list[str] | None = None, **options) -> None:
    """The named columns (all, without names), with a header and CRLF line ends."""
    writer = df.select(*(headers or df.columns)).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"')
    for name, value in options.items():
        writer = writer.option({"delimiter": "sep", "quotechar": "quote"}.get(name, name), value)
    writer.csv(path)


def to_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
