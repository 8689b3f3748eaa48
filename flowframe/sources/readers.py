"""Sources: text, CSV, JSON Lines, Parquet, ORC, rows, ranges, generated rows, streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.frame import FileFrame, Frame


def from_iterable(spark: SparkSession, rows: Iterable, schema: T.StructType | str, idx: str = "idx") -> Frame:
    """Rows of this process, with their position in ``idx``. Scalars need a one-field schema."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    numbered = [(i, *(row if isinstance(row, (tuple, list)) else (row,))) for i, row in enumerate(rows)]
    return Frame(spark.createDataFrame(numbered, T.StructType([T.StructField(idx, T.LongType()), *kind.fields])), [idx])


def from_file(spark: SparkSession, path: str) -> Frame:
    """One row a line (column ``value``); blank lines stay, and any line end counts.

    The order is that of files and lines, as far as the reader's splits keep it: see ``line_no``.
    """
    return _numbered(spark.read.text(path))


def from_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, headers: bool = True, infer: bool = False, multi_line: bool = True, **options) -> Frame:
    """CSV with quoted line breaks. Without a schema all columns are strings, or inferred on request.

    Missing and empty unquoted fields are null; rows that are too long lose their surplus. Where no
    field holds a line break, ``multi_line`` may be off: then large files are split over tasks, which
    files with such fields cannot be.
    """
    reader = spark.read.option("header", headers).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    for name, value in options.items():
        reader = reader.option({"delimiter": "sep", "quotechar": "quote", "escapechar": "escape"}.get(name, name), value)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return _numbered(reader.csv(path))


def from_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Frame:
    """JSON Lines; blank lines are skipped, a bad line raises.

    Without a schema each line is one VARIANT in column ``value``, whatever it holds.
    """
    if schema is not None:
        return _numbered(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _numbered(lines.select(F.parse_json("value").alias("value")))


def from_parquet(spark: SparkSession, path: str, order: list[str]) -> Frame:
    return Frame(spark.read.parquet(path), order)


def from_orc(spark: SparkSession, path: str, order: list[str]) -> Frame:
    return Frame(spark.read.orc(path), order)


def from_format(spark: SparkSession, name: str, order: list[str], path: str | None = None, schema: T.StructType | str | None = None, **options) -> Frame:
    """Any source that the session has: Avro, JDBC, Kafka and others, whose packages must be on its class path."""
    reader = spark.read.format(name).options(**options)
    return Frame((reader.schema(schema) if schema is not None else reader).load(path), order)


def from_jdbc(spark: SparkSession, url: str, table: str, order: list[str], split: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 8, **options) -> Frame:
    """A table of a database. With ``split``, a numeric column, and its ``bounds`` it is read in ``parts`` tasks; rows outside are read too."""
    if split is not None:
        options |= {"partitionColumn": split, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return from_format(spark, "jdbc", order, url=url, dbtable=table, **options)


def from_avro(spark: SparkSession, path: str, order: list[str], schema: T.StructType | str | None = None) -> Frame:
    return from_format(spark, "avro", order, path, schema)


def from_kafka(spark: SparkSession, servers: str, topic: str, **options) -> Frame:
    """What a topic holds, as a batch, in the order of partitions and offsets."""
    return from_format(spark, "kafka", ["partition", "offset"], **{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})


def from_query(spark: SparkSession, sql: str, order: list[str], **params) -> Frame:
    return Frame(spark.sql(sql, args=params or None), order)


def from_range(spark: SparkSession, *args: int) -> Frame:
    """range(stop), range(start, stop) or range(start, stop, step), negative steps too: columns idx and value."""
    values = range(*args)
    rows = spark.range(len(values)).withColumnRenamed("id", "idx")
    return Frame(rows.withColumn("value", F.lit(values.start) + F.col("idx") * values.step), ["idx"])


def generate(spark: SparkSession, n: int, value: Column) -> Frame:
    """The first n rows of an endless source: ``value`` is an expression over ``idx``."""
    return Frame(spark.range(n).withColumnRenamed("id", "idx").withColumn("value", value), ["idx"])


def endless(spark: SparkSession, rows_per_second: int, value: Column) -> DataFrame:
    """A stream without end: ``value`` is an expression over ``idx``; with the time each row appeared."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return stream.withColumnRenamed("value", "idx").withColumnRenamed("timestamp", "ts").withColumn("value", value)


def from_rows(df: DataFrame, order: list[str]) -> Frame:
    return Frame(df, order)


def _numbered(df: DataFrame) -> Frame:
    """Rows by file, block and place in the block: an order that needs no shuffle to be known."""
    placed = df.select("*", F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"))
    return FileFrame(df, placed, ["line_no"])
