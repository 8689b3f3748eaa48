"""What the corpus operators share: shared-folder tables, Arrow row mapping, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL: dict[str, str] = {}
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, else the folder that the session was
    given for checkpoints. Only where there is neither and the
    master is local (tests, a single machine) a temporary folder of this machine takes its place;
    on a cluster an unset folder is an error, as executors could not read what others write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="flowframe-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "uncompressed") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    It cuts lineage as checkpoint() does, and survives lost executors. The path is in ``df.path``.
    Most tables here hold hashes, which do not compress; codecs would only take up native buffers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system API, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small: a batch is held by the JVM and by a worker at once."""
    number, unit = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()).groups()
    if int(number) << 10 * "bkmgt".find(unit or "b") > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def return_freed_memory() -> None:
    """Lets a worker give the memory of freed batches back to the system, so that it is small while it waits.

    Arrow's own pool keeps freed pages; glibc does too unless large blocks are mapped on their own.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune:
        tune(-3, 256 << 10)  # M_MMAP_THRESHOLD


def arrow_map(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType,
              max_rows: int = 2048, max_bytes: int = 4 << 20) -> DataFrame:
    """A row-to-rows function over Arrow batches, with output batches bounded in rows and bytes.

    ``make`` runs once a task and returns a function of one row's values (strings and binaries as
    Python objects) that yields output tuples.
    """
    bound_batches(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        fn = make()
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    for out in fn(*values):
                        rows.append(out)
                        size += sum(len(v) for v in out if isinstance(v, (bytes, str, list)))
                        if len(rows) >= max_rows or size >= max_bytes:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    return df.mapInArrow(run, struct)


def streamed(first: DataFrame, second: DataFrame, parts: int, fn: Callable[[Iterator[tuple[int, pa.RecordBatch]]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Partition by partition the rows of ``first``, then those of ``second``, as a stream of batches.

    Both have an int column ``part`` below ``parts``, and no column ``kind``. ``fn`` gets (kind, batch)
    with kind 0 for first and 1 for second, a batch holding rows of one part; it need not hold
    more than a batch of either. Unlike a group, a part may be of any size.
    """
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                part, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "kind"))
                cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if a < b:
                        yield int(kind[a]), batch.slice(a, b - a)

        return_freed_memory()
        yield from fn(pieces())

    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def extended(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of df with more fields; df's own stays as it is."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def column_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def least_in_component(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least index in each node's component, by the edges a - b and those that made ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """Members of the components of an undirected graph: (node, root), root the least node.

    edges has columns ``a`` and ``b`` of one orderable type; loops and repeats are ignored. Nodes
    without an edge do not appear. Alternates large-star and small-star steps until every child
    hangs from one root; each step's edges are a table in the shared folder. Nothing is collected
    but two counts a round. A hub's edges meet in joins that adaptive execution splits.
    """
    spark = edges.sparkSession

    def oriented(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def minimum(sym: DataFrame) -> DataFrame:
        return sym.groupBy("u").agg(F.min("v").alias("m"))

    def starred(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        return bad.isEmpty()

    e = materialize(oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), label)
    for _ in range(most_rounds):
        if starred(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = e.path
        # large star: every larger neighbour of u joins the least node next to u
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minimum(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(oriented(large), label)
        discard(spark, before)
        before = e.path
        # small star: the smaller neighbours of u, and u, join the least of them
        least = minimum(e)
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
        e = materialize(oriented(small), label)
        discard(spark, before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
