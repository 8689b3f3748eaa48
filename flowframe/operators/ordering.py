"""Dense positions over an explicit order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Up to this many rows one sorted task is cheaper than two passes.
ONE_TASK_ROWS = 200_000
BUCKET_ROWS = 250_000
#: Bounds of one level. Ranges are found in two levels, so there are at most MOST_BOUNDS ** 2 of them.
MOST_BOUNDS = 512
#: Keys sampled to place the bounds, for the first level and for each range of the second; they touch balance only, never the result.
SAMPLE_ROWS, RANGE_SAMPLES = 20_000, 20


def free_name(df: DataFrame, stem: str) -> str:
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


class Dense(list):
    """An order of one column that holds dense positions from 0 already."""


def with_index(df: DataFrame, order: list[str], name: str = "idx", one_task_rows: int = ONE_TASK_ROWS, bucket_rows: int = BUCKET_ROWS, n: int | None = None) -> DataFrame:
    """Adds ``name``: the row's position from 0 by the columns of ``order``, ascending, nulls first.

    The order key must be unique for a repeatable result. Large inputs are cut into key ranges; a
    row's position is its number in its range plus the rows of the ranges before. A range is a pure
    function of the key, so evaluating the plan again gives the same positions. ``n`` is the number
    of rows, where it is known. A Dense order costs nothing.
    """
    if isinstance(order, Dense):
        return df.withColumn(name, F.col(order[0]))
    n = df.count() if n is None else n
    key = [F.col(c).asc_nulls_first() for c in order]
    if n <= one_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*key)).cast("bigint") - 1)
    bucket, shift, of = (free_name(df, c) for c in ("bucket", "shift", "bucket_of"))
    dealt = _in_ranges(df, order, n, max(1, -(-n // bucket_rows)), bucket)
    counts = dealt.groupBy(F.col(bucket).alias(of)).agg(F.count(F.lit(1)).alias(shift))
    # one row a range, MOST_BOUNDS ** 2 at most
    before = counts.select(of, F.coalesce(F.sum(shift).over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(shift))
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*key)).cast("bigint") - 1
    placed = dealt.withColumn(name, inside).join(F.broadcast(before), F.col(bucket) == F.col(of))
    return placed.withColumn(name, F.col(name) + F.col(shift)).drop(bucket, of, shift)


def sort_order(keys: list[str], ties: list[str], reverse: bool, nulls: str) -> list[Column]:
    """Keys in one direction, ties ascending."""
    name = f"{'desc' if reverse else 'asc'}_nulls_{nulls}"
    return [*[getattr(F.col(k), name)() for k in keys], *[F.col(t).asc_nulls_first() for t in ties]]


def sorted_index(df: DataFrame, keys: list[str], ties: list[str], reverse: bool, nulls: str, name: str, one_task_rows: int = ONE_TASK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``name``: the row's position by ``keys`` in one direction, ties by ``ties``, ascending in either case.

    ``nulls`` ("first" or "last") is where nulls stand in the result. For a descending order each
    run of equal keys keeps its inner order and is moved as a whole, by a join with one row a key.
    """
    n = df.count()
    if n <= one_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*sort_order(keys, ties, reverse, nulls))).cast("bigint") - 1)
    late = (nulls == "last") != reverse
    flags = {free_name(df, f"{k}_null"): F.col(k).isNull() if late else F.col(k).isNotNull() for k in keys}
    order = [c for pair in zip(flags, keys) for c in pair]
    rows = with_index(df.withColumns(flags), [*order, *ties], name, one_task_rows, bucket_rows, n).drop(*flags)
    if not reverse:
        return rows
    of = [free_name(rows, f"{k}_of") for k in keys]
    first, after = free_name(rows, "run_first"), free_name(rows, "run_after")
    runs = rows.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, of)]).agg(F.min(name).alias(first), (F.max(name) + 1).alias(after))
    same = F.lit(True)
    for k, c in zip(keys, of):
        same = same & F.col(k).eqNullSafe(F.col(c))
    return rows.join(runs, same).withColumn(name, F.lit(n) - F.col(after) + F.col(name) - F.col(first)).drop(*of, first, after)


def neighbour(df: DataFrame, order: list[str], column: str, offset: int, name: str) -> DataFrame:
    """Adds ``name``: the column's value ``offset`` positions before, null where there is none; by a join on positions."""
    at, of, value = (free_name(df, c) for c in ("position", "position_of", "value_of"))
    rows = with_index(df, order, at)
    other = rows.select((F.col(at) + offset).alias(of), F.col(column).alias(value))
    return rows.join(other, F.col(at) == F.col(of), "left").withColumn(name, F.col(value)).drop(at, of, value)


def _in_ranges(df: DataFrame, order: list[str], n: int, buckets: int, bucket: str) -> DataFrame:
    """Adds ``bucket``: the number of the row's key range; larger keys have no smaller numbers."""
    at = F.struct(*order)
    kinds = df.select(*order).schema

    def sample(rows: int) -> DataFrame:
        """Keys by their hash: the same ones whenever the plan is evaluated."""
        return df.where(F.pmod(F.xxhash64(*order), F.lit(max(1, n // rows))) == 0).select(at.alias("k"))

    coarse = min(MOST_BOUNDS, buckets)
    # at most 2 * SAMPLE_ROWS keys come to one task, at most MOST_BOUNDS to the driver
    cut = sample(SAMPLE_ROWS).limit(2 * SAMPLE_ROWS).select("k", F.ntile(coarse).over(Window.orderBy("k")).alias("b"))
    rows = sorted(cut.groupBy("b").agg(F.min("k").alias("k")).where("b > 1").collect(), key=lambda r: r.b)
    literal = lambda row: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kinds)))
    own = lambda k: F.size(F.filter(F.array(*(literal(r.k) for r in rows)), lambda b: b <= k)) if rows else F.lit(0)
    if buckets <= MOST_BOUNDS:
        return df.withColumn(bucket, own(at))
    # second level: the bounds inside each of the first level's ranges, as one array a range
    fine = min(MOST_BOUNDS, -(-buckets // coarse))
    inner = sample(RANGE_SAMPLES * buckets).select("k", own(F.col("k")).alias("c"))
    inner = inner.select("c", "k", F.ntile(fine).over(Window.partitionBy("c").orderBy("k")).alias("b")).groupBy("c", "b").agg(F.min("k").alias("k")).where("b > 1")
    c, bounds = free_name(df, "range_of"), free_name(df, "range_bounds")
    table = inner.groupBy(F.col("c").alias(c)).agg(F.array_sort(F.collect_list("k")).alias(bounds))  # MOST_BOUNDS rows of MOST_BOUNDS keys at most
    joined = df.withColumn(bucket, own(at)).join(F.broadcast(table), F.col(bucket) == F.col(c), "left")
    below = F.coalesce(F.size(F.filter(bounds, lambda b: b <= at)), F.lit(0))
    return joined.withColumn(bucket, F.col(bucket) * fine + F.greatest(below, F.lit(0))).drop(c, bounds)
