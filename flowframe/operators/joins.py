"""Joins: equality joins of every kind, as-of joins, range joins, keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.operators.ordering import free_name

#: Rows of a lookup side that are sent to every task; the side is counted first.
BROADCAST_ROWS = 200_000


def external_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """inner, left, right, full, semi, anti or cross; the physical strategy is left to the planner."""
    if how == "cross":
        return left.crossJoin(right)
    return left.join(right, on, how)


def lookup(left: DataFrame, table: DataFrame, on: str | list[str], miss: str = "null", most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Enriches rows by key. ``miss``: "null" keeps rows without a match, "drop" drops them.

    The table is broadcast only when a count shows that it is small; else both sides are shuffled.
    """
    small = table.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(table) if small else table, on, "left" if miss == "null" else "inner")


def asof_join(left: DataFrame, right: DataFrame, at: str, by: list[str], value: list[str], suffix: str = "_asof", strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """For each left row the latest right row of the same key at or before it (before it, if ``strict``).

    Both sides run through one window over (key, time). ``bucket`` (non-decreasing in time) splits
    long keys: rows are ranked inside a bucket, and what a bucket needs from those before it comes
    from one row a (key, bucket).
    """
    part = F.lit(0) if bucket is None else bucket
    side, slot, seen = (free_name(left, c) for c in ("side", "slot", "seen"))
    pair = F.struct(F.col(at).alias("t"), *[F.col(v) for v in value])
    # at equal times a right row counts for the left one unless strict
    first, second = (0, 1) if not strict else (1, 0)
    rows = left.withColumn(side, F.lit(second)).withColumn(seen, F.lit(None).cast(right.select(pair.alias("x")).schema["x"].dataType))
    theirs = right.select(*by, at, F.lit(first).alias(side), pair.alias(seen))
    both = rows.unionByName(theirs, allowMissingColumns=True).withColumn(slot, part)
    inside = Window.partitionBy(*by, slot).orderBy(at, side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(seen, F.last(seen, ignorenulls=True).over(inside))
    if bucket is not None:
        ends = theirs.withColumn(slot, part).groupBy(*by, slot).agg(F.max(seen).alias("last_seen"))
        slots = both.select(*by, slot).distinct().join(ends, [*by, slot], "left")
        carry = slots.withColumn("last_seen", F.last("last_seen", ignorenulls=True).over(Window.partitionBy(*by).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)))
        found = found.join(carry, [*by, slot], "left").withColumn(seen, F.coalesce(seen, "last_seen"))
    return found.where(F.col(side) == second).select(*left.columns, *[F.col(f"{seen}.{v}").alias(v + suffix) for v in value])


def range_join(left: DataFrame, right: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at < high, by an equality join on buckets of ``width``.

    A right row is dealt to every bucket its range touches; choose a width near the ranges' usual
    length.
    """
    point = left.withColumn("_bucket", F.floor(at / width))
    ranges = right.withColumn("_bucket", F.explode(F.when(low < high, F.sequence(F.floor(low / width), F.floor(high / width)))))
    return point.join(ranges, "_bucket").where((at >= low) & (at < high)).drop("_bucket")
