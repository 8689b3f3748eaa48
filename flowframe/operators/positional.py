"""Operators on positions: take, skip, chunks, count windows, take-while and drop-while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.operators.ordering import with_index


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order])


def take(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows; none for n <= 0. Plans as a top-k, not as a full sort."""
    return ordered(df, order).limit(max(0, n))


def skip(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return ordered(df, order).offset(max(0, n))


def chunk(df: DataFrame, order: list[str], size: int = 1000, *aggregates: Column) -> DataFrame:
    """Consecutive rows in groups of ``size`` (at least 1), the last group may be smaller.

    Without aggregates each chunk's rows are an array, in order.
    """
    rows = with_index(df, order).withColumn("chunk", F.expr(f"idx div {max(1, size)}"))
    content = aggregates or (_rows(df),)
    return rows.groupBy("chunk").agg(*content)


#: Windows that begin in so many positions are made in one place.
WINDOW_RANGE = 8192


def window(df: DataFrame, order: list[str], size: int, slide: int = 1, *aggregates: Column) -> DataFrame:
    """Sliding windows of ``size`` rows, full ones only; windows begin every min(slide, size) rows.

    Rows are dealt to ranges of positions, with the size - 1 rows after a range once more, so a row
    is shuffled twice at most whatever the size; only inside a range it is dealt to its windows.
    """
    if size < 1 or slide < 1:
        raise ValueError("size and slide must be positive")
    step = min(slide, size)
    span = step * -(-max(WINDOW_RANGE, size) // step)
    own, idx = F.expr(f"cast(idx div {span} as bigint)"), F.col("idx")
    also = (own > 0) & (idx < own * span - step + size)
    dealt = with_index(df, order).select("*", F.explode(F.when(also, F.array(own - 1, own)).otherwise(F.array(own))).alias("range")).repartition("range")
    first = F.greatest(F.col("range") * (span // step), F.ceil((idx - (size - 1)) / step).cast("bigint"))
    last = F.least((F.col("range") + 1) * (span // step) - 1, F.expr(f"cast(idx div {step} as bigint)"))
    rows = dealt.select("*", F.explode(F.sequence(first, last)).alias("window"))
    content = aggregates or (_rows(df),)
    # rows of a range lie together already: no shuffle here
    return rows.groupBy("range", "window").agg(F.count(F.lit(1)).alias("n_in_window"), *content).where(F.col("n_in_window") == size).drop("n_in_window", "range")


def _rows(df: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*df.columns).alias("row")))), lambda x: x["row"]).alias("rows")


def _first_failure(df: DataFrame, order: list[str], predicate: Column) -> Column:
    """The key of the first row where the predicate isn't true, as a scalar subquery; null if there is none."""
    return df.where(~F.coalesce(predicate, F.lit(False))).agg(F.min(F.struct(*order))).scalar()


def take_while(df: DataFrame, order: list[str], predicate: Column) -> DataFrame:
    """Rows before the first one where the predicate is false or null."""
    stop = _first_failure(df, order, predicate)
    return df.where(stop.isNull() | (F.struct(*order) < stop))


def drop_while(df: DataFrame, order: list[str], predicate: Column) -> DataFrame:
    """Rows from the first one where the predicate is false or null; evaluating again gives the same."""
    return df.where(F.struct(*order) >= _first_failure(df, order, predicate))
