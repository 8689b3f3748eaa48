"""Grouping: collected groups, built-in aggregates, ordered folds, best rows of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.operators.ordering import free_name, with_index


def collect_groups(df: DataFrame, keys: list[str], order: list[str], name: str = "rows") -> DataFrame:
    """One row a key with its rows as an array, in order. A null key is a group.

    A group must fit into a row; prefer aggregates or best_of_group where groups may be large.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*rest).alias("row")))), lambda x: x["row"]).alias(name))


#: Rows of a range that one task folds.
FOLD_ROWS = 250_000


def fold(df: DataFrame, keys: list[str], order: list[str], value: Column, step: Callable[[Column, Column], Column], initial: Column | None = None, name: str = "value",
         combine: Callable[[Column, Column], Column] | None = None, range_rows: int = FOLD_ROWS) -> DataFrame:
    """A left fold of each key's values in order; without ``initial`` the first value begins it.

    With ``combine``, which joins the folds of two neighbouring runs, ranges of positions are folded
    in parallel and then joined in order; ``initial`` begins each of them, so it must be neutral.
    Without it a key's values must fit into a row: for folds that are neither commutative nor
    associative. Without keys the whole frame is one fold, and gives ``initial`` where it is empty.
    """
    if combine is not None:
        at, part = free_name(df, "fold_at"), free_name(df, "fold_part")
        rows = with_index(df.withColumn(part, value), order, at).withColumn(at, F.expr(f"cast({at} div {range_rows} as bigint)"))
        parts = fold(rows, [*keys, at], order, F.col(part), step, initial, part)
        return fold(parts, keys, [at], F.col(part), combine, initial, name)
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), value.alias("v")))), lambda x: x["v"])
    grouped = (df.groupBy(*keys) if keys else df).agg(items.alias("items"))
    return grouped.select(*keys, _folded(F.col("items"), step, initial).alias(name))


def _folded(items: Column, step: Callable[[Column, Column], Column], initial: Column | None) -> Column:
    if initial is not None:
        return F.aggregate(items, initial, lambda acc, x: step(acc, x))
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.when(F.size(items) > 0, F.aggregate(rest, F.get(items, F.lit(0)), lambda acc, x: step(acc, x)))


def fold_in_order(df: DataFrame, order: list[str], value: Column, step: Callable[[Column, Column], Column], initial: Column | None = None, range_rows: int = FOLD_ROWS):
    """The left fold of a whole frame of any size, range after range; None or ``initial`` where it is empty.

    Each range is one task's array; its result begins the next one, as the fold demands. A fold
    whose parts can be joined runs in parallel with ``combine`` of fold().
    """
    value_at, at = free_name(df, "fold_value"), free_name(df, "fold_at")
    rows = df.select(*order, value.alias(value_at))
    kind = rows.schema[value_at].dataType if initial is None else df.select(initial.alias("x")).schema["x"].dataType
    placed = with_index(rows, order, at)
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value_at).alias("v")))), lambda x: x["v"])
    ranges = placed.groupBy(F.expr(f"cast({at} div {range_rows} as bigint)").alias("part")).agg(items.alias("items")).persist(StorageLevel.DISK_ONLY)
    state, seen = initial, False
    try:
        for part in range(ranges.count()):
            found = ranges.where(F.col("part") == part).select(_folded(F.col("items"), step, state).cast(kind).alias("x")).first()[0]
            state, seen = F.lit(found).cast(kind), True
        if seen or initial is None:
            return found if seen else None
        return df.sparkSession.range(1).select(initial.alias("x")).first()[0]
    finally:
        ranges.unpersist()


def best_of_group(df: DataFrame, keys: list[str], by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key by ``by``; groups are cut to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= k)


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation: a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(*df.columns)


class GroupedFrame:
    """A frame by key; every method gives a lazy frame ordered by the keys."""

    def __init__(self, frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def _agg(self, *columns: Column):
        from flowframe.frame import Frame

        return Frame(self.frame.unordered.groupBy(*self.keys).agg(*columns), self.keys)

    def count(self, name: str = "count"):
        return self._agg(F.count(F.lit(1)).alias(name))

    def sum(self, column: str, name: str = "sum"):
        """As doubles, as the sum of anything is."""
        return self._agg(F.sum(F.col(column).cast("double")).alias(name))

    def avg(self, column: str, name: str = "avg"):
        return self._agg(F.avg(F.col(column).cast("double")).alias(name))

    def max(self, column: str, name: str = "max"):
        return self._agg(F.max(column).alias(name))

    def approx_distinct(self, column: str, name: str = "approx_distinct", error: float = 0.05):
        """Distinct values by a sketch of fixed size, within about the relative error."""
        return self._agg(F.approx_count_distinct(column, error).alias(name))

    def approx_quantiles(self, column: str, quantiles: list[float], name: str = "quantiles", accuracy: int = 10_000):
        """Values whose ranks are within 1 / accuracy of the quantiles', by a sketch."""
        return self._agg(F.percentile_approx(column, quantiles, accuracy).alias(name))

    def min(self, column: str, name: str = "min"):
        return self._agg(F.min(column).alias(name))

    def agg(self, *columns: Column):
        return self._agg(*columns)

    def collect_rows(self, name: str = "rows"):
        from flowframe.frame import Frame

        at = self.frame.placed()
        return Frame(collect_groups(at.df, self.keys, at.order, name), self.keys)

    def fold(self, value: Column, step: Callable[[Column, Column], Column], initial: Column | None = None, name: str = "value", combine: Callable[[Column, Column], Column] | None = None):
        from flowframe.frame import Frame

        at = self.frame.placed()
        return Frame(fold(at.df, self.keys, at.order, value, step, initial, name, combine), self.keys)

    def top(self, k: int, *by: Column, rank: str = "rank"):
        from flowframe.frame import Frame

        at = self.frame.placed()
        return Frame(best_of_group(at.df, self.keys, [*by, *map(F.col, at.order)], k, rank), [*self.keys, rank])
