"""The frame: a lazy, immutable DataFrame with an explicit order key.

Columns and SQL strings come first; Python functions go through Arrow where they are asked for
by name (``map_batches``). Only the verbs that depend on positions use the order.
"""

from __future__ import annotations

import inspect
from collections.abc import Awaitable, Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.functions import policy
from flowframe.operators import grouping, joins, positional
from flowframe.operators.ordering import Dense, free_name, neighbour, sort_order, sorted_index, with_index
from flowframe.sources import sinks

Expression = Column | str


def _column(x: Expression) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Frame:
    def __init__(self, df: DataFrame, order: list[str], helpers: list[str] | None = None):
        self.df, self.order, self.helpers = df, order if isinstance(order, Dense) else list(order), list(helpers or [])

    def placed(self) -> Frame:
        """The same rows with an order of ascending columns, nulls first: what verbs of positions go by."""
        return self

    def _with(self, df: DataFrame, order: list[str] | None = None) -> Frame:
        return Frame(df, list(self.order) if order is None else order, self.helpers)

    @property
    def unordered(self) -> DataFrame:
        """The rows for what needs no order."""
        return self.df

    # projections, filters, expansion

    def map(self, **columns: Expression) -> Frame:
        """Only these columns, beside the order key."""
        keep = [c for c in self.order if c not in columns]
        return self._with(self.df.select(*keep, *[_column(e).alias(n) for n, e in columns.items()]))

    def with_columns(self, **columns: Expression) -> Frame:
        return self._with(self.df.withColumns({n: _column(e) for n, e in columns.items()}))

    def filter(self, predicate: Expression) -> Frame:
        return self._with(self.df.where(predicate))

    def flat_map(self, array: Expression, name: str = "value", position: str = "pos") -> Frame:
        """A row an element, in order; no row for empty arrays, one null element for null ones."""
        items, at = _column(array), self.placed()
        kind = at.df.select(items.alias("x")).schema["x"].dataType.simpleString()
        rows = at.df.select("*", F.posexplode(F.coalesce(items, F.array(F.lit(None)).cast(kind))).alias(position, name))
        return at._with(rows, [*at.order, position])

    def map_batches(self, fn: Callable, schema: str, order: list[str] | None = None) -> Frame:
        """Arrow batches through a Python function: for what columns cannot express."""
        return self._with(self.df.mapInArrow(fn, schema), order)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Frame:
        return self._with(fn(self.df))

    # positions

    def index(self, name: str = "idx") -> Frame:
        at = self.placed()
        return at._with(with_index(at.df, at.order, name), [name])

    def take(self, n: int) -> Frame:
        return self._with(positional.take(self.df, self.order, n))

    def skip(self, n: int) -> Frame:
        return self._with(positional.skip(self.df, self.order, n))

    def chunk(self, size: int | None = None, *aggregates: Column) -> Frame:
        """Without a size that of the session's chunk strategy, 1000 where none is set."""
        if size is None:
            strategy = self.df.sparkSession.conf.get(policy.CHUNK_STRATEGY, "fixed")
            size = policy.chunk_size(self.count() if strategy != "fixed" else 0, strategy, **policy.driver_memory(self.df.sparkSession))
        at = self.placed()
        return at._with(positional.chunk(at.df, at.order, size, *aggregates), ["chunk"])

    batch = chunk

    def window(self, size: int, slide: int = 1, *aggregates: Column) -> Frame:
        at = self.placed()
        return at._with(positional.window(at.df, at.order, size, slide, *aggregates), ["window"])

    def take_while(self, predicate: Expression) -> Frame:
        at = self.placed()
        return at._with(positional.take_while(at.df, at.order, _column(predicate)))

    def drop_while(self, predicate: Expression) -> Frame:
        at = self.placed()
        return at._with(positional.drop_while(at.df, at.order, _column(predicate)))

    # sorting, distinct, sets

    def sort(self, *keys: Expression, reverse: bool = False, nulls: str = "first") -> SortedFrame:
        """Stable: rows with equal keys keep their order, in either direction.

        The keys become columns sort_key_0, sort_key_1, ... (with other names where a frame has been
        sorted before); ``rows`` gives the result without them.
        """
        at = self.placed()
        named = {free_name(at.df, f"sort_key_{k}"): _column(key) for k, key in enumerate(keys)}
        return SortedFrame(at.df.withColumns(named), list(named), at.order, reverse, nulls, [*at.helpers, *named])

    def distinct(self, *keys: str) -> Frame:
        """The first row of each key; without keys, of each whole row apart from the order."""
        at = self.placed()
        keys = list(keys) or [c for c in self.df.columns if c not in self.order and c not in self.helpers]
        return at._with(grouping.first_by_key(at.df, keys, at.order))

    def union(self, other: Frame) -> Frame:
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    def intersect(self, other: Frame) -> Frame:
        return self._with(self.df.intersect(other.df))

    def subtract(self, other: Frame) -> Frame:
        return self._with(self.df.subtract(other.df))

    # groups, folds, joins

    def group_by(self, *keys: str) -> grouping.GroupedFrame:
        return grouping.GroupedFrame(self, list(keys))

    def reduce(self, value: Expression, step: Callable[[Column, Column], Column], initial: Column | None = None, combine: Callable[[Column, Column], Column] | None = None):
        """An ordered left fold of the whole frame; ``initial`` (else None) where it is empty.

        Ranges of rows are folded one after the other; with ``combine``, which joins the folds of
        two neighbouring runs (and a neutral ``initial``), all at once.
        """
        at = self.placed()
        if combine is not None:
            return grouping.fold(at.df, [], at.order, _column(value), step, initial, combine=combine).first()[0]
        return grouping.fold_in_order(at.df, at.order, _column(value), step, initial)

    # windows over keys

    def ranked(self, keys: list[str], *by: Column, kind: str = "row_number", name: str = "rank", tiles: int = 4) -> Frame:
        """Adds the row's row_number, rank, dense_rank, percent_rank or ntile among those of its keys.

        The keys part the rows over tasks; ``index`` numbers a whole frame.
        """
        function = F.ntile(tiles) if kind == "ntile" else getattr(F, kind)()
        return self._with(self.df.withColumn(name, function.over(Window.partitionBy(*keys).orderBy(*by))))

    def shifted(self, column: str, offset: int = 1, keys: list[str] | None = None, name: str | None = None) -> Frame:
        """Adds the column's value ``offset`` rows before (after, if negative) in the frame's order, by keys.

        Without keys positions are joined, so that no one task sees all rows.
        """
        name, at = name or f"{column}_shifted", self.placed()
        if not keys:
            return at._with(neighbour(at.df, at.order, column, offset, name))
        over = Window.partitionBy(*keys).orderBy(*at.order)
        return at._with(at.df.withColumn(name, F.lag(column, offset).over(over) if offset >= 0 else F.lead(column, -offset).over(over)))

    def moving(self, keys: list[str], aggregate: Column, before: int, after: int = 0, name: str = "moving") -> Frame:
        """Adds an aggregate over the rows from ``before`` ones back to ``after`` ones ahead, by keys; ``window`` takes a whole frame."""
        at = self.placed()
        return at._with(at.df.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy(*at.order).rowsBetween(-before, after))))

    def join(self, other: Frame, on, how: str = "inner") -> Frame:
        return self._with(joins.external_join(self.df, other.df, on, how))

    # actions

    def _ordered(self) -> DataFrame:
        return positional.ordered(self.df, self.order)

    def count(self) -> int:
        return self.unordered.count()

    def first(self) -> Row | None:
        rows = self.take(1)._ordered().take(1)
        return rows[0] if rows else None

    def collect(self) -> list[Row]:
        return self._ordered().collect()

    to_list = collect

    def __iter__(self) -> Iterator[Row]:
        return self._ordered().toLocalIterator(prefetchPartitions=True)

    def foreach(self, fn: Callable[[Row], object]) -> None:
        """In order, in this process."""
        for row in self:
            fn(row)

    def foreach_partition(self, fn: Callable[[Iterator[Row]], None]) -> None:
        """On the executors, without an order."""
        self.unordered.foreachPartition(fn)

    async def async_foreach(self, fn: Callable[[Row], object | Awaitable]) -> None:
        """In order, each awaited before the next."""
        for row in self:
            result = fn(row)
            if inspect.isawaitable(result):
                await result

    def to_file(self, path: str, column: str = "value", mode: str = "w") -> None:
        sinks.to_file(self._ordered(), path, column, mode)

    def to_csv(self, path: str, headers: list[str] | None = None, **options) -> None:
        """All columns but nested ones, without ``headers``; a reader's position column is nested."""
        flat = [c for c, kind in self.df.dtypes if not kind.startswith(("struct", "array", "map"))]
        sinks.to_csv(self._ordered(), path, headers or flat, **options)

    def to_jsonl(self, path: str) -> None:
        sinks.to_jsonl(self._ordered(), path)

    def to_parquet(self, path: str, partition_by: list[str] | None = None) -> None:
        sinks.to_parquet(self.df, path, partition_by)


class FileFrame(Frame):
    """Rows of files, numbered only where a verb asks for their order.

    A number that depends on the reader's splits keeps filters from moving below it; without it
    they reach the scan. ``unordered`` are the same rows without numbers.
    """

    def __init__(self, plain: DataFrame, numbered: DataFrame, order: list[str]):
        super().__init__(numbered, order)
        self.plain = plain

    @property
    def unordered(self) -> DataFrame:
        return self.plain

    def map(self, **columns: Expression) -> Frame:
        return FileFrame(self.plain.select(*[_column(e).alias(n) for n, e in columns.items()]), super().map(**columns).df, self.order)

    def with_columns(self, **columns: Expression) -> Frame:
        return FileFrame(self.plain.withColumns({n: _column(e) for n, e in columns.items()}), super().with_columns(**columns).df, self.order)

    def filter(self, predicate: Expression) -> Frame:
        return FileFrame(self.plain.where(predicate), self.df.where(predicate), self.order)

    def to_parquet(self, path: str, partition_by: list[str] | None = None) -> None:
        """Without the numbers, which hold for one reading only."""
        sinks.to_parquet(self.plain, path, partition_by)


class SortedFrame(Frame):
    """A frame ordered by keys in one direction, ties by the order it had before."""

    def __init__(self, df: DataFrame, keys: list[str], ties: list[str], reverse: bool, nulls: str, helpers: list[str]):
        super().__init__(df, [*keys, *ties], helpers)
        self.sort_keys, self.ties, self.reverse, self.nulls = keys, ties, reverse, nulls

    def placed(self) -> Frame:
        """By a column sort_position, unless the keys ascend with nulls first."""
        if not self.reverse and self.nulls == "first":
            return self
        name = free_name(self.df, "sort_position")
        return Frame(sorted_index(self.df, self.sort_keys, self.ties, self.reverse, self.nulls, name), Dense([name]), [*self.helpers, name])

    def order_by(self) -> list[Column]:
        return sort_order(self.sort_keys, self.ties, self.reverse, self.nulls)

    def _with(self, df: DataFrame, order: list[str] | None = None) -> Frame:
        return SortedFrame(df, self.sort_keys, self.ties, self.reverse, self.nulls, self.helpers) if order is None else Frame(df, order, self.helpers)

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order_by())

    def take(self, n: int) -> Frame:
        return self._with(self._ordered().limit(max(0, n)))

    def skip(self, n: int) -> Frame:
        return self._with(self._ordered().offset(max(0, n)))

    def rows(self) -> DataFrame:
        """The ordered rows without the columns that sorting added."""
        return self._ordered().drop(*self.helpers)
