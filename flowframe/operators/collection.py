"""Views of a frame as an indexed array or as a keyed map."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from flowframe.operators.ordering import with_index


class ArrayView:
    """Rows with dense positions ``idx``; every operation gives a new view, positions stay dense."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, df: DataFrame, order: list[str]) -> ArrayView:
        return cls(with_index(df, order))

    def __len__(self) -> int:
        return self.df.count()

    def at(self, i: int) -> DataFrame:
        """The row at i; negative positions count from the end. No row beyond the ends."""
        return self.df.where(F.col("idx") == (i if i >= 0 else self._size() + i))

    def _size(self) -> Column:
        """The length as a scalar subquery."""
        return self.df.agg(F.count(F.lit(1))).scalar()

    def get(self, i: int) -> Row:
        rows = self.at(i).take(1)
        if not rows:
            raise IndexError(i)
        return rows[0]

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
        """As slices of a list are, for positive steps."""
        if step < 1:
            raise ValueError("step must be positive")
        size = self._size()
        edge = lambda i, none: F.lit(none) if i is None else (F.lit(i) if i >= 0 else F.greatest(F.lit(0), size + i))
        first = edge(start, 0)
        rows = self.df.where((F.col("idx") >= first) & ((F.col("idx") - first) % step == 0))
        return rows if stop is None else rows.where(F.col("idx") < edge(stop, 0))

    def append(self, rows: DataFrame, order: list[str]) -> ArrayView:
        more = with_index(rows, order)
        return ArrayView(self.df.unionByName(more.withColumn("idx", F.col("idx") + self._size())))

    extend = append

    def insert(self, i: int, rows: DataFrame, order: list[str]) -> ArrayView:
        """Rows before position i; what stood from there on moves up."""
        more = with_index(rows, order)
        n = more.agg(F.count(F.lit(1))).scalar()
        size = self._size()
        at = F.least(F.lit(i), size) if i >= 0 else F.greatest(F.lit(0), size + i)
        moved = self.df.withColumn("idx", F.when(F.col("idx") >= at, F.col("idx") + n).otherwise(F.col("idx")))
        return ArrayView(moved.unionByName(more.withColumn("idx", F.col("idx") + at)))

    def delete(self, start: int, stop: int | None = None) -> ArrayView:
        """Without positions start to stop (only start, without stop); what follows moves down."""
        stop = start + 1 if stop is None else stop
        gone = max(0, stop - start)
        kept = self.df.where((F.col("idx") < start) | (F.col("idx") >= stop))
        return ArrayView(kept.withColumn("idx", F.when(F.col("idx") >= stop, F.col("idx") - gone).otherwise(F.col("idx"))))

    def set(self, values: DataFrame, column: str) -> ArrayView:
        """Replaces ``column`` at the positions that ``values`` (idx, column) names; the length stays."""
        new = values.select("idx", F.col(column).alias("_new"), F.lit(True).alias("_hit"))
        joined = self.df.join(new, "idx", "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
        return ArrayView(joined.select(*self.df.columns))

    def reverse(self) -> ArrayView:
        return ArrayView(self.df.withColumn("idx", self._size() - 1 - F.col("idx")))

    def index_of(self, predicate: Column) -> int | None:
        return self.df.where(predicate).agg(F.min("idx")).first()[0]

    def count_of(self, predicate: Column) -> int:
        return self.df.where(predicate).count()

    def contains(self, predicate: Column) -> bool:
        return not self.df.where(predicate).isEmpty()

    def pop(self, i: int = -1) -> tuple[Row, ArrayView]:
        """The row at i (IndexError if there is none), and the view without it."""
        row = self.get(i)
        return row, self.delete(row["idx"])

    def remove(self, predicate: Column) -> ArrayView:
        """Without the first row that meets the predicate; ValueError if none does."""
        at = self.index_of(predicate)
        if at is None:
            raise ValueError("no such row")
        return self.delete(at)

    def clear(self) -> ArrayView:
        return ArrayView(self.df.limit(0))

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy("idx").toLocalIterator(prefetchPartitions=True)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ArrayView:
        """Keeps the rows once they have been worked out; Spark moves what memory does not hold to disk."""
        self.df.unpersist()
        self.df.persist(level)
        return self

    def unpersist(self) -> ArrayView:
        self.df.unpersist()
        return self

    def spill_to_disk(self) -> ArrayView:
        """Keeps the rows on disk alone."""
        out = self.persist(StorageLevel.DISK_ONLY)
        self.df.count()
        return out

    def load_to_memory(self) -> ArrayView:
        """Keeps the rows in memory alone; what does not fit is worked out again."""
        out = self.persist(StorageLevel.MEMORY_ONLY)
        self.df.count()
        return out

    def memory_usage(self) -> dict[str, int]:
        """Bytes of the kept rows in memory and on disk over all executors (0 where none are kept), and the planner's estimate."""
        out = {"memory": 0, "disk": 0, "estimate": int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))}
        spark = self.df.sparkSession
        held = spark._jsparkSession.sharedState().cacheManager().lookupCachedData(self.df._jdf)
        if held.isDefined():
            name = held.get().cachedRepresentation().cacheBuilder().cachedColumnBuffers().id()
            for info in spark.sparkContext._jsc.sc().getRDDStorageInfo():
                if info.id() == name:
                    out |= {"memory": info.memSize(), "disk": info.diskSize()}
        return out

    def to_list(self) -> list[Row]:
        return self.df.orderBy("idx").collect()


class MapView:
    """The latest value of each key, by a version column."""

    def __init__(self, df: DataFrame, key: str, version: str):
        self.log, self.key, self.version = df, key, version
        self.hits = self.misses = 0
        rest = [c for c in df.columns if c != key]
        self.df = df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("row")).select(key, "row.*")

    def get(self, key, default=None) -> Row | None:
        rows = self.log.where(F.col(self.key) == key).orderBy(F.desc(self.version)).take(1)
        self.hits, self.misses = self.hits + bool(rows), self.misses + (not rows)
        return rows[0] if rows else default

    def __getitem__(self, key) -> Row:
        row = self.get(key)
        if row is None:
            raise KeyError(key)
        return row

    def __contains__(self, key) -> bool:
        return not self.log.where(F.col(self.key) == key).isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def upsert(self, rows: DataFrame) -> MapView:
        return MapView(self.log.unionByName(rows), self.key, self.version)

    update = upsert

    def setdefault(self, rows: DataFrame) -> MapView:
        """Takes in the rows whose keys are not there yet."""
        return self.upsert(rows.join(self.keys(), self.key, "left_anti").select(*rows.columns))

    def pop(self, key, *default) -> tuple[Row, MapView]:
        """The key's row and the view without it; KeyError without a default."""
        row = self.get(key)
        if row is None:
            if not default:
                raise KeyError(key)
            return default[0], self
        return row, self._without(key)

    def popitem(self) -> tuple[Row, MapView]:
        """The row of the latest version and the view without its key; KeyError if there is none."""
        rows = self.log.orderBy(F.desc(self.version), self.key).take(1)
        if not rows:
            raise KeyError("empty")
        return rows[0], self._without(rows[0][self.key])

    def _without(self, key) -> MapView:
        return MapView(self.log.where(~F.col(self.key).eqNullSafe(F.lit(key))), self.key, self.version)

    def clear(self) -> MapView:
        return MapView(self.log.limit(0), self.key, self.version)

    def __iter__(self) -> Iterator:
        return (row[0] for row in self.keys().toLocalIterator(prefetchPartitions=True))

    def remove(self, keys: DataFrame) -> MapView:
        return MapView(self.log.join(keys.select(self.key), self.key, "left_anti").select(*self.log.columns), self.key, self.version)

    def keys(self) -> DataFrame:
        return self.log.select(self.key).distinct()

    def values(self) -> DataFrame:
        return self.df.drop(self.key)

    def items(self) -> DataFrame:
        return self.df

    def stats(self) -> dict[str, int]:
        n, live = self.log.agg(F.count(F.lit(1)), F.count_distinct(self.key)).first()
        return {"records": n, "keys": live, "superseded": n - live}

    def lookups(self) -> dict[str, float]:
        """How many of this view's lookups found their key."""
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}

    def compact(self) -> DataFrame:
        """The live records alone; write them to replace the log."""
        return self.df
