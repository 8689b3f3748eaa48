"""Memory metrics: samples, pressure, trend, and handlers that react to pressure."""

from __future__ import annotations

import logging
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.functions.policy import LEVELS, MEMORY_LIMIT, parse_bytes
from flowframe.operators.ordering import free_name, with_index

log = logging.getLogger(__name__)
NAMES = ("none", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class MemoryInfo:
    at: float
    used: int
    total: int

    @property
    def available(self) -> int:
        return max(0, self.total - self.used)

    @property
    def percent(self) -> float:
        return 100.0 * self.used / self.total if self.total else 0.0

    @property
    def level(self) -> str:
        return next((name for name, least in LEVELS if self.percent >= least), "none")


def sample(spark: SparkSession, limit: int | None = None) -> MemoryInfo:
    """The driver JVM's heap, against the heap's or the given limit."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    total = run.maxMemory()
    return MemoryInfo(time.time(), run.totalMemory() - run.freeMemory(), min(total, limit) if limit else total)


def sample_executors(spark: SparkSession) -> dict[str, MemoryInfo]:
    """The storage memory of each executor, by its address, as the driver's block manager knows it; the driver is among them."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    held = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status)
    now = time.time()
    return {str(at): MemoryInfo(now, most - left, most) for at in held for most, left in ((int(held[at]._1()), int(held[at]._2())),)}


def force_gc(spark: SparkSession) -> int:
    """Asks the driver's JVM to collect garbage; the bytes that it freed."""
    before = sample(spark).used
    spark._jvm.System.gc()
    return max(0, before - sample(spark).used)


def trend(samples: DataFrame, at: str = "at", value: str = "percent") -> DataFrame:
    """(average, maximum, trend): trend is the later half's mean less the earlier half's, 0 under two samples.

    Samples are numbered by key ranges and then aggregated, so there may be any number of them.
    """
    rows = samples.select(at, value)
    n, place = rows.count(), free_name(rows, "place")
    number, late = F.col(value).cast("double"), F.col(place) >= n // 2
    mean = lambda part: F.sum(F.when(part, number)) / F.count_if(part)
    return with_index(rows, [at, value], place).agg(mean(F.lit(True)).alias("average") if n else F.lit(None).cast("double").alias("average"), F.max(number).alias("maximum"),
                                              (mean(late) - mean(~late) if n > 1 else F.lit(0.0)).alias("trend"))


class MemoryMonitor:
    """Samples memory on request or in the background, keeps 100 samples, and tells handlers of pressure.

    ``limit`` bounds what counts as the total; without one the session's setting does, if there is any.
    """

    def __init__(self, spark: SparkSession, limit: str | int | None = None, interval: float = 5.0):
        self.spark, self.interval = spark, interval
        limit = spark.conf.get(MEMORY_LIMIT, None) if limit is None else limit
        self.limit = parse_bytes(limit) if isinstance(limit, str) else limit
        self.history: deque[MemoryInfo] = deque(maxlen=100)
        self.handlers: list[Callable[[str, MemoryInfo], None]] = []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def add_handler(self, handler: Callable[[str, MemoryInfo], None]) -> None:
        self.handlers.append(handler)

    def check(self) -> str:
        info = sample(self.spark, self.limit)
        self.history.append(info)
        if info.level != "none":
            for handler in self.handlers:
                try:
                    handler(info.level, info)
                except Exception:
                    log.exception("a memory handler failed")
        return info.level

    def should_cleanup(self) -> bool:
        return NAMES.index(self.check()) >= NAMES.index("high")

    def can_allocate(self, size: int) -> bool:
        return sample(self.spark, self.limit).available >= size

    def wait_for_memory(self, size: int, timeout: float = 30.0, pause: float = 0.5) -> bool:
        """Whether so many bytes become available in time; collects garbage and tells handlers meanwhile."""
        end = time.monotonic() + timeout
        while not (enough := self.can_allocate(size)) and time.monotonic() < end:
            force_gc(self.spark)
            self.check()
            time.sleep(min(pause, max(0.0, end - time.monotonic())))
        return enough

    def executor_pressure(self) -> dict[str, str]:
        """The level of each executor's storage memory."""
        return {at: info.level for at, info in sample_executors(self.spark).items()}

    def trend(self) -> DataFrame:
        rows = [(i.at, i.percent) for i in self.history]
        return trend(self.spark.createDataFrame(rows, "at double, percent double"))

    def start(self) -> None:
        def run() -> None:
            while not self._stop.wait(self.interval):
                self.check()

        self._stop.clear()
        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()


class LoggingHandler:
    """Logs pressure, a level at most once in ``quiet`` seconds."""

    def __init__(self, quiet: float = 60.0):
        self.quiet, self.last = quiet, {}

    def __call__(self, level: str, info: MemoryInfo) -> None:
        if info.at - self.last.get(level, float("-inf")) >= self.quiet:
            self.last[level] = info.at
            log.warning("memory pressure %s: %.1f %%", level, info.percent)


class CacheEvictionHandler:
    """Unpersists registered frames, oldest first: a larger share the higher the level."""

    SHARE = {"low": 0.10, "medium": 0.25, "high": 0.50, "critical": 0.90}

    def __init__(self):
        self.frames: list[DataFrame] = []

    def register(self, df: DataFrame) -> DataFrame:
        self.frames.append(df)
        return df

    def __call__(self, level: str, info: MemoryInfo) -> None:
        n = max(1, int(len(self.frames) * self.SHARE[level])) if self.frames else 0
        for df in self.frames[:n]:
            df.unpersist()
        del self.frames[:n]


class GarbageCollectionHandler:
    """Asks the JVM to collect garbage at high levels."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, level: str, info: MemoryInfo) -> None:
        if level in ("high", "critical"):
            self.spark._jvm.System.gc()


class ThrottlingHandler:
    """Tells callbacks how long to wait between batches."""

    DELAY = {"low": 0.0, "medium": 0.1, "high": 0.5, "critical": 2.0}

    def __init__(self):
        self.callbacks: list[Callable[[float], None]] = []

    def __call__(self, level: str, info: MemoryInfo) -> None:
        for tell in self.callbacks:
            tell(self.DELAY[level])


class SpillHandler(CacheEvictionHandler):
    """Moves registered frames from memory to disk."""

    def __call__(self, level: str, info: MemoryInfo) -> None:
        from pyspark import StorageLevel

        if level in ("high", "critical"):
            for df in self.frames:
                df.unpersist()
                df.persist(StorageLevel.DISK_ONLY)
