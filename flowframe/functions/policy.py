"""Sizing policies as plain functions and as SQL expressions: chunks, buffers, checkpoints, pressure."""

from __future__ import annotations

from math import floor, isqrt, log2, sqrt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bounds of the square-root policy and the pressure levels' thresholds in percent.
LEAST_CHUNK, MOST_CHUNK, FIXED_CHUNK = 10, 10_000, 1000
LEVELS = (("critical", 95), ("high", 85), ("medium", 70), ("low", 50))
LEAST_INTERVAL = 100
HIERARCHY = (("L1", 32 << 10), ("L2", 256 << 10), ("L3", 8 << 20), ("RAM", 1 << 30))


#: Settings of a session that the engine reads; EngineConfig.apply sets them.
CHUNK_STRATEGY, MEMORY_LIMIT = "flowframe.chunk.strategy", "flowframe.memory.limit"


def driver_memory(spark: SparkSession) -> dict[str, float]:
    """free_bytes and percent_used of the driver's heap, for chunk_size."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    most, used = run.maxMemory(), run.totalMemory() - run.freeMemory()
    return {"free_bytes": most - used, "percent_used": 100.0 * used / most}


def chunk_size(n: int, strategy: str = "sqrt_n", free_bytes: int = 0, percent_used: float = 0.0) -> int:
    """Rows of a chunk for n rows: sqrt_n, memory_based, fixed or adaptive."""
    root = min(MOST_CHUNK, max(LEAST_CHUNK, isqrt(max(0, n))))
    if strategy == "sqrt_n":
        return root
    if strategy == "memory_based":
        return max(1, free_bytes // 10 // 8)
    if strategy == "fixed":
        return FIXED_CHUNK
    if strategy == "adaptive":
        if percent_used > 90:
            return LEAST_CHUNK
        if percent_used > 70:
            return max(LEAST_CHUNK, root // 2)
        return min(MOST_CHUNK, root * 2) if percent_used < 30 else root
    raise ValueError(f"unknown strategy {strategy!r}")


def chunk_size_column(n: Column) -> Column:
    return F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(LEAST_CHUNK), F.floor(F.sqrt(F.greatest(F.lit(0), n))))).cast("bigint")


def williams_bound(t: int) -> int:
    """floor(sqrt(t * log2(t))), 1 for t <= 0."""
    return 1 if t <= 0 else max(1, floor(sqrt(t * log2(max(2, t)))))


def williams_column(t: Column) -> Column:
    return F.when(t <= 0, 1).otherwise(F.floor(F.sqrt(t * F.log2(F.greatest(F.lit(2), t))))).cast("bigint")


def buffer_size(total_bytes: int) -> int:
    """The largest level of the memory hierarchy that total_bytes outgrows, else total_bytes itself."""
    return next((size for _, size in reversed(HIERARCHY) if total_bytes > size), total_bytes)


def hierarchy_column(size: Column) -> Column:
    out = F.lit("disk")
    for name, bound in reversed(HIERARCHY):
        out = F.when(size <= bound, name).otherwise(out)
    return out


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PB"


def parse_bytes(text: str) -> int:
    """Bytes of "512MB", "2 GB" or "1024"."""
    number = text.strip().upper().rstrip("B").strip()
    factor = 1 << 10 * (" KMGTP".index(number[-1]) if number[-1:] in "KMGTP" else 0)
    return int(float(number.rstrip("KMGTP").strip()) * factor)


def pressure_level(percent: Column) -> Column:
    out = F.lit("none")
    for name, least in reversed(LEVELS):
        out = F.when(percent >= least, name).otherwise(out)
    return F.when(percent.isNotNull(), out)


def checkpoint_interval(total: int | None) -> int:
    return LEAST_INTERVAL if not total else max(LEAST_INTERVAL, isqrt(total))


def partitions_for(n_rows: int, row_bytes: int = 100, target_bytes: int = 128 << 20) -> int:
    """Shuffle partitions so that one holds about ``target_bytes``."""
    return max(1, -(-n_rows * row_bytes // target_bytes))


def register(spark: SparkSession) -> None:
    """williams_bound and sqrt_chunk_size as SQL functions, JVM-side."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION williams_bound(t BIGINT) RETURNS BIGINT RETURN CASE WHEN t <= 0 THEN 1 ELSE CAST(floor(sqrt(t * log2(greatest(2, t)))) AS BIGINT) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sqrt_chunk_size(n BIGINT) RETURNS BIGINT RETURN CAST(least({MOST_CHUNK}, greatest({LEAST_CHUNK}, floor(sqrt(greatest(0, n))))) AS BIGINT)")
