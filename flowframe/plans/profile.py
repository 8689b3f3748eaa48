"""Profiles of actions: time, rows, plan, and rules over them; access patterns of positions."""

from __future__ import annotations

import functools
import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.functions.policy import format_bytes, hierarchy_column
from flowframe.operators.ordering import neighbour
from flowframe.plans.memory import force_gc, sample


#: From these on a shuffle counts as skewed and an operator's spill as one.
SKEW_FACTOR, LEAST_SKEW_BYTES = 5.0, 1 << 20


@dataclass
class OperatorMetrics:
    """One operator of the plan that was run: its SQL metrics, and a shuffle's bytes by partition."""

    name: str
    metrics: dict[str, int]
    partition_bytes: list[int] = field(default_factory=list)

    @property
    def milliseconds(self) -> int:
        """What the operator tells of its time; operators in one generated stage share the stage's."""
        return sum(v for k, v in self.metrics.items() if k in ("pipelineTime", "sortTime", "aggTime", "scanTime", "buildTime", "broadcastTime", "collectTime", "fetchWaitTime"))

    @property
    def skew(self) -> float:
        """The largest partition against the median one."""
        sizes = sorted(self.partition_bytes)
        middle = sizes[len(sizes) // 2] if sizes else 0
        return sizes[-1] / max(1, middle) if sizes and sizes[-1] >= LEAST_SKEW_BYTES else 1.0


@dataclass
class ProfilingReport:
    name: str
    seconds: float
    rows: int | None = None
    exchanges: int = 0
    python_nodes: int = 0
    scans: int = 0
    opportunities: list[str] = field(default_factory=list)
    operators: list[OperatorMetrics] = field(default_factory=list)
    bottlenecks: list[str] = field(default_factory=list)
    peak_heap_bytes: int = 0

    def hotspots(self, n: int = 5) -> list[OperatorMetrics]:
        """The operators that took longest."""
        return sorted((o for o in self.operators if o.milliseconds), key=lambda o: -o.milliseconds)[:n]

    def total(self, metric: str) -> int:
        return sum(o.metrics.get(metric, 0) for o in self.operators)

    def summary(self) -> str:
        lines = [f"{self.name}: {self.seconds:.3f} s, {'?' if self.rows is None else self.rows} rows, {self.exchanges} exchanges, {self.scans} scans",
                 f"shuffled {format_bytes(self.total('shuffleBytesWritten'))}, spilled {format_bytes(self.total('spillSize'))}, driver heap {format_bytes(self.peak_heap_bytes)}"]
        lines += [f"hot: {o.name}, {o.milliseconds} ms" for o in self.hotspots()]
        return "\n".join([*lines, *(f"bottleneck: {x}" for x in self.bottlenecks), *(f"look at: {x}" for x in self.opportunities)])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def save(self, path: str) -> None:
        with open(path, "w") as out:
            out.write(self.to_json())


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def opportunities(plan: str) -> list[str]:
    """What a plan's text suggests to look at."""
    found = []
    if re.search(r"BatchEvalPython", plan):
        found.append("row-at-a-time Python functions: use columns or Arrow functions")
    if re.search(r"Exchange SinglePartition", plan):
        found.append("all rows in one task: give the window a partition or use a top-k")
    if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan):
        found.append("a join without an equality: add a bucket to join on")
    return found


def bottlenecks(operators: list[OperatorMetrics]) -> list[str]:
    """What the metrics of a run show: spill, skewed shuffles, shuffles larger than what was scanned."""
    found = [f"{o.name} spilled {format_bytes(o.metrics['spillSize'])}" for o in operators if o.metrics.get("spillSize")]
    found += [f"{o.name}: the largest partition holds {o.skew:.0f} times the median" for o in operators if o.skew >= SKEW_FACTOR]
    shuffled, scanned = (sum(o.metrics.get(m, 0) for o in operators) for m in ("shuffleBytesWritten", "filesSize"))
    if scanned and shuffled > max(LEAST_SKEW_BYTES, scanned):
        found.append(f"{format_bytes(shuffled)} shuffled for {format_bytes(scanned)} of files")
    return found


def operator_metrics(df: DataFrame, plan) -> list[OperatorMetrics]:
    """The operators of an executed plan, from the result down; adaptive stages are walked through."""
    java = df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    out, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
            continue
        sizes: list[int] = []
        if kind.endswith("QueryStageExec"):
            if kind == "ShuffleQueryStageExec" and node.mapStats().isDefined():
                sizes = [int(x) for x in node.mapStats().get().bytesByPartitionId()]
            node = node.plan()
        metrics = java(node.metrics())
        if kind not in ("InputAdapter",):
            out.append(OperatorMetrics(node.nodeName(), {str(k): int(metrics[k].value()) for k in metrics}, sizes))
        waiting.extend(reversed(list(java(node.children()))))
    return out


class QueryProfiler:
    def profile(self, df: DataFrame, name: str = "query", action: Callable[[DataFrame], object] | None = None) -> tuple[object, ProfilingReport]:
        """Runs the action (a full evaluation without result, by default) and reports on it.

        The default runs the frame's own plan, so that its metrics are those of the run; of another
        action the plan is told as it was planned, without metrics.
        """
        began = time.perf_counter()
        if action is None:
            query = df._jdf.queryExecution()
            result, rows = None, int(query.toRdd().count())
            plan = query.executedPlan()
            operators = operator_metrics(df, plan)
        else:
            result, rows, operators = action(df), None, []
            plan = df._jdf.queryExecution().executedPlan()
        seconds = time.perf_counter() - began
        text = re.split(r"\+?-? ?== Initial Plan ==", plan.toString())[0]
        run = df.sparkSession._jvm.java.lang.Runtime.getRuntime()
        return result, ProfilingReport(name, seconds, rows, len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", text)), len(re.findall("Python|Pandas|Arrow", text)), len(re.findall("FileScan|Scan parquet", text)),
                                       opportunities(text), operators, bottlenecks(operators), run.totalMemory() - run.freeMemory())


def profile(fn):
    """For functions that return a frame: the frame's rows are worked out, and (frame, report) is returned."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        df = fn(*args, **kwargs)
        return df, QueryProfiler().profile(df, fn.__name__)[1]

    return run


def profile_time(fn):
    """The function's result and its seconds."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        began = time.perf_counter()
        return fn(*args, **kwargs), time.perf_counter() - began

    return run


def profile_memory(spark: SparkSession):
    """For functions: the result and how many bytes more of the driver's heap are used after it, garbage collected."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(*args, **kwargs):
            force_gc(spark)
            before = sample(spark).used
            result = fn(*args, **kwargs)
            force_gc(spark)
            return result, sample(spark).used - before

        return run

    return wrap


class ProfileContext:
    """A block's seconds and the driver's heap at its begin and end: ``with ProfileContext(spark, "load") as p``."""

    def __init__(self, spark: SparkSession, name: str = "block"):
        self.spark, self.name = spark, name
        self.seconds = self.heap_before = self.heap_after = 0

    def __enter__(self) -> ProfileContext:
        self.heap_before, self._began = sample(self.spark).used, time.perf_counter()
        return self

    def __exit__(self, *fault) -> None:
        self.seconds, self.heap_after = time.perf_counter() - self._began, sample(self.spark).used

    def summary(self) -> str:
        return f"{self.name}: {self.seconds:.3f} s, driver heap {format_bytes(self.heap_before)} to {format_bytes(self.heap_after)}"


def transitions(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """(before, after, n): how often the memory level that a size fits in changes from one row to the next."""
    levels = sizes.select(order, hierarchy_column(F.col(size)).alias("after"))
    steps = neighbour(levels, [order], "after", 1, "before")
    return steps.where("before is not null and before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def access_pattern(df: DataFrame, order: str, address: str, by: list[str] | None = None) -> DataFrame:
    """sequential (steps of 1), strided (equal steps), random (others) or unknown (fewer than two), by key."""
    by = by or []
    if by:
        before = df.select(*by, address, F.lag(address).over(Window.partitionBy(*by).orderBy(order)).alias("before"))
    else:
        before = neighbour(df.select(*dict.fromkeys([order, address])), [order], address, 1, "before")
    steps = before.select(*by, (F.col(address) - F.col("before")).cast("double").alias("step"))
    spread = F.stddev_pop("step")
    kind = F.when(F.count("step") < 1, "unknown").when((spread == 0) & (F.avg("step") == 1), "sequential").when(spread == 0, "strided").otherwise("random")
    return (steps.groupBy(*by) if by else steps).agg(kind.alias("pattern"))
