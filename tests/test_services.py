import json
import time

import pyarrow as pa
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from flowframe.config import EngineConfig
from flowframe.frame import Frame
from flowframe.functions import policy
from flowframe.operators.collection import ArrayView, MapView
from flowframe.plans import memory, planner, profile
from flowframe.plans.checkpoint import CheckpointManager, CheckpointPolicy, auto_checkpoint, checkpoint_method, recovery_text, restore_attributes, resumable
from flowframe.plans.profile import OperatorMetrics, ProfileContext, QueryProfiler, bottlenecks, profile_memory, profile_time, transitions
from flowframe.plans.profile import profile as profiled
from flowframe.streaming import jobs


def test_policies():
    assert [policy.chunk_size(n) for n in (0, 50, 10_000, 10**9)] == [10, 10, 100, 10_000]
    assert policy.chunk_size(10**4, "fixed") == 1000 and policy.chunk_size(10**4, "memory_based", free_bytes=8000) == 100
    assert [policy.chunk_size(10**4, "adaptive", percent_used=p) for p in (95, 75, 50, 10)] == [10, 50, 100, 200]
    assert [policy.williams_bound(t) for t in (-1, 0, 1, 1000)] == [1, 1, 1, 99]
    assert policy.parse_bytes("512MB") == 512 << 20 and policy.parse_bytes("1 gb") == 1 << 30 and policy.parse_bytes("1024") == 1024
    assert policy.format_bytes(1536) == "1.50 KB"
    assert policy.checkpoint_interval(None) == 100 and policy.checkpoint_interval(10**6) == 1000


def test_policy_sql_functions(spark):
    policy.register(spark)
    row = spark.sql("SELECT williams_bound(1000L) AS w, sqrt_chunk_size(10000L) AS c").first()
    assert (row.w, row.c) == (99, 100)


def test_config(spark):
    config = EngineConfig().with_defaults(compression="snappy", shuffle_partitions=3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    config.apply(spark)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for bad in ({"nonsense": 1}, {"compression": "rar"}, {"chunk_strategy": "SQRT"}, {"memory_limit": "lots"}):
        with pytest.raises(ValueError):
            EngineConfig().with_defaults(**bad)


def test_checkpoints(spark, tmp_path):
    m = CheckpointManager(spark, f"file://{tmp_path}/c", keep=3)
    assert m.restore("job") is None
    for i in range(5):
        m.save("job", {"i": i}, i * 100)
    m.save("other", spark.range(4), 1)
    assert [s.iteration for s, _ in m.list("job")] == [200, 300, 400]
    assert m.restore("job")[1] == {"i": 4} and m.restore("job", 200)[1] == {"i": 2}
    assert m.restore("other")[1].count() == 4
    assert m.stats("job")["count"] == 3 and m.delete("job") == 3 and m.restore("job") is None


def test_resumable_goes_on_after_a_failure(spark, tmp_path):
    m = CheckpointManager(spark, f"file://{tmp_path}/c")
    calls = []

    def step(state, i):
        calls.append(i)
        if i == 250 and calls.count(250) == 1:
            raise RuntimeError("lost")
        return {"sum": state["sum"] + i}

    run = resumable(m, "sum")(step)
    with pytest.raises(RuntimeError):
        run({"sum": 0}, 400)
    assert run({"sum": 0}, 400)["sum"] == sum(range(400))
    assert calls.count(150) == 1 and calls.count(220) == 2


def test_checkpoint_policy():
    p = CheckpointPolicy("sqrt_n", total=40_000)
    assert [i for i in range(1, 601) if p.reason(i) and not p.saved(i)] == [200, 400, 600]
    assert CheckpointPolicy("memory_pressure", pressed=lambda: True).reason(1) == "memory_pressure"
    assert CheckpointPolicy("time_based", seconds=0).reason(1) == "time_based"


def test_memory(spark):
    m = memory.MemoryMonitor(spark, "1MB")
    told = []
    m.add_handler(lambda level, info: told.append(level))
    m.add_handler(lambda level, info: 1 / 0)
    assert m.check() == "critical" == told[0] and m.should_cleanup() and not m.can_allocate(1)
    assert memory.trend(spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 10, 20])], "at int, percent double")).first() == (7.2, 20.0, 11.0 - 1.5)
    assert memory.trend(spark.createDataFrame([], "at int, percent double")).first() == (None, None, 0.0)
    evict = memory.CacheEvictionHandler()
    for _ in range(4):
        evict.register(spark.range(3).persist())
    evict("high", memory.sample(spark))
    assert len(evict.frames) == 2


def test_profiles(spark, tmp_path):
    _, report = profile.QueryProfiler().profile(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count())
    assert report.rows == 3 and report.exchanges >= 1
    report.save(str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["rows"] == 3
    assert profile.opportunities("Exchange SinglePartition") and not profile.opportunities("Exchange hashpartitioning")
    one = lambda xs: profile.access_pattern(spark.createDataFrame(list(enumerate(xs)), "o int, a long"), "o", "a").first().pattern
    assert [one(x) for x in ([1, 2, 3], [1, 5, 9], [1, 9, 2], [1])] == ["sequential", "strided", "random", "unknown"]


def test_streams_take_each_file_in_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(10).write.parquet(source)
    for want in (10, 10, 15):
        if want == 15:
            spark.range(10, 15).write.mode("append").parquet(source)
        jobs.run_available(spark.readStream.schema("id bigint").parquet(source), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert spark.read.parquet(f"{tmp_path}/out").count() == want


def test_count_windows_on_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", float(i)) for i in range(7)] + [("b", 1.0)], "k string, v double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, v double").parquet(source)
    out = jobs.count_windows(stream, "k", "v", 3)
    query = out.writeStream.format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("counted").collect()) == [("a", 0, 3.0), ("a", 1, 12.0)]


def test_first_of_key_on_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(source)
    stream = spark.readStream.schema("k int, ts timestamp_ntz").parquet(source)
    query = jobs.first_of_key(stream, ["k"], "ts", "1 minute").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]


def test_settings_take_effect(spark, tmp_path):
    config = EngineConfig(memory_limit="64MB", chunk_strategy="sqrt_n", compression="lz4", max_partition_bytes="32MB")
    assert config.session_settings() == {"spark.io.compression.codec": "lz4", "spark.shuffle.compress": "true"}
    assert EngineConfig(compression="none", checkpoint_dir="/x").session_settings() == {"spark.shuffle.compress": "false", "spark.checkpoint.dir": "/x"}
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.parquet.compression.codec", "spark.sql.files.maxPartitionBytes")}
    for key in (policy.CHUNK_STRATEGY, policy.MEMORY_LIMIT):
        spark.conf.unset(key)
    rows = Frame(spark.range(400).toDF("k"), ["k"])
    assert rows.chunk().count() == 1
    try:
        config.apply(spark)
        assert spark.conf.get("spark.sql.parquet.compression.codec") == "lz4" and spark.conf.get("spark.sql.files.maxPartitionBytes") == str(32 << 20)
        assert memory.MemoryMonitor(spark).limit == 64 << 20 and memory.MemoryMonitor(spark, limit=5).limit == 5
        assert rows.chunk().count() == 20 and rows.chunk(7).count() == 58
        EngineConfig(chunk_strategy="memory_based").apply(spark)
        assert rows.chunk().count() == 1 and memory.MemoryMonitor(spark).limit is None
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
        for key in (policy.CHUNK_STRATEGY, policy.MEMORY_LIMIT):
            spark.conf.unset(key)
    with pytest.raises(ValueError):
        EngineConfig(chunk_strategy="guess")
    with pytest.raises(ValueError):
        config.with_defaults(colour="red")


def test_array_view_verbs(spark):
    view = ArrayView.of(spark.createDataFrame([(i, i * i % 7) for i in range(10)], "k int, v int"), ["k"])
    row, rest = view.pop()
    assert row.k == 9 and len(rest) == 9 and [r.k for r in rest] == list(range(9))
    row, rest = view.pop(2)
    assert row.k == 2 and [r.idx for r in rest.to_list()] == list(range(9))
    assert [r.k for r in view.remove(F.col("v") == 2)] == [k for k in range(10) if k != 3]
    assert view.contains(F.col("v") == 4) and not view.contains(F.col("v") == 3) and len(view.clear()) == 0
    with pytest.raises(ValueError):
        view.remove(F.col("v") == 99)
    with pytest.raises(IndexError):
        view.clear().pop()
    assert view.memory_usage()["memory"] == 0 and view.memory_usage()["estimate"] > 0
    assert view.load_to_memory().memory_usage()["memory"] > 0
    held = view.spill_to_disk().memory_usage()
    assert held["disk"] > 0 and held["memory"] == 0 and len(view.unpersist()) == 10


def test_map_view_verbs(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, n int, v int")
    view = MapView(df([("a", 1, 10), ("a", 3, 11), ("b", 2, 20)]), "k", "n")
    assert sorted(view) == ["a", "b"] and sorted(r.v for r in view.values().collect()) == [11, 20]
    assert view["a"].v == 11 and view.get("z") is None
    with pytest.raises(KeyError):
        view["z"]
    assert view.stats() == {"records": 3, "keys": 2, "superseded": 1} and view.lookups() == {"hits": 1, "misses": 2, "hit_rate": 1 / 3}
    row, rest = view.pop("a")
    assert row.v == 11 and list(rest) == ["b"] and view.pop("z", 5)[0] == 5
    with pytest.raises(KeyError):
        view.pop("z")
    row, rest = view.popitem()
    assert row.k == "a" and list(rest) == ["b"]
    assert view.update(df([("b", 9, 21)]))["b"].v == 21
    more = view.setdefault(df([("b", 9, 99), ("c", 9, 30)]))
    assert more["b"].v == 20 and more["c"].v == 30 and len(view.clear()) == 0
    with pytest.raises(KeyError):
        view.clear().popitem()


def test_metrics_of_the_plan_that_ran(spark, tmp_path):
    spark.range(5000).withColumn("g", F.col("id") % 7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").groupBy("g").agg(F.sum("id").alias("s"))
    _, report = QueryProfiler().profile(df, "sums")
    by = {o.name.split(" ")[0]: o for o in report.operators}
    assert report.rows == 7 and report.exchanges == 1 and report.scans == 1 and report.total("shuffleBytesWritten") > 0
    assert by["Scan"].metrics["numOutputRows"] == 5000 and any(o.partition_bytes for o in report.operators) and report.hotspots()
    assert "sums" in report.summary() and '"operators"' in report.to_json()
    count, by_action = QueryProfiler().profile(df, action=lambda d: d.count())
    assert count == 7 and by_action.operators == []
    found = bottlenecks([OperatorMetrics("Sort", {"spillSize": 5 << 20}), OperatorMetrics("Exchange", {"shuffleBytesWritten": 9 << 20}, [1 << 10, 1 << 10, 8 << 20]), OperatorMetrics("Scan", {"filesSize": 1 << 20})])
    assert len(found) == 3 and "spilled" in found[0] and "median" in found[1] and "shuffled" in found[2]

    @profiled
    def frame():
        return spark.range(10)

    assert frame()[1].rows == 10
    assert profile_time(lambda: 5)()[0] == 5 and profile_time(lambda: 5)()[1] >= 0
    assert profile_memory(spark)(lambda: 6)()[0] == 6
    with ProfileContext(spark, "block") as block:
        spark.range(10).count()
    assert block.seconds > 0 and block.heap_after > 0 and "block" in block.summary()
    sizes = spark.createDataFrame([(0, 1 << 10), (1, 1 << 20), (2, 1 << 10), (3, 1 << 11), (4, 1 << 40)], "at int, n bigint")
    assert {(r.before, r.after, r.n) for r in transitions(sizes, "at", "n").collect()} == {("L1", "L3", 1), ("L3", "L1", 1), ("L1", "disk", 1)}


def test_waiting_for_memory_and_executors(spark):
    monitor = memory.MemoryMonitor(spark)
    assert monitor.wait_for_memory(1, timeout=1) and not monitor.wait_for_memory(1 << 60, timeout=0.2, pause=0.05)
    assert memory.force_gc(spark) >= 0
    assert all(info.total > 0 and 0 <= info.percent <= 100 for info in memory.sample_executors(spark).values()) and set(monitor.executor_pressure().values()) == {"none"}


def test_handlers(spark, caplog):
    info = lambda at, percent: memory.MemoryInfo(at, percent, 100)
    log = memory.LoggingHandler(quiet=60)
    with caplog.at_level("WARNING"):
        for at, level in ((0, "high"), (30, "high"), (30, "low"), (61, "high")):
            log(level, info(at, 90))
    assert len(caplog.records) == 3
    told = []
    throttle = memory.ThrottlingHandler()
    throttle.callbacks.append(told.append)
    for level in ("low", "medium", "high", "critical"):
        throttle(level, info(0, 90))
    assert told == [0.0, 0.1, 0.5, 2.0]
    memory.GarbageCollectionHandler(spark)("critical", info(0, 96))
    memory.GarbageCollectionHandler(spark)("low", info(0, 55))
    spill = memory.SpillHandler()
    df = spill.register(spark.range(10).persist())
    spill("low", info(0, 55))
    assert df.storageLevel.useMemory
    spill("high", info(0, 90))
    assert df.storageLevel == StorageLevel.DISK_ONLY and df.count() == 10
    df.unpersist()


def test_generators_and_methods_resume(spark, tmp_path):
    manager = CheckpointManager(spark, f"file://{tmp_path}/c")
    every = CheckpointPolicy(strategy="memory_pressure", pressed=lambda: True)
    assert "start it anew" in recovery_text(manager, "count")

    @auto_checkpoint(manager, "count", every)
    def count(n, resume=None):
        first = resume[1]["i"] + 1 if resume else 0
        for i in range(first, n):
            yield {"i": i}

    run = count(5)
    assert [next(run)["i"] for _ in range(3)] == [0, 1, 2]
    run.close()  # as if the process had gone
    assert "restore('count')" in recovery_text(manager, "count") and "iteration 3" in recovery_text(manager, "count")
    assert [s["i"] for s in count(5)] == [3, 4]
    assert manager.list("count") == []

    class Sum:
        job = "sums"

        def __init__(self):
            self.checkpoints, self.total = manager, 0

        @checkpoint_method(["total"], policy=every)
        def add(self, x):
            self.total += x
            return self.total

    one = Sum()
    assert [one.add(x) for x in (1, 2, 3)] == [1, 3, 6]
    other = Sum()
    assert restore_attributes(other, manager) == 3 and other.add(4) == 10
    assert restore_attributes(Sum(), CheckpointManager(spark, f"file://{tmp_path}/none")) == 0


def test_layers_from_shapes(spark):
    shapes = spark.createDataFrame([(0, "c", "Conv2d", 3, 16, 3), (1, "l", "Linear", 100, 10, None), (2, "n", "BatchNorm", 32, None, None), (3, "r", "ReLU", None, None, None)], "idx bigint, name string, type string, inputs int, outputs int, kernel int")
    got = {r.name: (r.params, r.activation_bytes) for r in planner.shaped_layers(shapes).collect()}
    assert got == {"c": (3 * 16 * 9 + 16, 16 * 10_000 * 4), "l": (1010, 40), "n": (32, 128), "r": (0, 0)}
    assert [r.name for r in planner.bottlenecks(planner.shaped_layers(shapes)).collect()] == ["c"]


def test_rows_and_batches_through_python(spark, tmp_path):
    frame = Frame(spark.range(10).toDF("k").repartition(2), ["k"])
    folder = str(tmp_path)

    def touch(rows):
        for r in rows:
            open(f"{folder}/{r.k}", "w").close()

    frame.foreach_partition(touch)
    assert len(list(tmp_path.iterdir())) == 10

    def double(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"k": pa.array([2 * x for x in batch.column(0).to_pylist()], pa.int64())})

    assert [r.k for r in frame.map_batches(double, "k bigint").collect()] == list(range(0, 20, 2))
    assert [r.j for r in frame.transform(lambda d: d.withColumn("j", F.col("k") + 1)).collect()] == list(range(1, 11))


def feed(spark, path, rows):
    spark.createDataFrame(rows, "k string, n bigint, v bigint").coalesce(1).write.mode("append").parquet(path)


def test_drop_while_on_a_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows, want in (([("a", 1, 1), ("a", 2, 2), ("b", 1, 9)], [("b", 1, 9)]), ([("a", 4, 1), ("a", 3, 7), ("b", 2, 1), ("c", 1, None)], [("a", 3, 7), ("a", 4, 1), ("b", 1, 9), ("b", 2, 1), ("c", 1, None)])):
        feed(spark, source, rows)
        stream = spark.readStream.schema("k string, n bigint, v bigint").parquet(source)
        jobs.run_available(jobs.drop_while(stream, "k", "n", F.col("v") < 5), out, f"{tmp_path}/cp")
        assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def within(seconds, test):
    """Whether the test comes true in time; batches of streams that wait for timeouts never end."""
    end = time.monotonic() + seconds
    while not (done := test()) and time.monotonic() < end:
        time.sleep(0.3)
    return done


def test_latest_values_and_eviction_on_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    feed(spark, source, [("a", 2, 20), ("a", 1, 10), ("b", 1, 5)])
    stream = spark.readStream.schema("k string, n bigint, v bigint").parquet(source)
    query = jobs.latest_by_key(stream, "k", "n", "v", idle_ms=8000).writeStream.outputMode("update").format("memory").queryName("latest").trigger(processingTime="200 milliseconds").start()
    told = lambda live: sorted(tuple(r)[:3] for r in spark.table("latest").where(F.col("live") == live).collect())
    try:
        assert within(30, lambda: told(True) == [("a", 2, 20), ("b", 1, 5)])
        feed(spark, source, [("a", 1, 99), ("b", 3, 6)])
        assert within(30, lambda: told(True) == [("a", 2, 20), ("b", 1, 5), ("b", 3, 6)])
        assert within(40, lambda: told(False) == [("a", 2, 20), ("b", 3, 6)])
    finally:
        query.stop()


def test_idle_count_windows_are_forgotten(spark, tmp_path):
    source = f"{tmp_path}/in"
    feed(spark, source, [("a", 1, 1), ("a", 2, 2)])
    stream = spark.readStream.schema("k string, n bigint, v bigint").parquet(source)
    query = jobs.count_windows(stream, "k", "v", 3, idle_ms=300).writeStream.outputMode("append").format("memory").queryName("idle").trigger(processingTime="100 milliseconds").start()
    try:
        held = lambda: (query.lastProgress or {}).get("stateOperators", [{}])[0]
        assert within(30, lambda: held().get("numRowsTotal") == 1) and within(30, lambda: held().get("numRowsTotal") == 0)
        feed(spark, source, [("a", 3, 3), ("a", 4, 4), ("a", 5, 5)])
        assert within(30, lambda: [tuple(r) for r in spark.table("idle").collect()] == [("a", 0, 12.0)])
    finally:
        query.stop()
