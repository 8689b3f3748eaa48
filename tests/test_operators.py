import bisect
import random

import pytest
from pyspark.sql import functions as F

from flowframe.operators import joins
from flowframe.operators.batch import BatchProcessor
from flowframe.operators.collection import ArrayView, MapView


def array(spark, n):
    return ArrayView.of(spark.range(n).select(F.col("id").alias("v")), ["v"])


def listed(view):
    return [r.v for r in view.to_list()]


def test_array_views_follow_lists(spark):
    a, plain = array(spark, 8), list(range(8))
    assert len(a) == 8 and a.get(-1).v == 7 and a.get(2).v == 2
    with pytest.raises(IndexError):
        a.get(8)
    for s in [(None, None, 1), (1, 6, 2), (-3, None, 1), (0, -2, 3), (5, 2, 1)]:
        assert [r.v for r in a.slice(*s).orderBy("idx").collect()] == plain[slice(*s)]
    more = spark.createDataFrame([(100,), (101,)], "v bigint")
    assert listed(a.append(more, ["v"])) == plain + [100, 101]
    assert listed(a.insert(3, more, ["v"])) == plain[:3] + [100, 101] + plain[3:]
    assert listed(a.insert(99, more, ["v"])) == plain + [100, 101]
    assert listed(a.delete(2, 5)) == plain[:2] + plain[5:]
    assert listed(a.reverse()) == plain[::-1]
    assert listed(a.set(spark.createDataFrame([(1, -1)], "idx bigint, v bigint"), "v")) == [0, -1, *range(2, 8)]
    assert a.index_of(F.col("v") == 5) == 5 and a.index_of(F.col("v") == 50) is None
    assert a.count_of(F.col("v") > 5) == 2


def test_map_view(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, version int, v string")
    m = MapView(log, "k", "version")
    assert {r.k: r.v for r in m.items().collect()} == {"a": "z", "b": "y"}
    assert m.get("a").v == "z" and m.get("q") is None and "b" in m and "q" not in m and len(m) == 2
    m = m.upsert(spark.createDataFrame([("b", 9, "w")], log.schema)).remove(spark.createDataFrame([("a",)], "k string"))
    assert {r.k: r.v for r in m.items().collect()} == {"b": "w"}
    assert m.stats() == {"records": 2, "keys": 1, "superseded": 1}


@pytest.mark.parametrize("bucketed", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_bisection(spark, bucketed, strict):
    rng = random.Random(3)
    right = [(rng.choice("ab"), t, t * 10) for t in rng.sample(range(100), 30)]
    left = [(i, rng.choice("abc"), rng.randrange(100)) for i in range(60)]
    got = joins.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "t", ["k"], ["v"], strict=strict,
                          bucket=F.floor(F.col("t") / 7) if bucketed else None)
    for r in got.collect():
        times = sorted(t for k, t, _ in right if k == r.k)
        at = (bisect.bisect_left if strict else bisect.bisect_right)(times, r.t)
        assert r.v_asof == (times[at - 1] * 10 if at else None)


def test_range_join(spark):
    points = spark.createDataFrame([(float(x),) for x in range(20)], "x double")
    ranges = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 15.0), (3, 9.0, 9.0), (4, 8.0, 3.0)], "r int, low double, high double")
    got = sorted((r.x, r.r) for r in joins.range_join(points, ranges, F.col("x"), F.col("low"), F.col("high"), 3.0).collect())
    assert got == sorted((float(x), r) for x in range(20) for r, a, b in [(1, 2, 5), (2, 4, 15), (3, 9, 9), (4, 8, 3)] if a <= x < b)


def test_lookup_policies(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.lookup(rows, table, "k").count() == 2
    assert joins.lookup(rows, table, "k", miss="drop").count() == 1
    plan = joins.lookup(rows, spark.range(5).select(F.col("id").cast("int").alias("k")), "k", most_rows=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_batches_count_failures(spark):
    def work(batch):
        if 7 in batch.column(0).to_pylist():
            raise ValueError("seven")

    results = BatchProcessor(5).process(spark.range(0, 20, 1, 2), work)
    assert BatchProcessor.summary(results).first() == (20, 15, 5)
    assert results.where("not ok").first().error == "ValueError: seven"
    assert BatchProcessor.summary(BatchProcessor().process(spark.range(0), work)).first() == (0, 0, 0)
