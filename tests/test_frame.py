import asyncio
import random

import pytest
from pyspark.sql import functions as F

from flowframe.frame import Frame
from flowframe.operators.ordering import with_index
from flowframe.sources import readers


def numbers(spark, values):
    return readers.from_iterable(spark, values, "v int")


def values(frame):
    return [r.v for r in frame.collect()]


def test_take_skip_first(spark):
    f = numbers(spark, range(10))
    assert values(f.take(3)) == [0, 1, 2]
    assert values(f.take(0)) == [] == values(f.take(-1))
    assert values(f.skip(8)) == [8, 9]
    assert f.first().v == 0
    assert numbers(spark, []).first() is None


def test_take_plans_as_top_k(spark):
    plan = numbers(spark, range(10)).take(3).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("reverse", [False, True])
def test_sort_is_stable(spark, reverse):
    rows = readers.from_iterable(spark, [(1, 0), (0, 1), (1, 2), (0, 3)], "k int, n int")
    got = [(r.k, r.n) for r in rows.sort("k", reverse=reverse).collect()]
    assert got == sorted([(1, 0), (0, 1), (1, 2), (0, 3)], key=lambda r: r[0], reverse=reverse)


def test_sort_then_take_keeps_the_direction(spark):
    f = numbers(spark, [3, 1, 2, 5, 4]).sort("v", reverse=True)
    assert values(f.take(2)) == [5, 4]
    assert values(f.skip(3)) == [2, 1]


def test_random_pipelines_against_lists(spark):
    rng = random.Random(5)
    for _ in range(3):
        data = [rng.randrange(20) for _ in range(50)]
        f = numbers(spark, data).filter("v % 3 <> 0").with_columns(v=F.col("v") * 2)
        want = [2 * x for x in data if x % 3]
        assert values(f) == want
        assert values(f.skip(5).take(7)) == want[5:12]
        seen = []
        [seen.append(x) for x in want if x not in seen]
        assert values(f.distinct("v")) == seen
        assert values(f.sort("v")) == sorted(want)


def test_chunks_keep_the_tail(spark):
    assert [[x.v for x in r.rows] for r in numbers(spark, range(10)).chunk(4).collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert numbers(spark, []).chunk(4).collect() == []
    assert len(numbers(spark, range(3)).chunk(0).collect()) == 3


@pytest.mark.parametrize("size,slide", [(4, 4), (2, 3), (3, 1), (5, 2), (20, 1)])
def test_count_windows_against_a_plain_version(spark, size, slide):
    data = list(range(10))
    step = min(size, slide)
    want = [data[i:i + size] for i in range(0, len(data), step) if len(data[i:i + size]) == size]
    assert [[x.v for x in r.rows] for r in numbers(spark, data).window(size, slide).collect()] == want


def test_while_operators_are_repeatable(spark):
    f = numbers(spark, [1, 2, 9, 1, 9])
    drop = f.drop_while("v < 5")
    assert values(f.take_while("v < 5")) == [1, 2]
    assert values(drop) == [9, 1, 9] == values(drop)
    assert values(f.take_while("v < 100")) == [1, 2, 9, 1, 9]
    assert values(f.drop_while("v < 100")) == []
    nulls = numbers(spark, [1, None, 2])
    assert values(nulls.take_while("v < 5")) == [1]


def test_flat_map(spark):
    rows = readers.from_iterable(spark, [("a b",), ("",), (None,)], "t string")
    got = [r.w for r in rows.flat_map(F.split("t", " "), "w").collect()]
    assert got == ["a", "b", "", None]


def test_groups_and_folds(spark):
    rows = readers.from_iterable(spark, [("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "k string, v int")
    assert {r.k: [x.v for x in r.rows] for r in rows.group_by("k").collect_rows().collect()} == {"a": [1, 3], "b": [2], None: [4, 5]}
    assert {r.k: r["sum"] for r in rows.group_by("k").sum("v").collect()} == {"a": 4.0, "b": 2.0, None: 9.0}
    folded = rows.group_by("k").fold(F.col("v"), lambda acc, x: acc * 10 + x).collect()
    assert {r.k: r.value for r in folded} == {"a": 13, "b": 2, None: 45}
    assert rows.reduce("v", lambda acc, x: acc - x, F.lit(100)) == 85
    assert numbers(spark, []).reduce("v", lambda acc, x: acc + x, F.lit(7)) == 7
    assert numbers(spark, []).reduce("v", lambda acc, x: acc + x) is None


def test_special_keys(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,), (-0.0,), (None,), (None,)], "k double")
    assert sorted(df.groupBy("k").count().toPandas()["count"]) == [2, 2, 2]


def test_dense_index_by_ranges_equals_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"))
    one = {(r.a, r.b): r.idx for r in with_index(df, ["b", "a"]).collect()}
    many = {(r.a, r.b): r.idx for r in with_index(df, ["b", "a"], one_task_rows=10, bucket_rows=100).collect()}
    assert one == many and sorted(one.values()) == list(range(5000))
    hot = spark.range(3000).select(F.lit(1).alias("a"), "id")
    assert sorted(r.idx for r in with_index(hot, ["a", "id"], one_task_rows=10, bucket_rows=100).collect()) == list(range(3000))


def test_actions(spark):
    f = numbers(spark, [3, 1, 2])
    seen, later = [], []
    f.foreach(lambda r: seen.append(r.v))

    async def add(row):
        later.append(row.v)

    asyncio.run(f.async_foreach(add))
    assert seen == later == [3, 1, 2] == [r.v for r in f]
    assert f.count() == 3


def test_joins_and_sets(spark):
    a, b = numbers(spark, [1, 2, 2, None]), numbers(spark, [2, 3])
    left = Frame(a.df.select("v"), ["v"])
    right = Frame(b.df.select("v"), ["v"])
    assert sorted(r.v for r in left.join(right, "v", "semi").collect()) == [2, 2]
    assert left.join(right, "v", "anti").count() == 2
    assert left.union(right).count() == 6
    assert [r.v for r in left.intersect(right).collect()] == [2]
    assert {r.v for r in left.subtract(right).collect()} == {1, None}
