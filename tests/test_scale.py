"""Operators where many ranges, windows and folds take part, sources that can be split, and verbs on keys."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from flowframe.frame import Frame
from flowframe.operators import grouping, ordering, positional
from flowframe.sources import readers, sinks

ROWS = [(i * 7919 % 100_003, i % 5, float(i * 37 % 101)) for i in range(6000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k bigint, g int, v double").repartition(5)


@pytest.mark.parametrize("bounds,bucket_rows", [(512, 500), (7, 200), (16, 30)])
def test_positions_over_two_levels_of_ranges(rows, monkeypatch, bounds, bucket_rows):
    monkeypatch.setattr(ordering, "MOST_BOUNDS", bounds)
    out = ordering.with_index(rows, ["k"], one_task_rows=10, bucket_rows=bucket_rows)
    want = {k: i for i, k in enumerate(sorted(r[0] for r in ROWS))}
    assert {r.k: r.idx for r in out.collect()} == want
    assert out.columns == ["k", "g", "v", "idx"]
    assert ordering.with_index(rows.limit(0), ["k"], one_task_rows=-1).collect() == []


def test_ranges_are_even_and_as_many_as_asked(rows, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_BOUNDS", 16)
    n = ordering._in_ranges(rows, ["k"], 6000, 200, "b").groupBy("b").count().collect()
    assert 150 <= len(n) <= 256 and max(r["count"] for r in n) < 200


@pytest.mark.parametrize("size,slide,span", [(1, 1, 10), (5, 2, 10), (40, 7, 10), (100, 1, 64), (3, 9, 10), (6000, 1, 64), (6001, 1, 64)])
def test_windows_over_ranges(rows, monkeypatch, size, slide, span):
    monkeypatch.setattr(positional, "WINDOW_RANGE", span)
    out = positional.window(rows, ["k"], size, slide, F.sum("v").alias("s"), F.min("k").alias("first"))
    v, step = sorted(ROWS), min(size, slide)
    want = {i // step: (sum(r[2] for r in v[i:i + size]), v[i][0]) for i in range(0, len(v) - size + 1, step)}
    assert {r.window: (r.s, r["first"]) for r in out.collect()} == want


def test_window_rows_shuffle_at_most_twice(rows):
    plan = positional.window(rows, ["k"], 1000, 1, F.sum("v").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("RepartitionByExpression")  # windows are made behind the shuffle


def test_window_keeps_rows_as_arrays(rows):
    got = positional.window(rows, ["k"], 3, 2).orderBy("window").take(2)
    v = sorted(ROWS)
    assert [[tuple(x)[:3] for x in r.rows] for r in got] == [v[0:3], v[2:5]]


def test_folds_over_ranges(spark, rows):
    v = [int(r[2]) for r in sorted(ROWS)]
    step = lambda acc, x: (acc * 3 + x) % 1000003
    want = reduce(step, v, 7)
    value, initial = F.col("v").cast("bigint"), F.lit(7).cast("bigint")
    assert grouping.fold_in_order(rows, ["k"], value, step, initial, range_rows=1000) == want
    assert Frame(rows, ["k"]).reduce(value, step, initial) == want
    assert grouping.fold_in_order(rows, ["k"], value, lambda a, x: a - x, range_rows=999) == reduce(lambda a, x: a - x, v)
    empty = Frame(rows.limit(0), ["k"])
    assert empty.reduce(value, step, initial) == 7 and empty.reduce(value, step) is None
    assert empty.reduce(value, F.greatest, combine=F.greatest) is None


def test_folds_of_joined_runs(rows):
    words = F.concat(F.col("k").cast("string"), F.lit(","))
    join = lambda a, b: F.concat(a, b)
    out = grouping.fold(rows, ["g"], ["k"], words, join, F.lit(""), "all", combine=join, range_rows=500)
    assert {r.g: r["all"] for r in out.collect()} == {g: "".join(f"{r[0]}," for r in sorted(ROWS) if r[1] == g) for g in range(5)}
    assert Frame(rows, ["k"]).reduce(F.col("v"), F.greatest, combine=F.greatest) == max(r[2] for r in ROWS)


def test_filters_on_files_reach_the_scan(spark, tmp_path):
    sinks.to_csv(spark.createDataFrame([(i, f"name {i}") for i in range(50)], "a int, b string").coalesce(1), f"{tmp_path}/c")
    file = readers.from_csv(spark, f"{tmp_path}/c", "a int, b string", multi_line=False)
    some = file.filter("a >= 40").with_columns(c=F.col("a") * 2)
    plan = some.unordered._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,40)" in plan and "monotonically_increasing_id" not in plan
    assert some.count() == 10 and [r.a for r in some.skip(8).collect()] == [48, 49] and [r.c for r in some.take(2).collect()] == [80, 82]
    assert some.map(x="a + 1").unordered.columns == ["x"] and [r.x for r in some.map(x="a + 1").take(1).collect()] == [41]
    some.to_parquet(f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["a", "b", "c"]
    assert some.group_by("a").count().df.count() == 10


def test_large_csv_is_split_where_fields_hold_no_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{i},{'y' * 90}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        parts = lambda **o: readers.from_csv(spark, f"{tmp_path}/x.csv", "a int, b string", **o).unordered.rdd.getNumPartitions()
        assert parts() == 1 and parts(multi_line=False) > 4
        assert readers.from_csv(spark, f"{tmp_path}/x.csv", "a int, b string", multi_line=False).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranked_shifted_and_moving(rows):
    frame = Frame(rows, ["k"])
    best = frame.ranked(["g"], F.desc("v"), F.col("k")).filter("rank = 1").collect()
    assert {r.g: (r.v, r.k) for r in best} == {g: (v := max(r[2] for r in ROWS if r[1] == g), min(r[0] for r in ROWS if r[1] == g and r[2] == v)) for g in range(5)}
    assert {r.rank for r in frame.ranked(["g"], F.col("k"), kind="ntile", tiles=3).collect()} == {1, 2, 3}
    v = [r for r in sorted(ROWS) if r[1] == 2]
    got = [r for r in frame.shifted("k", keys=["g"]).shifted("k", -1, ["g"], "next").moving(["g"], F.sum("v"), 1, 1).collect() if r.g == 2]
    assert [(r.k_shifted, r.next) for r in got] == list(zip([None, *(r[0] for r in v)], [*(r[0] for r in v[1:]), None]))
    whole = sorted(ROWS)
    assert {(r.k, r.k_shifted) for r in frame.shifted("k", 2).collect()} == {(r[0], whole[i - 2][0] if i > 1 else None) for i, r in enumerate(whole)}
    assert {(r.k, r.next) for r in frame.shifted("k", -1, name="next").collect()} == {(r[0], whole[i + 1][0] if i + 1 < len(whole) else None) for i, r in enumerate(whole)}
    assert [r.moving for r in got] == [sum(x[2] for x in v[max(0, i - 1):i + 2]) for i in range(len(v))]


def test_sketches_are_near_the_exact_values(rows):
    frame = Frame(rows, ["k"])
    got = frame.group_by("g").approx_distinct("k", "n", 0.02).collect()
    assert all(abs(r.n - 1200) < 100 for r in got) and len(got) == 5
    q = frame.group_by("g").approx_quantiles("v", [0.0, 0.5, 1.0], "q").collect()
    for r in q:
        own = sorted(x[2] for x in ROWS if x[1] == r.g)
        assert r.q[0] == own[0] and r.q[2] == own[-1] and abs(r.q[1] - own[600]) <= 1


def test_databases_and_other_formats(spark, tmp_path, rows):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    rows.where("g = 1").write.jdbc(url, "rows1", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    back = readers.from_jdbc(spark, url, "rows1", ["k"], split="k", bounds=(0, 100_003), parts=3, **options)
    assert back.df.rdd.getNumPartitions() == 3 and sorted(tuple(r) for r in back.collect()) == sorted(r for r in ROWS if r[1] == 1)
    rows.write.orc(f"{tmp_path}/o")
    assert readers.from_format(spark, "orc", ["k"], f"{tmp_path}/o").first().k == min(r[0] for r in ROWS)
    for name in ("avro", "kafka"):
        with pytest.raises(Exception, match=f"(?i)failed to find data source: {name}|external"):
            (readers.from_avro(spark, f"{tmp_path}/o", ["k"]) if name == "avro" else readers.from_kafka(spark, "localhost:1", "t")).df
