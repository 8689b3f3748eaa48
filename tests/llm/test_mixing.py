from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flowframe.llm import mixing

from . import plain


def test_period_is_earliest_deadline_first(spark):
    units = {"a": 5, "b": 3, "c": 11, "d": 1}
    rows = mixing.period(spark.createDataFrame(list(units.items()), "source string, units bigint"), 20).orderBy("slot").collect()
    assert [r.source for r in rows] == plain.schedule(units, 20)
    assert Counter(r.source for r in rows) == units


def test_every_prefix_is_within_one_block(spark):
    units = {"a": 1, "b": 37, "c": 400, "d": 562}
    rows = mixing.period(spark.createDataFrame(list(units.items()), "source string, units bigint"), 1000).orderBy("slot").collect()
    done = Counter()
    for t, r in enumerate(rows, 1):
        assert r.slot == t - 1 and r.k == done[r.source]
        done[r.source] += 1
        assert all(abs(done[s] - u * t / 1000) < 1 for s, u in units.items())


def test_quantised(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", 0.0), ("e", float("inf")), ("f", float("nan")), ("g", 1e-12)], "source string, weight double")
    got = {r.source: r.units for r in mixing.quantised(w, 100).collect()}
    assert set(got) == {"a", "b", "g"} and sum(got.values()) == 100 and got["g"] == 1
    assert mixing.quantised(w.limit(0)).collect() == []
    with pytest.raises(Exception, match="more than 2 sources"):
        mixing.quantised(w, 2).collect()


def mixture(spark):
    rows = [(i, "abc"[min(i % 7, 2)], "t", 1, 2) for i in range(500)] + [(1000 + i, None, "t", 1, 2) for i in range(9)] + [(5, "a", "t", 1, 2), (None, "b", "t", 1, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, place string, slot int, mixed int")


def test_mix_keeps_all_rows_and_follows_the_plan(spark):
    docs = mixture(spark)
    weights = {"a": 2.0, "b": 1.0, "c": 1.0}
    out = mixing.mix(docs, spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=4, resolution=8)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    assert out.columns == ["doc_id", "source", "place", "mixed", "block_no", "slot", "within", "in_balance"]
    assert all(r.slot is None and not r.in_balance for r in rows if r.source is None)
    placed = [r for r in rows if r.slot is not None]
    owner = {}
    for r in placed:
        assert owner.setdefault(r.slot, r.source) == r.source
    assert len({(r.slot, r.within) for r in placed}) == len(placed)
    end = max(r.slot for r in placed if r.in_balance) + 1
    units = {r.source: r.units for r in mixing.quantised(spark.createDataFrame(list(weights.items()), "source string, weight double"), 8).collect()}
    assert [owner[t] for t in range(end)] == plain.schedule(units, end)
    sizes = Counter(r.slot for r in placed)
    assert all(sizes[t] == 4 for t in range(end))
    again = out.collect()
    assert Counter(again) == Counter(rows)


def balanced(rows, weights, block_rows):
    """The number of slots in balance, each prefix of which is within one block of the weights as given."""
    owner = {r.slot: r.source for r in rows if r.in_balance}
    total, done = sum(map(Fraction, weights.values())), Counter()
    assert sorted(owner) == list(range(len(owner)))
    for t in range(len(owner)):
        done[owner[t]] += 1
        assert all(abs(done[s] - Fraction(w) * (t + 1) / total) < 1 for s, w in weights.items())
    assert set(Counter(r.slot for r in rows if r.in_balance).values()) == {block_rows}
    return len(owner)


def test_many_periods_follow_the_given_weights(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4500, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 19 + 1)).alias("source"))
    weights = {"s0": 0.5, **{f"s{k}": 0.5 / 19 for k in range(1, 20)}}
    rows = mixing.mix(docs, spark.createDataFrame(list(weights.items()), "source string, weight double"), block_rows=1).collect()
    assert balanced(rows, weights, 1) > 8900 and len({r.slot for r in rows}) == 9000


def test_default_weights_are_square_roots_over_many_periods(spark):
    docs = spark.range(16_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 < 4, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 19 + 1)).alias("source"))
    rows = mixing.mix(docs, block_rows=2).collect()
    weights = {s: n ** 0.5 for s, n in Counter(r.source for r in rows).items()}
    assert balanced(rows, weights, 2) > 5000 and len({(r.slot, r.within) for r in rows}) == 16_000


def test_plan_in_parts(spark, monkeypatch):
    docs = mixture(spark)
    whole = Counter(mixing.mix(docs, block_rows=2).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert Counter(mixing.mix(docs, block_rows=2).collect()) == whole
    monkeypatch.setattr(mixing, "PLAN_BLOCKS", 100)
    assert Counter(mixing.mix(docs, block_rows=2).collect()) == whole


def test_more_sources_than_any_resolution(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), (F.col("id") % 1500).cast("string")).alias("source"))
    rows = mixing.mix(docs, block_rows=2).collect()
    assert balanced(rows, dict.fromkeys({r.source for r in rows}, 1.0), 2) == 3000 and len(rows) == 6000


def test_default_weights_and_empty_input(spark):
    docs = mixture(spark)
    rows = mixing.mix(docs).collect()
    assert all(r.slot is not None for r in rows) and len(rows) == docs.count()
    assert mixing.mix(docs.limit(0)).collect() == []


def test_rows_in_order(spark, monkeypatch, tmp_path):
    """Partition by partition, with sources that have no weight, more rows than a run and an empty table."""
    monkeypatch.setattr(mixing, "RUN_ROWS", 40)
    docs = mixture(spark)
    for weights in (None, spark.createDataFrame([("a", 1.0), ("b", 5.0)], "source string, weight double")):
        mixed = mixing.mix(docs, weights, block_rows=4)
        out = mixing.in_order(mixed, 4)
        assert out.columns == mixed.columns and Counter(out.collect()) == Counter(mixed.collect())
        place = lambda r: (r.slot is None, r.slot or 0, r.within if r.slot is not None else 0)
        rows = [place(r) for r in out.collect()]
        assert rows == sorted(rows) and out.rdd.getNumPartitions() > 13
    assert mixing.in_order(mixing.mix(docs.limit(0))).collect() == []


def test_numbers_are_dense_in_each_source(spark):
    rows = mixing.numbered(mixture(spark).withColumn("s", F.col("source")), "s", "doc_id", "n").collect()
    by = {}
    for r in rows:
        by.setdefault(r.s, []).append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 4


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(mixture(spark).drop("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
