"""Queries that fold a whole table, against brute force; the ids go past where a subset might end."""

from functools import reduce
from itertools import groupby
from math import floor

import pytest

from flowframe.operators import ordering
from flowframe.plans import memory
from flowframe.queries import QUERIES

ROWS = [(i * 3, i * 7 % 5, "abc"[i * 11 % 3], (i * 37 % 1013) / 4) for i in range(1500)]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("folds")
    spark.createDataFrame(ROWS, "event_id bigint, user_id bigint, event_type string, value double").repartition(3).write.parquet(f"{path}/events.parquet")
    return str(path)


def groups(column):
    key = lambda r: r[column]
    return {k: [floor(r[3]) for r in rows] for k, rows in groupby(sorted(ROWS, key=lambda r: (r[column], r[0])), key)}


def test_group_fold_takes_all_events(spark, events):
    want = {k: reduce(lambda acc, x: (acc * 3 + x) % 1000003, v, 7) for k, v in groups(1).items()}
    assert {r.user_id: r.folded for r in QUERIES["group_fold"](spark, events).collect()} == want


def test_fold_first_value_takes_all_events(spark, events):
    want = {k: reduce(lambda acc, x: acc - x, v) for k, v in groups(2).items()}
    assert {r.event_type: r.folded for r in QUERIES["fold_first_value"](spark, events).collect()} == want


def test_memory_trend_takes_all_events(spark, events):
    v = [floor(r[3]) for r in ROWS]
    want = (sum(v) / 1500, max(v), sum(v[750:]) / 750 - sum(v[:750]) / 750)
    assert QUERIES["memory_trend"](spark, events).first() == pytest.approx(want)


def test_trend_over_key_ranges(spark, monkeypatch):
    rows = [(i, float(i * i % 101)) for i in range(1001)]
    monkeypatch.setattr(memory, "with_index", lambda *a: ordering.with_index(*a, one_task_rows=100, bucket_rows=200))
    v = [x for _, x in rows]
    got = memory.trend(spark.createDataFrame(rows, "at int, percent double").repartition(4)).first()
    assert got == pytest.approx((sum(v) / 1001, max(v), sum(v[500:]) / 501 - sum(v[:500]) / 500))
    assert memory.trend(spark.createDataFrame(rows[:1], "at int, percent double")).first() == (0.0, 0.0, 0.0)
