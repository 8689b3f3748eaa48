"""Verbs of positions after a sort go by the sorted order, in either direction."""

import pytest
from pyspark.sql import functions as F

from flowframe.frame import Frame
from flowframe.operators.ordering import sorted_index

ROWS = [(i, k, i * 7 % 10) for i, k in enumerate([3, None, 1, 3, 2, None, 1, 3, 2, 1, 0, 3])]


@pytest.fixture(scope="module")
def frame(spark):
    return Frame(spark.createDataFrame(ROWS, "id bigint, k int, v int").repartition(4), ["id"])


def plain(reverse, nulls):
    """The rows as a stable sort gives them."""
    held = sorted((r for r in ROWS if r[1] is not None), key=lambda r: r[1], reverse=reverse)
    none = [r for r in ROWS if r[1] is None]
    return none + held if nulls == "first" else held + none


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("nulls", ["first", "last"])
def test_positions_follow_the_sort(frame, reverse, nulls):
    want = plain(reverse, nulls)
    ids = [r[0] for r in want]
    made = frame.sort("k", reverse=reverse, nulls=nulls)
    assert [r.id for r in made.collect()] == ids
    assert [r.id for r in made.index().collect()] == ids
    assert [r.ids for r in made.chunk(5, F.array_sort(F.collect_list(F.struct("idx", "id")))["id"].alias("ids")).collect()] == [ids[:5], ids[5:10], ids[10:]]
    assert {r.window: r.total for r in made.window(4, 2, F.sum("v").alias("total")).collect()} == {w: sum(r[2] for r in want[2 * w:2 * w + 4]) for w in range(5)}
    stop = next(i for i, r in enumerate(want) if r[2] == 3)
    assert [r.id for r in made.take_while("v <> 3").collect()] == ids[:stop]
    assert [r.id for r in made.drop_while("v <> 3").collect()] == ids[stop:]
    assert made.reduce(F.col("id").cast("string"), lambda a, b: F.concat_ws(",", a, b)) == ",".join(map(str, ids))
    assert [r.id_shifted for r in made.shifted("id").collect()] == [None, *ids[:-1]]
    firsts = {}
    for r in want:
        firsts.setdefault(r[2], r[0])
    assert {r.v: r.id for r in made.distinct("v").collect()} == firsts
    assert [r.w for r in made.flat_map(F.array("id", -F.col("id") - 1), "w").collect()] == [w for i in ids for w in (i, -i - 1)]
    for parity, rows in ((p, [r for r in made.group_by("v").collect_rows().collect() if r.v == p]) for p in range(10)):
        assert [[x.id for x in r.rows] for r in rows] in ([], [[r[0] for r in want if r[2] == parity]])


def test_a_second_sort_is_stable_over_the_first(frame):
    for first in (False, True):
        for second in (False, True):
            twice = frame.sort("v", reverse=first).sort("k", reverse=second)
            once = sorted(ROWS, key=lambda r: r[2], reverse=first)
            held = sorted((r for r in once if r[1] is not None), key=lambda r: r[1], reverse=second)
            assert [tuple(r) for r in twice.rows().collect()] == [r for r in once if r[1] is None] + held


def test_sorted_index_in_ranges(spark):
    """With small ranges, hot keys and two keys."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 7919 % 50).alias("a"), (F.col("id") * 31 % 4).cast("double").alias("b"))
    rows = [tuple(r) for r in df.collect()]
    got = [r.id for r in sorted_index(df, ["a", "b"], ["id"], True, "last", "at", one_task_rows=100, bucket_rows=300).orderBy("at").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[2], r[0]))]
