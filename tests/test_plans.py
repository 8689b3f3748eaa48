"""What the plans of queries look like: no row-at-a-time Python, top-k instead of sorts, pruned scans."""

import os

import pytest
from pyspark.sql import functions as F

from flowframe.operators import joins
from flowframe.queries import QUERIES
from flowframe.sources import readers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WRITERS = {"csv_roundtrip", "jsonl_roundtrip", "text_lines", "orc_roundtrip", "stream_resume_available_now", "batch_process_counts"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_python_on_hot_paths(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct"))


@pytest.mark.parametrize("name", ["take_n", "page", "first_row", "topk_search", "top_parts_by_revenue"])
def test_limits_plan_as_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF))


def test_best_rows_of_groups_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["topk_per_group"](spark, SF))


def test_scans_read_what_is_used(spark):
    plan = plan_of(QUERIES["top_parts_by_revenue"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_discount:double,l_returnflag:string>" in plan
    assert "EqualTo(l_returnflag,R)" in plan


def test_range_join_is_an_equality_join(spark):
    plan = plan_of(QUERIES["range_join_bucket"](spark, SF))
    assert "NestedLoop" not in plan


def test_endless_source_is_a_stream(spark):
    stream = readers.endless(spark, 5, F.col("idx") * 2)
    assert stream.isStreaming and stream.columns == ["ts", "idx", "value"]


def test_cross_join_is_only_made_on_request(spark):
    a, b = spark.range(2).toDF("x"), spark.range(3).toDF("y")
    assert joins.external_join(a, b, "", "cross").count() == 6
