"""Queries over the test tables, one or more an operator; their SQL is in oracle.py under the same names."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.frame import Frame
from flowframe.functions import policy, vectors
from flowframe.operators import grouping, joins
from flowframe.operators.batch import BatchProcessor
from flowframe.operators.collection import ArrayView, MapView
from flowframe.operators.ordering import with_index
from flowframe.plans import memory, planner, profile
from flowframe.sources import readers, sinks
from flowframe.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Unique order keys of the tables.
ORDER = {"events": ["event_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "documents": ["doc_id"], "embeddings": ["vec_id"],
         "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def frame(spark: SparkSession, sf: str, name: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf}/{name}.parquet"), ORDER.get(name, []))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")


def total(x: Column | str) -> Column:
    """A sum of money that doesn't depend on the order of addition."""
    return F.sum(money(x)).cast("double")


# projections, filters, expansion, scalar expressions

@query
def top_parts_by_revenue(spark, sf):
    rows = frame(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    best = rows.group_by("l_partkey").agg(F.sum(revenue).cast("double").alias("revenue"))
    return best.df.orderBy(F.desc("revenue"), "l_partkey").limit(10)


@query
def filter_map_grade(spark, sf):
    rows = frame(spark, sf, "events").filter("value >= 50 AND event_type <> 'view'")
    return rows.map(event_type="event_type", grade=F.when(F.col("value") >= 400, "A").when(F.col("value") >= 200, "B").otherwise("C")).df


@query
def cast_arithmetic(spark, sf):
    return frame(spark, sf, "lineitem").map(l_orderkey="l_orderkey", qty=F.col("l_quantity").cast("int"), net=F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("double")).df.groupBy("qty").agg(F.count(F.lit(1)).alias("n"), total("net").alias("net"))


@query
def month_substring_totals(spark, sf):
    rows = frame(spark, sf, "orders").with_columns(month=F.substring(F.col("o_orderdate").cast("string"), 1, 7))
    return rows.group_by("month").agg(total("o_totalprice").alias("total")).df


@query
def flat_map_words(spark, sf):
    return frame(spark, sf, "part").flat_map(F.split("p_name", " "), "word").group_by("word").count("n").df


@query
def flat_map_characters(spark, sf):
    return frame(spark, sf, "region").flat_map(F.split("r_name", ""), "c").df.where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query
def range_pow(spark, sf):
    return readers.from_range(spark, 0, 1000, 7).map(value="value", square=F.pow("value", F.lit(2))).df.select("value", "square")


@query
def range_negative_step(spark, sf):
    return readers.from_range(spark, 100, 0, -9).df


@query
def infinite_take(spark, sf):
    return readers.generate(spark, 1000, (F.col("idx") * 37 + 11) % 101).take(100).df


@query
def export_columns(spark, sf):
    rows = frame(spark, sf, "part").filter("p_size < 10")
    return rows.df.select("p_partkey", F.format_string("%s-%d", "p_brand", "p_size").alias("code"), F.repeat(F.lit("*"), F.col("p_size")).alias("bar"))


@query
def json_props_extract(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def json_roundtrip(spark, sf):
    packed = table(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))
    return packed.select(F.from_json("j", "n_nationkey int, n_name string").alias("x")).select("x.n_nationkey", "x.n_name")


# sorting and top-k

def _ranked(sorted_frame, *columns: str) -> DataFrame:
    """Ranks from 1 by ranges of keys: no one task sees all rows."""
    return sorted_frame.index().df.select(*columns, (F.col("idx") + 1).alias("rank"))


@query
def sort_stable_asc(spark, sf):
    return _ranked(frame(spark, sf, "orders").sort("o_orderpriority"), "o_orderkey")


@query
def sort_stable_desc(spark, sf):
    return _ranked(frame(spark, sf, "orders").sort("o_orderpriority", reverse=True), "o_orderkey")


@query
def sort_composite_mixed(spark, sf):
    return _ranked(frame(spark, sf, "customer").sort("c_acctbal", reverse=True, nulls="last").sort("c_mktsegment"), "c_custkey")


@query
def sort_then_chunk(spark, sf):
    """Chunks of a descending order, nulls last: the verbs of positions go by the sort."""
    rows = frame(spark, sf, "lineitem").sort("l_extendedprice", reverse=True, nulls="last")
    return rows.chunk(5000, F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.sum("l_linenumber").alias("line_numbers")).df


@query
def sort_nulls_last(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")
    return _ranked(Frame(rows, ["doc_id"]).sort("quality", nulls="last"), "doc_id")


@query
def topk_search(spark, sf):
    return frame(spark, sf, "part").filter(F.col("p_name").contains("e")).sort("p_retailprice", reverse=True).take(20).df.select("p_partkey", "p_name", "p_retailprice")


@query
def topk_per_group(spark, sf):
    return frame(spark, sf, "orders").group_by("o_orderpriority").top(10, F.desc("o_totalprice")).df.select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


@query
def topk_groups_then_sort(spark, sf):
    """The last ten of each group by value, all of them sorted by another column."""
    best = frame(spark, sf, "events").group_by("event_type").top(10, F.desc("value")).df
    return best.select("event_type", "event_id", F.row_number().over(Window.orderBy(F.desc("user_id"), "event_id", "event_type")).alias("place"))


# positions

@query
def take_n(spark, sf):
    return frame(spark, sf, "events").take(100).df.select("event_id", "value")


@query
def skip_n(spark, sf):
    return frame(spark, sf, "customer").skip(100).df.select("c_custkey", "c_name")


@query
def page(spark, sf):
    return frame(spark, sf, "part").filter("p_size between 10 and 40").skip(40).take(20).df.select("p_partkey", "p_name", "p_size")


@query
def first_row(spark, sf):
    return frame(spark, sf, "orders").take(1).df.select("o_orderkey", "o_custkey")


@query
def chunk_summaries(spark, sf):
    rows = frame(spark, sf, "events").chunk(1000, F.count(F.lit(1)).alias("n"), total("value").alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return rows.df


@query
def chunk_rows(spark, sf):
    """Chunks of 7 rows as arrays, in order."""
    return frame(spark, sf, "supplier").chunk(7).df.select("chunk", F.size("rows").alias("n"), F.get("rows", F.lit(0))["s_suppkey"].alias("first_key"), F.element_at("rows", -1)["s_suppkey"].alias("last_key"))


def _window_query(size: int, slide: int) -> Query:
    def run(spark, sf):
        return frame(spark, sf, "events").window(size, slide, total("value").alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).df.select("first_id", "last_id", "total")

    return run


QUERIES["count_window_sliding"] = _window_query(10, 3)
QUERIES["count_window_tumbling"] = _window_query(10, 10)
QUERIES["count_window_wide_slide"] = _window_query(10, 13)


@query
def take_while(spark, sf):
    return frame(spark, sf, "events").take_while("value < 489").df.select("event_id", "value")


@query
def drop_while(spark, sf):
    return frame(spark, sf, "events").drop_while("value < 489").df.select("event_id", "value")


@query
def dense_index(spark, sf):
    """The index by key ranges, as large inputs get it."""
    return with_index(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], one_task_rows=100, bucket_rows=2000)


# distinct and sets

@query
def distinct_values(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query
def distinct_by_key_first(spark, sf):
    return frame(spark, sf, "events").distinct("user_id").df.select("user_id", "event_id", "event_type")


def _segment(spark, sf, *names):
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin(*names)).select("c_nationkey")


@query
def union_all(spark, sf):
    return _segment(spark, sf, "BUILDING").unionAll(_segment(spark, sf, "MACHINERY"))


@query
def union_distinct(spark, sf):
    return _segment(spark, sf, "BUILDING").union(_segment(spark, sf, "MACHINERY")).distinct()


def _keys(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


@query
def intersect_distinct(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


@query
def intersect_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersectAll(b)


@query
def except_distinct(spark, sf):
    a, b = _keys(spark, sf)
    return a.subtract(b)


@query
def except_all(spark, sf):
    a, b = _keys(spark, sf)
    return a.exceptAll(b)


# groups and aggregates

@query
def group_collect_sizes(spark, sf):
    rows = frame(spark, sf, "events")
    groups = Frame(rows.df.select("event_id", "user_id", "value"), ["event_id"]).group_by("user_id").collect_rows()
    return groups.df.select("user_id", F.size("rows").alias("n"), F.get("rows", F.lit(0))["event_id"].alias("first_id"), F.element_at("rows", -1)["event_id"].alias("last_id"))


@query
def group_count(spark, sf):
    return frame(spark, sf, "orders").group_by("o_orderpriority").count("n").df


@query
def group_sum(spark, sf):
    return frame(spark, sf, "lineitem").group_by("l_returnflag").sum("l_quantity", "total").df


@query
def group_avg(spark, sf):
    return frame(spark, sf, "lineitem").group_by("l_linestatus").avg("l_quantity", "mean").df


@query
def group_max(spark, sf):
    return frame(spark, sf, "orders").group_by("o_orderstatus").max("o_totalprice", "most").df


@query
def group_min(spark, sf):
    return frame(spark, sf, "part").group_by("p_brand").min("p_name", "least").df


@query
def group_null_key(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return Frame(rows, ["doc_id"]).group_by("quality").count("n").df


@query
def group_fold(spark, sf):
    """A fold that depends on the order: v = v / 2 + next, in quarters so that doubles stay exact."""
    rows = Frame(table(spark, sf, "events"), ["event_id"])
    step = lambda acc, x: (acc * 3 + x) % 1000003
    return rows.group_by("user_id").fold(F.floor("value").cast("bigint"), step, F.lit(7).cast("bigint"), "folded").df


@query
def fold_first_value(spark, sf):
    rows = Frame(table(spark, sf, "events"), ["event_id"])
    return rows.group_by("event_type").fold(F.floor("value").cast("bigint"), lambda acc, x: acc - x, None, "folded").df


@query
def reduce_total(spark, sf):
    rows = Frame(table(spark, sf, "nation"), ["n_nationkey"])
    return grouping.fold(rows.df, [], rows.order, F.col("n_nationkey").cast("bigint"), lambda acc, x: acc * 2 + x, F.lit(1).cast("bigint"), "folded")


@query
def reduce_ranges(spark, sf):
    """A fold of all line items whose runs can be joined: the last value and the sum of absolute changes."""
    rows = frame(spark, sf, "lineitem")
    value = F.struct(F.col("l_quantity").cast("bigint").alias("first"), F.col("l_quantity").cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("moved"))
    join = lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["moved"] + b["moved"] + F.abs(b["first"] - a["last"])).alias("moved"))
    return grouping.fold(rows.df, [], rows.order, value, join, None, "x", combine=join).select("x.first", "x.last", "x.moved")


@query
def row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query
def composite_key_group(spark, sf):
    return frame(spark, sf, "labels").group_by("quality", "toxic").count("n").df


@query
def accuracy(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("actual"), (F.length("text") > 500).cast("int").alias("predicted"))
    return rows.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query
def confusion_matrix(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("actual"), (F.length("text") > 500).cast("int").alias("predicted"))
    return rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query
def rollup_revenue(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total"))


@query
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("gid"))


@query
def grouping_sets(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.groupingSets([[F.col("c_mktsegment")], [F.col("c_nationkey")], []], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query
def pivot_status(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def distinct_aggregates(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


# joins

@query
def join_inner(spark, sf):
    return joins.external_join(table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total"))


@query
def join_left(spark, sf):
    return joins.external_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", "left")


@query
def join_right(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000")
    return joins.external_join(rich, table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query
def join_full(spark, sf):
    a = table(spark, sf, "labels").where("quality = 1").select("doc_id", "quality")
    b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "lang")
    return joins.external_join(a, b, "doc_id", "full")


@query
def join_semi(spark, sf):
    return joins.external_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "semi").select("doc_id", "lang")


@query
def join_anti(spark, sf):
    return joins.external_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "anti").select("doc_id", "lang")


@query
def join_cross(spark, sf):
    return joins.external_join(table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name"), "", "cross")


@query
def gather_by_index(spark, sf):
    rows = with_index(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    wanted = readers.from_range(spark, 0, 1000, 3).df.select(F.col("value").alias("idx"))
    return wanted.join(rows, "idx")


@query
def lookup_enrich(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey").select("c_custkey", "n_name")


@query
def asof_event(spark, sf):
    """For each view, the user's last purchase at or before it."""
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.asof_join(views, buys, "ts", ["user_id"], ["value"]).select("event_id", "value_asof")


@query
def asof_event_bucketed(spark, sf):
    """The same with long keys split by day."""
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.asof_join(views, buys, "ts", ["user_id"], ["value"], bucket=F.to_date("ts")).select("event_id", "value_asof")


@query
def range_join_bucket(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    bands = spark.range(40).select(F.col("id").alias("band"), (F.col("id") * 15000.0).alias("low"), (F.col("id") * 15000.0 + 20000.0).alias("high"))
    return joins.range_join(orders, bands, F.col("o_totalprice"), F.col("low"), F.col("high"), 20000.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


# window functions

@query
def ranking_functions(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    seg = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(seg).alias("rk"), F.dense_rank().over(seg).alias("dr"), F.ntile(4).over(w).alias("quarter"))


@query
def lag_lead(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.first("value").over(w).alias("first_value"), F.nth_value("event_id", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second_id"))


@query
def moving_rows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, sf, "events").select("event_id", F.sum(money("value")).over(w).cast("double").alias("last_three"))


# application shapes

@query
def daily_orders_revenue_customers(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"), total("o_totalprice").alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


@query
def store_totals(spark, sf):
    return frame(spark, sf, "orders").group_by("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total")).df


@query
def price_histogram(spark, sf):
    return table(spark, sf, "part").groupBy(F.floor(F.col("p_retailprice") / 100).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def catalog_statistics(spark, sf):
    return table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"), total("p_retailprice").alias("total_value"), F.count_distinct("p_brand").alias("brands"), F.sum((F.col("p_size") < 5).cast("bigint")).alias("low_stock"))


@query
def category_statistics(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), total("p_retailprice").alias("total_value"), F.max("p_size").alias("most"))


@query
def cv_folds(spark, sf):
    n = table(spark, sf, "labels").count()
    rows = with_index(table(spark, sf, "labels").select("doc_id", "quality"), ["quality", "doc_id"])
    fold = F.expr(f"idx div {max(1, n // 5)}").cast("bigint")
    return rows.select("doc_id", fold.alias("fold")).where("fold < 5")


@query
def split_80_20(spark, sf):
    rows = with_index(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"])
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return rows.select("vec_id", F.when(F.col("idx") < F.floor(n * 8 / 10), "train").otherwise("test").alias("part"))


# vectors

@query
def vector_row_stats(spark, sf):
    v = F.col("embedding")
    r = lambda x: F.round(x, 6)
    return table(spark, sf, "embeddings").select("vec_id", r(vectors.mean(v)).alias("mean"), r(vectors.std(v)).alias("std"), F.array_min(vectors.doubles(v)).alias("least"), F.array_max(vectors.doubles(v)).alias("most"), r(vectors.median(v)).alias("median"))


@query
def vector_feature_means(spark, sf):
    return vectors.feature_means(table(spark, sf, "embeddings"), "embedding").select("pos", F.round("mean", 6).alias("mean"))


@query
def vector_center(spark, sf):
    rows = vectors.centered(table(spark, sf, "embeddings"), "embedding", "c")
    return rows.select("vec_id", F.round(F.get("c", F.lit(0)), 5).alias("c0"), F.round(F.element_at("c", -1), 5).alias("c_last"))


# arrays and maps

@query
def array_slice_step(spark, sf):
    return ArrayView.of(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"]).slice(10, 500, 7)


@query
def array_negative_index(spark, sf):
    return ArrayView.of(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]).at(-3)


@query
def array_insert_delete(spark, sf):
    view = ArrayView.of(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
    return view.insert(5, spark.range(100, 103).select(F.col("id").cast("int").alias("k")), ["k"]).delete(10, 12).df


@query
def array_append_len(spark, sf):
    view = ArrayView.of(table(spark, sf, "region").select(F.col("r_regionkey").alias("k")), ["k"]).append(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
    return view.df.agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"))


@query
def array_set_reverse(spark, sf):
    view = ArrayView.of(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return view.set(spark.createDataFrame([(0, "FIRST"), (3, "FOURTH")], "idx bigint, n_name string"), "n_name").reverse().df


@query
def from_rows(spark, sf):
    rows = readers.from_iterable(spark, [("a", 1), ("b", None), ("c", 3)], "name string, v int")
    return rows.df


@query
def map_latest_per_key(spark, sf):
    return MapView(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id").items().select("user_id", "event_id", "value")


@query
def map_lookup(spark, sf):
    view = MapView(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")
    return readers.from_range(spark, 0, 400).df.select(F.col("value").alias("user_id")).join(view.df.select("user_id", F.col("value").alias("latest")), "user_id", "left")


# policies, metrics, planner

@query
def sqrt_chunk_policy(spark, sf):
    return spark.range(0, 200_000_000, 1_234_567).select(F.col("id").alias("n"), policy.chunk_size_column(F.col("id")).alias("chunk"))


@query
def williams_bound(spark, sf):
    return spark.range(0, 1_000_000, 9973).select(F.col("id").alias("t"), policy.williams_column(F.col("id")).alias("bound"))


@query
def pressure_levels(spark, sf):
    return table(spark, sf, "events").groupBy(policy.pressure_level(F.col("value") / 5).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query
def memory_trend(spark, sf):
    samples = table(spark, sf, "events").select(F.col("event_id").alias("at"), F.floor("value").alias("percent"))
    return memory.trend(samples)


@query
def checkpoint_schedule(spark, sf):
    n = table(spark, sf, "orders").count()
    every = policy.checkpoint_interval(n)
    return spark.range(every, n + 1, every).select(F.col("id").alias("iteration"))


@query
def access_pattern(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", (F.col("event_id") * 2).alias("address"))
    strided = rows.withColumn("event_type", F.lit("all"))
    return profile.access_pattern(rows.unionAll(strided), "event_id", "address", ["event_type"])


@query
def hierarchy_levels(spark, sf):
    return spark.range(0, 40).select(F.col("id").alias("power"), policy.hierarchy_column(F.pow(F.lit(2.0), F.col("id"))).alias("level"))


LAYERS = [(i, f"layer{i}", ("Linear", "Conv2d", "ReLU")[i % 3], (i * 7919 % 500 + 1) * 1000, (i * 104729 % 900 + 1) * 4096) for i in range(23)]


def _layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYERS, "idx bigint, name string, type string, params bigint, activation_bytes bigint")


@query
def layer_bottlenecks(spark, sf):
    return planner.bottlenecks(_layers(spark))


@query
def layer_segments(spark, sf):
    return planner.segments(_layers(spark))


@query
def layer_precision(spark, sf):
    return planner.half_precision(_layers(spark))


SHAPES = [(i, f"layer{i}", ("Linear", "Conv2d", "ReLU")[i % 3], i * 31 % 64 + 1, i * 17 % 48 + 1 if i % 3 < 2 else None, 3 if i % 3 == 1 else None) for i in range(21)]


@query
def layer_shapes(spark, sf):
    return planner.shaped_layers(spark.createDataFrame(SHAPES, "idx bigint, name string, type string, inputs int, outputs int, kernel int"))


@query
def hierarchy_transitions(spark, sf):
    return profile.transitions(table(spark, sf, "events").select("event_id", (F.col("value") * F.col("value") * 1000).alias("size")), "event_id", "size")


@query
def shifted_orders(spark, sf):
    """The price of the order before, over the whole table, and the changes by status."""
    rows = frame(spark, sf, "orders").shifted("o_totalprice", 1, name="before").df
    return rows.where("before is not null").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice") - money("before")).cast("double").alias("change"))


@query
def training_memory_plan(spark, sf):
    return planner.training_plan(_layers(spark), 32, 1 << 30)


# sources, sinks, batches, streams

def _scratch(spark: SparkSession) -> str:
    """A folder that all machines share: the named checkpoint folder, a local one where none is named."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='flowframe-')).rstrip('/')}/io-{uuid.uuid4().hex}"


@query
def csv_roundtrip(spark, sf):
    at = _scratch(spark)
    sinks.to_csv(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), at)
    back = readers.from_csv(spark, at, "p_partkey bigint, p_name string, p_retailprice double", multi_line=False).unordered
    return back.agg(F.count(F.lit(1)).alias("n"), total("p_retailprice").alias("total"), F.max("p_name").alias("last_name"))


@query
def jsonl_roundtrip(spark, sf):
    at = _scratch(spark)
    sinks.to_jsonl(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality"), at)
    return readers.from_jsonl(spark, at, "doc_id bigint, lang string, quality int").unordered.select("doc_id", "lang", "quality")


@query
def text_lines(spark, sf):
    at = _scratch(spark)
    sinks.to_file(table(spark, sf, "documents").where("lang = 'en'").select(F.explode(F.split("text", "\n")).alias("value")), at)
    return readers.from_file(spark, at).unordered.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query
def orc_roundtrip(spark, sf):
    at = _scratch(spark)
    table(spark, sf, "nation").write.orc(at)
    return readers.from_orc(spark, at, ["n_nationkey"]).df


@query
def query_source(spark, sf):
    return readers.from_query(spark, f"SELECT c_nationkey, count(*) AS n FROM parquet.`{sf}/customer.parquet` WHERE c_acctbal > :least GROUP BY c_nationkey", ["c_nationkey"], least=1000).df


@query
def batch_process_counts(spark, sf):
    def work(batch):
        if not batch.num_rows:
            raise ValueError("empty")

    return BatchProcessor.summary(BatchProcessor(500).process(table(spark, sf, "events").select("event_id"), work))


@query
def tumbling_event_window(spark, sf):
    return jobs.tumbling(jobs.event_time(table(spark, sf, "events")), "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), total("value").alias("total")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def sliding_event_window(spark, sf):
    windows = jobs.tumbling(jobs.event_time(table(spark, sf, "events")), "2 hours", [], F.count(F.lit(1)).alias("n"), slide="1 hour")
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def session_window(spark, sf):
    return jobs.sessions(jobs.event_time(table(spark, sf, "events")), "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"), total("value").alias("total")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query
def stream_resume_available_now(spark, sf):
    """Two runs over the same files take every row in once."""
    at = _scratch(spark)
    source = f"{at}/in"
    table(spark, sf, "events").select("event_id", "value").repartition(4).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("event_id bigint, value double").parquet(source)
        jobs.run_available(stream.where("value > 100"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query
def conversation_turns(spark, sf):
    """Chunks by key: each conversation's turns as one ordered text length and count."""
    rows = Frame(table(spark, sf, "conversations"), ["turn"])
    return rows.group_by("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role")).df
