"""DuckDB SQL of the queries in queries.py, written apart from them, by name."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "top_parts_by_revenue": """
        SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 10""",
    "filter_map_grade": """
        SELECT event_id, event_type, CASE WHEN value >= 400 THEN 'A' WHEN value >= 200 THEN 'B' ELSE 'C' END AS grade
        FROM events WHERE value >= 50 AND event_type <> 'view'""",
    "cast_arithmetic": """
        SELECT CAST(trunc(l_quantity) AS INTEGER) AS qty, count(*) AS n,
          CAST(sum(CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS DECIMAL(18,2))) AS DOUBLE) AS net
        FROM lineitem GROUP BY 1""",
    "month_substring_totals": """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""",
    "flat_map_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "flat_map_characters": "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(r_name, '')) AS c FROM region) WHERE c <> '' GROUP BY c",
    "range_pow": "SELECT range AS value, pow(range, 2) AS square FROM range(0, 1000, 7)",
    "range_negative_step": "SELECT row_number() OVER (ORDER BY range DESC) - 1 AS idx, range AS value FROM range(100, 0, -9)",
    "infinite_take": "SELECT range AS idx, (range * 37 + 11) % 101 AS value FROM range(100)",
    "export_columns": "SELECT p_partkey, printf('%s-%d', p_brand, p_size) AS code, repeat('*', p_size) AS bar FROM part WHERE p_size < 10",
    "json_props_extract": """
        SELECT k, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL GROUP BY k""",
    "json_roundtrip": "SELECT n_nationkey, n_name FROM nation",
    "sort_stable_asc": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey) AS BIGINT) AS rank FROM orders",
    "sort_stable_desc": "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey) AS BIGINT) AS rank FROM orders",
    "sort_composite_mixed": "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS rank FROM customer",
    "sort_then_chunk": """
        SELECT chunk, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers FROM (
          SELECT *, (row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) - 1) // 5000 AS chunk FROM lineitem) GROUP BY chunk""",
    "sort_nulls_last": """
        SELECT d.doc_id, CAST(row_number() OVER (ORDER BY quality ASC NULLS LAST, d.doc_id) AS BIGINT) AS rank
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "topk_search": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(p_name, 'e') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20",
    "topk_per_group": """
        SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank, o_orderkey, o_totalprice
        FROM orders QUALIFY rank <= 10""",
    "topk_groups_then_sort": """
        SELECT event_type, event_id, CAST(row_number() OVER (ORDER BY user_id DESC NULLS LAST, event_id, event_type) AS INTEGER) AS place FROM (
          SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) <= 10)""",
    "take_n": "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100",
    "skip_n": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 100",
    "page": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 40 ORDER BY p_partkey LIMIT 20 OFFSET 40",
    "first_row": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1",
    "chunk_summaries": """
        SELECT i // 1000 AS chunk, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(event_id) AS first_id, max(event_id) AS last_id
        FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1""",
    "chunk_rows": """
        SELECT i // 7 AS chunk, CAST(count(*) AS INTEGER) AS n, min(s_suppkey) AS first_key, max(s_suppkey) AS last_key
        FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) GROUP BY 1""",
    "take_while": "SELECT event_id, value FROM events WHERE event_id < coalesce((SELECT min(event_id) FROM events WHERE NOT coalesce(value < 489, false)), 9223372036854775807)",
    "drop_while": "SELECT event_id, value FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT coalesce(value < 489, false))",
    "dense_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders",
    "distinct_values": "SELECT DISTINCT event_type, user_id FROM events",
    "distinct_by_key_first": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "union_all": """
        SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "union_distinct": """
        SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "group_collect_sizes": "SELECT user_id, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id",
    "group_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "group_sum": "SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1",
    "group_avg": "SELECT l_linestatus, avg(l_quantity) AS mean FROM lineitem GROUP BY 1",
    "group_max": "SELECT o_orderstatus, max(o_totalprice) AS most FROM orders GROUP BY 1",
    "group_min": "SELECT p_brand, min(p_name) AS least FROM part GROUP BY 1",
    "group_null_key": "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "group_fold": """
        SELECT user_id, list_reduce(list_prepend(CAST(7 AS BIGINT), list(CAST(floor(value) AS BIGINT) ORDER BY event_id)), lambda acc, x: (acc * 3 + x) % 1000003) AS folded
        FROM events GROUP BY user_id""",
    "fold_first_value": """
        SELECT event_type, list_reduce(list(CAST(floor(value) AS BIGINT) ORDER BY event_id), lambda acc, x: acc - x) AS folded
        FROM events GROUP BY event_type""",
    "reduce_total": "SELECT list_reduce(list_prepend(CAST(1 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda acc, x: acc * 2 + x) AS folded FROM nation",
    "reduce_ranges": """
        WITH q AS (SELECT CAST(trunc(l_quantity) AS BIGINT) AS v, row_number() OVER w AS i, count(*) OVER () AS n, lag(CAST(trunc(l_quantity) AS BIGINT)) OVER w AS before
                   FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))
        SELECT max(v) FILTER (i = 1) AS first, max(v) FILTER (i = n) AS last, CAST(coalesce(sum(abs(v - before)), 0) AS BIGINT) AS moved FROM q""",
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "composite_key_group": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "accuracy": """
        SELECT avg(CAST(quality = CAST(length(text) > 500 AS INTEGER) AS DOUBLE)) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)""",
    "confusion_matrix": """
        SELECT quality AS actual, CAST(length(text) > 500 AS INTEGER) AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""",
    "rollup_revenue": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "cube_counts": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "pivot_status": """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
        FROM orders GROUP BY 1""",
    "distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "join_inner": """
        SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "join_left": "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_right": "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": """
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, quality, lang FROM (SELECT doc_id, quality FROM labels WHERE quality = 1) a
        FULL JOIN (SELECT doc_id, lang FROM documents WHERE lang = 'en') b ON a.doc_id = b.doc_id""",
    "join_semi": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "join_anti": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "gather_by_index": """
        SELECT idx, c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) WHERE idx < 1000 AND idx % 3 = 0""",
    "lookup_enrich": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "range_join_bucket": """
        SELECT b.range AS band, count(*) AS n FROM orders, range(40) b WHERE o_totalprice >= b.range * 15000 AND o_totalprice < b.range * 15000 + 20000 GROUP BY 1""",
    "ranking_functions": """
        SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER s AS INTEGER) AS rk, CAST(dense_rank() OVER s AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey), s AS (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS FIRST)""",
    "lag_lead": """
        SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(value) OVER w AS first_value,
          nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "moving_rows": """
        SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three FROM events""",
    "daily_orders_revenue_customers": """
        SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""",
    "store_totals": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "price_histogram": "SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1",
    "catalog_statistics": """
        SELECT count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, count(DISTINCT p_brand) AS brands, count(*) FILTER (p_size < 5) AS low_stock FROM part""",
    "category_statistics": """
        SELECT p_brand, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, max(p_size) AS most FROM part GROUP BY 1""",
    "cv_folds": """
        SELECT doc_id, (row_number() OVER (ORDER BY quality, doc_id) - 1) // greatest(1, (SELECT count(*) FROM labels) // 5) AS fold FROM labels QUALIFY fold < 5""",
    "split_80_20": """
        SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) - 1 < (SELECT count(*) FROM embeddings) * 8 // 10 THEN 'train' ELSE 'test' END AS part FROM embeddings""",
    "vector_row_stats": """
        SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS std, list_min(v) AS least, list_max(v) AS most, round(list_median(v), 6) AS median
        FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)""",
    "vector_feature_means": """
        SELECT CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (
          SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos""",
    "vector_center": """
        WITH m AS (SELECT avg(CAST(embedding[1] AS DOUBLE)) AS a, avg(CAST(embedding[-1] AS DOUBLE)) AS b FROM embeddings)
        SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) - a, 5) AS c0, round(CAST(embedding[-1] AS DOUBLE) - b, 5) AS c_last FROM embeddings, m""",
    "array_slice_step": """
        SELECT c_custkey, idx FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) WHERE idx >= 10 AND idx < 500 AND (idx - 10) % 7 = 0""",
    "array_negative_index": """
        SELECT c_custkey, c_name, idx FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) WHERE idx = (SELECT count(*) FROM customer) - 3""",
    "array_insert_delete": """
        WITH a AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation),
        b AS (SELECT k, CASE WHEN i >= 5 THEN i + 3 ELSE i END AS i FROM a UNION ALL SELECT CAST(range AS INTEGER), range - 100 + 5 FROM range(100, 103))
        SELECT k, CASE WHEN i >= 12 THEN i - 2 ELSE i END AS idx FROM b WHERE i < 10 OR i >= 12""",
    "array_append_len": "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) - 1 AS last_idx",
    "array_set_reverse": """
        SELECT n_nationkey, CASE i WHEN 0 THEN 'FIRST' WHEN 3 THEN 'FOURTH' ELSE n_name END AS n_name, (SELECT count(*) FROM nation) - 1 - i AS idx
        FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)""",
    "from_rows": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', 1), (1, 'b', NULL), (2, 'c', 3)) t(idx, name, v)",
    "map_latest_per_key": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "map_lookup": """
        SELECT range AS user_id, latest FROM range(400) LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS latest FROM events GROUP BY user_id) e ON range = e.user_id""",
    "sqrt_chunk_policy": "SELECT range AS n, CAST(least(10000, greatest(10, floor(sqrt(range)))) AS BIGINT) AS chunk FROM range(0, 200000000, 1234567)",
    "williams_bound": """
        SELECT range AS t, CASE WHEN range <= 0 THEN 1 ELSE CAST(floor(sqrt(range * log2(greatest(2, range)))) AS BIGINT) END AS bound FROM range(0, 1000000, 9973)""",
    "pressure_levels": """
        SELECT CASE WHEN value / 5 >= 95 THEN 'critical' WHEN value / 5 >= 85 THEN 'high' WHEN value / 5 >= 70 THEN 'medium' WHEN value / 5 >= 50 THEN 'low' ELSE 'none' END AS level, count(*) AS n
        FROM events GROUP BY 1""",
    "memory_trend": """
        WITH s AS (SELECT floor(value) AS p, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
        SELECT sum(p) / count(*) AS average, max(p) AS maximum,
          sum(p) FILTER (i >= n // 2) / count(*) FILTER (i >= n // 2) - sum(p) FILTER (i < n // 2) / count(*) FILTER (i < n // 2) AS trend FROM s""",
    "checkpoint_schedule": """
        WITH c AS (SELECT count(*) AS n, greatest(100, CAST(floor(sqrt(count(*))) AS BIGINT)) AS every FROM orders)
        SELECT i AS iteration FROM (SELECT unnest(range(1, n + 1)) AS i, every FROM c) WHERE i % every = 0""",
    "access_pattern": """
        WITH rows AS (SELECT event_type, event_id, event_id * 2 AS a FROM events UNION ALL SELECT 'all', event_id, event_id * 2 FROM events),
        steps AS (SELECT event_type, CAST(a - lag(a) OVER (PARTITION BY event_type ORDER BY event_id) AS DOUBLE) AS s FROM rows)
        SELECT event_type, CASE WHEN count(s) < 1 THEN 'unknown' WHEN stddev_pop(s) = 0 AND avg(s) = 1 THEN 'sequential' WHEN stddev_pop(s) = 0 THEN 'strided' ELSE 'random' END AS pattern
        FROM steps GROUP BY event_type""",
    "hierarchy_levels": """
        SELECT range AS power, CASE WHEN pow(2, range) <= 32768 THEN 'L1' WHEN pow(2, range) <= 262144 THEN 'L2' WHEN pow(2, range) <= 8388608 THEN 'L3'
          WHEN pow(2, range) <= 1073741824 THEN 'RAM' ELSE 'disk' END AS level FROM range(40)""",
    "csv_roundtrip": "SELECT count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(p_name) AS last_name FROM part",
    "jsonl_roundtrip": "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "text_lines": """
        SELECT count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en')""",
    "orc_roundtrip": "SELECT * FROM nation",
    "query_source": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1",
    "batch_process_counts": "SELECT count(*) AS n_rows, count(*) AS n_success, CAST(0 AS BIGINT) AS n_error FROM events",
    "tumbling_event_window": """
        SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""",
    "sliding_event_window": """
        SELECT CAST(w AS TIMESTAMP) AS window_start, count(*) AS n FROM (
          SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS w FROM events, (VALUES (0), (1)) t(k)) GROUP BY 1""",
    "session_window": """
        WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT CAST(min(ts) AS TIMESTAMP) AS session_start, user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY user_id, session""",
    "stream_resume_available_now": "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events WHERE value > 100",
    "conversation_turns": "SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
}

for _name, _size, _slide in (("count_window_sliding", 10, 3), ("count_window_tumbling", 10, 10), ("count_window_wide_slide", 10, 10)):
    ORACLE_SQL[_name] = f"""
        SELECT first_id, last_id, total FROM (
          SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER w AS n, min(event_id) OVER w AS first_id, max(event_id) OVER w AS last_id,
            CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total
          FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND {_size - 1} FOLLOWING)) WHERE n = {_size} AND i % {_slide} = 0"""

for _name, _verb in (("intersect_distinct", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except_distinct", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    ORACLE_SQL[_name] = f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 {_verb} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0"

for _name in ("asof_event", "asof_event_bucketed"):
    ORACLE_SQL[_name] = """
        SELECT v.event_id, (SELECT arg_max(b.value, {'t': b.ts, 'v': b.value}) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = v.user_id AND b.ts <= v.ts) AS value_asof
        FROM events v WHERE v.event_type = 'view'"""

ORACLE_SQL["hierarchy_transitions"] = """
    WITH l AS (SELECT event_id, value * value * 1000 AS size FROM events), n AS (
      SELECT event_id, CASE WHEN size <= 32768 THEN 'L1' WHEN size <= 262144 THEN 'L2' WHEN size <= 8388608 THEN 'L3' WHEN size <= 1073741824 THEN 'RAM' ELSE 'disk' END AS after FROM l
    ), b AS (SELECT lag(after) OVER (ORDER BY event_id) AS before, after FROM n)
    SELECT before, after, count(*) AS n FROM b WHERE before <> after GROUP BY before, after"""
ORACLE_SQL["shifted_orders"] = """
    WITH b AS (SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(lag(o_totalprice) OVER (ORDER BY o_orderkey) AS DECIMAL(18,2)) AS before FROM orders)
    SELECT o_orderstatus, count(*) AS n, CAST(sum(price - before) AS DOUBLE) AS change FROM b WHERE before IS NOT NULL GROUP BY o_orderstatus"""
ORACLE_SQL["layer_shapes"] = """
    WITH l AS (SELECT range AS idx, 'layer' || range AS name, ['Linear', 'Conv2d', 'ReLU'][range % 3 + 1] AS type, range * 31 % 64 + 1 AS i, range * 17 % 48 + 1 AS o FROM range(21)), p AS (
      SELECT *, CASE type WHEN 'Linear' THEN i * o + o WHEN 'Conv2d' THEN i * o * 9 + o ELSE i END AS params FROM l)
    SELECT idx, name, type, params, CASE type WHEN 'Linear' THEN o WHEN 'Conv2d' THEN o * 10000 ELSE params END * 4 AS activation_bytes FROM p"""
#: The layers of queries.LAYERS by their rule.
_LAYERS = """WITH layers AS (SELECT range AS idx, 'layer' || range AS name, ['Linear', 'Conv2d', 'ReLU'][range % 3 + 1] AS type,
    (range * 7919 % 500 + 1) * 1000 AS params, (range * 104729 % 900 + 1) * 4096 AS act FROM range(23)) """
ORACLE_SQL["layer_bottlenecks"] = _LAYERS + """
    SELECT name, params * 4 + act AS memory_bytes, CAST(row_number() OVER (ORDER BY params * 4 + act DESC, idx) AS INTEGER) AS rank FROM layers QUALIFY rank <= 4"""
ORACLE_SQL["layer_segments"] = _LAYERS + "SELECT name, idx // 4 AS segment, idx % 4 = 0 AS checkpointed FROM layers"
ORACLE_SQL["layer_precision"] = _LAYERS + "SELECT name, type IN ('Linear', 'Conv2d', 'Dense', 'Conv2D') AS half FROM layers"
ORACLE_SQL["training_memory_plan"] = _LAYERS + """, s AS (
      SELECT CAST(sum(params) AS BIGINT) * 16 + CAST(sum(act) AS BIGINT) * 32 AS total, CAST(sum(act) AS BIGINT) * 32 AS acts, CAST(sum(act) FILTER (idx % 4 = 0) AS BIGINT) * 32 AS kept FROM layers),
    f AS (SELECT *, total / 1073741824 > 0.6 AS c, total / 1073741824 > 0.8 AS m, total / 1073741824 > 1.0 AS a FROM s),
    p AS (SELECT *, CAST(floor(total - CASE WHEN c THEN kept / 2 ELSE 0 END - CASE WHEN m THEN acts / 2 ELSE 0 END) AS BIGINT) AS planned FROM f)
    SELECT total AS total_bytes, planned AS planned_bytes, c AS checkpointing, m AS mixed_precision, a AS accumulation,
      greatest(1, CASE WHEN a THEN CAST(ceil(planned / 1073741824) AS BIGINT) ELSE 1 END) AS steps,
      CASE WHEN c THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN m THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS speed FROM p"""
