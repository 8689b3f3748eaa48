import pytest
from pyspark.sql import functions as F

from flowframe.sources import readers, sinks


def test_text_lines_keep_blanks(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"l1\r\n\nl3\r\r\n")
    assert [r.value for r in readers.from_file(spark, str(tmp_path / "t.txt")).collect()] == ["l1", "", "l3", ""]


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,"x\ny",\n2,z\n')
    rows = readers.from_csv(spark, str(tmp_path / "t.csv"), "a string, b string, c string").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", "x\ny", None), ("2", "z", None)]
    untyped = readers.from_csv(spark, str(tmp_path / "t.csv")).df
    assert dict(untyped.dtypes)["a"] == "string"


def test_csv_round_trip_with_delimiter(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"'), (2, "a;b")], "k int, t string")
    sinks.to_csv(df, str(tmp_path / "out"), delimiter=";")
    assert sorted((r.k, r.t) for r in readers.from_csv(spark, str(tmp_path / "out"), "k int, t string", delimiter=";").collect()) == [(1, 'say "hi"'), (2, "a;b")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n[1, 2]\n"x"\n')
    assert readers.from_jsonl(spark, str(tmp_path / "t.jsonl")).count() == 3
    sinks.to_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '{"a":1,"b":null}\n'
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        readers.from_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_text_append(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,)], "value int")
    sinks.to_file(df, str(tmp_path / "o"))
    sinks.to_file(df, str(tmp_path / "o"), mode="a")
    assert readers.from_file(spark, str(tmp_path / "o")).count() == 4


def test_ranges(spark):
    for args in [(5,), (2, 9), (9, 2, -3), (0,), (5, 1)]:
        assert [r.value for r in readers.from_range(spark, *args).collect()] == list(range(*args))
    assert [r.value for r in readers.generate(spark, 4, F.col("idx") * 2).collect()] == [0, 2, 4, 6]


def test_from_query(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert [r.id for r in readers.from_query(spark, "SELECT id FROM five WHERE id > :x", ["id"], x=2).collect()] == [3, 4]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(str(tmp_path / "p"))
    f = readers.from_parquet(spark, str(tmp_path / "p"), ["id"]).filter("b > 50").map(b="b")
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(b), GreaterThan(b,50)]" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_chained_pipeline_to_csv(spark, tmp_path):
    rows = readers.from_iterable(spark, [("x", 1.0, 2), ("y", 5.0, 1), ("x", 2.0, 3)], "product string, price double, quantity int")
    best = rows.filter("price > 0").with_columns(revenue=F.col("price") * F.col("quantity")).group_by("product").sum("revenue", "revenue")
    best.sort("revenue", reverse=True).take(1).to_csv(str(tmp_path / "o"), ["product", "revenue"])
    assert [(r.product, r.revenue) for r in readers.from_csv(spark, str(tmp_path / "o")).collect()] == [("x", "8.0")]
