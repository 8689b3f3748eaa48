"""Every corpus query that SQL can tell against its SQL: whole small tables, with awkward documents beside."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowframe.llm import licenses
from flowframe.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def tables(spark, sf, corpus, tmp_path_factory):
    """A folder of tables; documents are the awkward ones too, each with an id of its own, and notices over many lines."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    texts = [t for _, t in corpus]
    for label in ("bsd", "cc0", "mit-text", "gpl-notice"):
        own = licenses.TEMPLATES[label].split()
        for lines in (1, 6, 11, 17):
            for part in (len(own), len(own) * 4 // 5, len(own) * 3 // 5):
                texts.append("\n".join(" ".join(own[i * part // lines:(i + 1) * part // lines]) for i in range(lines)))
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    pieces = ["token=", "PassWord: ", "AKIA", " ", "\n", ".", "é", "toKen=abcdefgh1", "0123456789abcdef" * 2, "get_name_of_user_2024_again", "AKIA" + "Q7" * 9]
    texts += ["".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(n)) for n in (5, 40, 400, 2000) for _ in range(4)]
    rows = [(i, t, rng.choice(["a", "b", "b", "b", "c", None])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{folder}/documents.parquet")
    for name in TABLES[1:]:
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_tells_what_its_sql_tells(spark, tables, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    told = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in told.description)
    at = [[c[0] for c in told.description].index(c) for c in columns]
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    want = sorted((rounded([row[i] for i in at]) for row in told.fetchall()), key=repr)
    out = QUERIES[name](spark, tables)
    assert sorted(out.columns) == columns
    assert sorted((rounded(row) for row in out.select(*columns).collect()), key=repr) == want


def test_sql_of_secrets_tells_added_spans(spark, tables):
    assert QUERIES["op3_secret_scan"](spark, tables).where(F.col("spans").contains("random")).count() >= 10
