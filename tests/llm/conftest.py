import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i * i % 997}x{i % 13}" for i in range(20_000))
SAME = "the same line stands in many documents here"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def corpus(spark, sf):
    """(id, text) of the documents, with awkward ones: nulls, empty and long texts, repeats, blanks of all kinds."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    return rows + [
        (900_001, None), (900_002, ""), (900_003, " \t\n\x0b\x0c\r "), (900_004, "one two"), (900_005, "One TWO"), (900_006, LONG), (900_007, LONG + " tail"),
        (900_008, base), (900_009, base), (900_009, base), (900_010, base + " extra"), (900_010, "another text with the same id as its neighbour has"),
        (900_011, "É k K İ mitKense MIT License cc by CC-BY x " + "0123456789abcdef" * 2 + "f AKIA" + "B7" * 9),
        (900_012, "Password: hunter2hunter2\r\napi_key='ABCDEFGH1234'\ntoken=short\nsecret='token': 'abcdefghij'\n\U0001F600 API-KEY = x"),
        (900_013, f"{SAME}\n\n{SAME}\nshort"), (900_014, f"  {SAME.upper()}\t\nmine"), (900_015, SAME), (900_016, f"{SAME}\n"),
        (None, f"{SAME}\nno id"), (None, None), (900_017, "licensed under the apache license version 2.0 you may not use this file except in compliance with the license you may obtain a copy"),
    ]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus, with columns whose names clash with those the operators use."""
    rows = [(k, t, "en", 1, "x", 5, b"z", "n", 0.5, 2) for k, t in corpus]
    schema = "doc_id bigint, text string, lang string, n_lines int, keys string, bucket int, packed binary, Node string, score double, slot int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return docs.limit(0)
