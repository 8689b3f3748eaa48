import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowframe.llm import bpe, minhash, mixing, quality
from flowframe.llm.queries import QUERIES

from . import plain


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES["op8_quality"](spark, sf)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    assert len(rows) > 40 and all(r.predicted == 1 for r in good)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    own = scored.collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in own)


def plain_score(model, text):
    """The model's score of one text, feature by feature and passage by passage."""
    kinds = [(string.ascii_lowercase, 0), (string.ascii_uppercase, 1), (string.digits, 2), (" ", 3), ("\n\r", 4), (".,;:", 5), ("!?", 6), ("'\"`", 7), ("()[]{}<>", 8), ("#$%&*@^~", 9), ("|\\/_+=-", 10)]
    kind = lambda b: 11 if 0x80 <= b < 0xC0 else 12 if b >= 0xC0 else next((k for chars, k in kinds if chr(b) in chars), 13)
    p = {k: np.asarray(v, float) for k, v in model.weights.items()}
    encoded, gates = [], []
    data = (text or "").encode()
    for at in range(0, max(1, len(data)), 512):
        part = data[at:at + 512]
        x = [0.0] * (14 + 196)
        for i, b in enumerate(part):
            x[kind(b)] += 1
            if i:
                x[14 + 14 * kind(part[i - 1]) + kind(b)] += 1
        words, n = part.split(), max(1, len(part))
        again = 1 - len(set(words)) / len(words) if words else 0.0
        x = [math.sqrt(v / n) for v in x] + [math.log1p(n) / math.log1p(512), again, sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))]
        h = np.tanh(((np.array(x) - model.mean) / model.scale) @ p["W"] + p["b"])
        encoded.append(h)
        gates.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
    a = [math.exp(g - max(gates)) for g in gates]
    z = sum(w * h for w, h in zip(a, encoded)) / sum(a)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"])))


def test_scores_against_a_plain_computation(spark, docs, sf):
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = quality.score_quality(docs, model).select("doc_id", "text", "score", "predicted").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r.score - plain_score(model, r.text)) < 1e-4 and r.predicted == (r.score >= 0.3)


def test_query_scores_as_its_model_does(spark, sf):
    """The query is that model over whole texts: learnt from rows not held out, whatever those held out are labelled."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    taught = labels.where(~quality.held_out(F.col("doc_id")))
    model = quality.learn(docs, taught)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op8_quality"](spark, sf).collect():
        assert abs(r.score - plain_score(model, text[r.doc_id])) < 1e-4


def test_scores_depend_on_the_text_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(docs, labels)
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source")).repartition(7)
    a = {(r.doc_id, r.text): r.score for r in quality.score_quality(docs, model).collect()}
    b = {(r.doc_id - 7, r.text): r.score for r in quality.score_quality(other, model).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_odd_inputs(spark, docs, no_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = labels.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int"))
    out = quality.classify(docs, odd)
    assert out.count() == docs.count() and out.where("score is null or predicted is null or held_out is null").isEmpty()
    assert out.where("text is null or text = ''").select("score").distinct().count() == 1
    assert quality.classify(no_docs, labels).collect() == []
    assert quality.learn(docs, labels.limit(0)) == 0.5
    assert quality.learn(docs, labels.where("quality = 1")) == 1.0
    assert {r.score for r in quality.score_quality(docs, 0.5).collect()} == {0.5}


def test_model_attends_to_the_passage_that_counts():
    rng = np.random.default_rng(0)
    clean = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(85)).encode()[:512]
    junk = lambda: "!! ".join("".join(rng.choice(list("ABCDEFGH"), 5)) for _ in range(64)).encode()[:512]
    bags, y = [], []
    for i in range(300):
        parts = [clean() for _ in range(rng.integers(2, 9))]
        if i % 4 == 0:
            parts[rng.integers(len(parts))] = junk()
        bags.append(quality.passages(b"".join(parts)))
        y.append(float(i % 4 > 0))
    model = quality.fit(bags[:200], np.array(y[:200]))
    owner = np.repeat(np.arange(100), [len(b) for b in bags[200:]])
    score = model.score(np.concatenate(bags[200:]), owner, 100)
    assert ((score >= 0.3) == np.array(y[200:])).mean() > 0.95


def test_fitting_takes_every_passage_and_all_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c. " * 8000 + "!" * i) for i in range(12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append([len(b) for b in bags]))
    quality.learn(docs, labels)
    assert seen and set(seen[0]) == {-(-7 * 8000 // quality.PASSAGE_BYTES)}
    monkeypatch.undo()
    rounds, encode = [], quality.AttentionModel.encode
    monkeypatch.setattr(quality.AttentionModel, "encode", lambda model, x: (rounds.append(len(x)), encode(model, x))[1])
    one = np.zeros((1, quality.FEATURES), np.float32)
    quality.fit([one] * 4000, np.arange(4000) % 2, rounds=40, batch=2000)
    assert sum(rounds) == 40 * 4000


def test_pipeline_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, sf)
    assert kept.columns == docs.columns
    scored = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).select("doc_id", "text", "score").collect()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(rows) == Counter((r.doc_id, r.text) for r in scored if r.score >= 0.3)
    engine = bpe.Engine.get(None, None)
    library = tiktoken.Encoding("library", pat_str=engine.pattern.pattern, mergeable_ranks={v: k for k, v in engine.tokens.items()}, special_tokens={})
    want = Counter()
    for k, t in plain.one_of_each_group([(k, t) for k, _, _, t in plain.kept_lines(rows)]):
        ids = library.encode_ordinary(t)
        want[(k, len(ids), plain.sha256(np.array(ids, "<u4").tobytes()), plain.sha256(t.encode()))] += 1
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def odd_corpus():
    """(id, text): ids that repeat, null ids, copies and near copies among them, nulls and empty texts."""
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i * 7 % 31}" for i in range(40))
    return [(3, words), (5, words), (5, "a text of its own that id five holds as well, unlike any other here"), (None, words), (None, other), (None, other), (7, words + " more"), (7, words + " more"),
            (9, other + " x"), (11, None), (11, ""), (12, ""), (None, None), (13, "one two"), (15, "One two"), (14, "one two"), (None, "only here and without an id, so it has to stay"), (5, words)]


def test_near_duplicates_leave_by_row(spark):
    df = spark.createDataFrame([(k, t, "d", 1) for k, t in odd_corpus()], "doc_id bigint, text string, d_key string, d_first int").repartition(3)
    for few in (minhash.BROADCAST_NAMES, -1):
        minhash.BROADCAST_NAMES, before = few, minhash.BROADCAST_NAMES
        try:
            out = minhash.deduplicate(df)
            assert out.columns == df.columns
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(plain.one_of_each_group(odd_corpus()))
        finally:
            minhash.BROADCAST_NAMES = before
    assert minhash.deduplicate(df.limit(0)).collect() == []


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(k, t, "en", s, None if t is None else len(t)) for i, (k, t) in enumerate(odd_corpus()) for s in (("a", None, "b")[i % 3],)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, None), (3, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    own = [(k, t or "") for k, t in odd_corpus()]
    want = Counter((k, plain.sha256(t.encode())) for k, t in plain.one_of_each_group([(k, t) for k, _, _, t in plain.kept_lines(own)]))
    assert Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == want
    none = f"{sf}/none"
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_mixing_stage_orders_files_and_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in docs.collect())
    mixed.write.parquet(f"{tmp_path}/mixed")
    written = [i for part in sorted((tmp_path / "mixed").glob("part-*")) for i in pq.read_table(part, columns=["doc_id"])["doc_id"].to_pylist()]
    place = {r.doc_id: (r.slot, r.within) for r in mixing.mix(docs).select("doc_id", "slot", "within").collect()}
    assert written == sorted(written, key=place.get)


def test_stages_are_named_functions():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert corpus_pipeline.ORACLE_SQL is None
