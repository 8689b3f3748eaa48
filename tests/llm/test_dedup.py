import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowframe.llm import embedding_dedup, lines, minhash
from flowframe.llm.common import connected_components, scratch_dir

from . import plain


def test_minhash_against_brute_force(docs, corpus):
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter(plain.near_duplicates(corpus))


def test_minhash_on_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []


def test_minhash_family_around_the_threshold(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(plain.near_duplicates(rows))


def test_minhash_finds_every_link_of_a_table(spark):
    """Recall over links of full sets is 1: components are those of a comparison of all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == Counter(plain.near_duplicates(rows))


def test_common_passages_across_documents_that_are_no_duplicates(spark, monkeypatch):
    """A list of very many members that are not linked: blocks of it meet in chunks."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    monkeypatch.setattr(minhash, "LIST_CHUNK", 3)
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*common, *(f"u{i}x{j}" for j in range(int(rng.integers(8, 40))))])) for i in range(150)]
    rows += [(1000 + i, t + " tail") for i, t in rows[::10]]
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(plain.near_duplicates(rows))


def test_blocks_alone_give_the_same_links(spark, corpus, monkeypatch):
    """Without rounds of leaders, and with blocks of a few texts, the exact count inside blocks finds everything."""
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    df = spark.createDataFrame(corpus, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in minhash.near_duplicates(df).collect()) == Counter(plain.near_duplicates(corpus))


def test_least_shared():
    n = minhash.least_shared(64, (75, 100), 1e-7)
    rng = np.random.default_rng(0)
    assert 20 <= n <= 40 and (rng.binomial(64, 0.75, 100_000) >= n).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 150), (150, 200), (300, 40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([*range(41), 300], 0), 100: 100, 101: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


class Session:
    """As much of a session as scratch_dir asks."""

    def __init__(self, master, named=None, given=None):
        self.conf, self.sparkContext = SimpleNamespace(get=lambda key, default: named or default), SimpleNamespace(master=master, getCheckpointDir=lambda: given)


def test_scratch_tables_go_to_the_shared_folder():
    assert scratch_dir(Session("spark://m:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert scratch_dir(Session("yarn", None, "s3a://b/c")) == "s3a://b/c"
    assert scratch_dir(Session("local[2]")).startswith("file://")
    with pytest.raises(RuntimeError):
        scratch_dir(Session("yarn"))


def embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 7] + rng.standard_normal(16) * 0.15]) for i in range(40)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[1][1]]), (203, None), (204, []), (205, [0.0] * 16), (206, [None] + [1.0] * 15),
             (207, [float("nan")] * 16), (208, [float("inf")] * 16), (209, [1.0, 2.0]), (210, [2.0, 4.0]), (None, rows[3][1]), (None, None), (211, [1e200] * 16), (212, [1e-200] * 16)]
    return rows


@pytest.mark.parametrize("block", [None, 8])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    if block:
        for name in ("LEAST_BLOCK", "MOST_BLOCK"):
            monkeypatch.setattr(embedding_dedup, name, block)
    rows = embeddings(spark)
    unit = []
    for _, v in rows:
        x = np.array(v, float) if v and None not in v else np.zeros(0)
        ok = len(x) and np.isfinite(x).all() and x.any()
        unit.append((x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    union, n = plain.Union(len(rows)), [0] * len(rows)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95:
                n[i] += 1
                union.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        known = least.get(union.find(i))
        least[union.find(i)] = key if known is None else known if key is None else min(known, key)
    want = Counter((key, n[i], least[union.find(i)], key == least[union.find(i)]) for i, (key, _) in enumerate(rows))
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id bigint, embedding array<double>, node int, links string").repartition(3)
    assert Counter(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_window_counts_have_the_recall_they_promise():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal(a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.9505 * a + np.sqrt(1 - 0.9505 ** 2) * other
    one = np.ones(3000, np.int64)
    of_a, of_b, label = embedding_dedup.tally(a, b, 0.95, embedding_dedup.enough(), False, one, one)
    assert (of_a == 1).all() and (of_b == 1).all() and (label == np.tile(np.arange(3000), 2)).all()


def test_a_block_of_near_copies_keeps_no_pairs():
    """All of 8192 vectors are linked with all others: 67 million links are added up in little memory."""
    rng = np.random.default_rng(3)
    own = embedding_dedup.units(rng.standard_normal(32) + 0.01 * rng.standard_normal((8192, 32)))
    tracemalloc.start()
    of_a, _, label = embedding_dedup.tally(own, own, 0.95, embedding_dedup.enough(), True, np.ones(8192, np.int64), np.ones(8192, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (of_a == 8191).all() and not label.any() and most < 400 << 20


def test_vectors_that_are_multiples_fill_several_blocks(spark, monkeypatch):
    """Multiples of one vector share their place on every direction."""
    for name in ("LEAST_BLOCK", "MOST_BLOCK"):
        monkeypatch.setattr(embedding_dedup, name, 40)
    base = np.random.default_rng(8).standard_normal(12)
    df = spark.createDataFrame([(i, [float(x) for x in base * (i + 1)]) for i in range(300)], "vec_id bigint, embedding array<double>")
    rows = embedding_dedup.near_duplicates(df).collect()
    assert Counter((r.n_links, r.component_id) for r in rows) == {(299, 0): 300} and sum(r.kept for r in rows) == 1
    floats = embedding_dedup.near_duplicates(df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))).collect()
    assert Counter((r.n_links, r.component_id) for r in floats) == {(299, 0): 300}


@pytest.mark.parametrize("filter_bytes", [None, -1])
def test_lines_against_plain(docs, corpus, monkeypatch, filter_bytes):
    if filter_bytes:
        # filters stay with their shards, common keys and shards of many references are dealt over several tasks
        for name, value in (("FILTER_BYTES", filter_bytes), ("HOT_DOCS", 2), ("PROBE_ROWS", 7)):
            monkeypatch.setattr(lines, name, value)
    out = lines.dedup_lines(docs)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in docs.columns if c != "n_lines"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == Counter(plain.kept_lines(corpus))


def test_lines_on_nothing(no_docs):
    assert lines.dedup_lines(no_docs).collect() == []


def test_line_index_takes_documents_back(spark, corpus):
    own = [(k, t) for k, t in corpus if k is not None]
    df = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    early, late = own[::2], own[1::2]
    index = lines.LineIndex(spark).insert(df(early))
    # ids that repeat in both halves: their lines were there before
    late = [r for r in late if r[0] not in {k for k, _ in early}]
    before = Counter(tuple(r) for r in index.repeated.collect())
    index.insert(df(late))
    both = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(df(early + late), index=index).collect())
    assert both == Counter(plain.kept_lines(early + late))
    index.delete(df(late))
    assert Counter(tuple(r) for r in index.repeated.collect()) == before
    again = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(df(early), index=index).collect())
    assert again == Counter(plain.kept_lines(early))


def held(index):
    """The filters' fingerprints and the exact counts."""
    return sum(int((lines.CuckooFilter.load(r.data).table > 0).sum()) for r in index.filters.collect()), Counter(tuple(r) for r in index.state().where("n_docs > 0").collect())


def plain_state(rows):
    keys = {}
    for k, t in rows:
        for line in t.split("\n"):
            key = lines.line_key(line.encode())
            if len(key) >= 20:
                keys.setdefault(lines.key_hash(key), set()).add(k)
    return Counter((*key, len(docs), max(docs)) for key, docs in keys.items())


def test_line_index_is_repeatable_and_works_by_the_batch(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_RUNS", 3)
    text = lambda i: "\n".join(f"line number {j} of the common stock" for j in range(i % 7, 40, 1 + i % 5)) + f"\nonly here: document number {i}"
    df = lambda ids: spark.createDataFrame([(i, text(i)) for i in ids], "doc_id bigint, text string")
    index = lines.LineIndex(spark).insert(df(range(200)))
    assert held(index)[1] == plain_state([(i, text(i)) for i in range(200)])
    # a batch writes its own references and the keys it touches, whatever the index holds
    index.insert(df([500]))
    run = index.runs[-1]
    n = len(text(500).split("\n"))
    assert index.written().where(f"run = {run}").count() == n and index._read("keys", "hi bigint, lo bigint, n_docs bigint, last_doc bigint, was_docs bigint").where(f"run = {run}").count() == n
    once = held(index)
    runs = list(index.runs)
    index.insert(df([500, 3]))
    assert held(index) == once and index.runs == runs
    index.delete(df([500]))
    index.delete(df([500, 501]))
    assert held(index)[1] == plain_state([(i, text(i)) for i in range(200)])
    for i in range(0, 200, 40):  # runs are merged on the way
        index.delete(df(range(i, i + 40)))
        n, counts = held(index)
        assert counts == plain_state([(k, text(k)) for k in range(i + 40, 200)])
        assert n == sum(c[2] >= 3 for c in counts)
    assert len(index.runs) <= 3
    index.insert(df(range(5)))
    assert held(index)[1] == plain_state([(i, text(i)) for i in range(5)])
    assert lines.LineIndex(spark).delete(df([1])).state().count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(-2**63, 2**63 - 1, (50_000, 2))
    own = lines.CuckooFilter.of(keys[:, 0], keys[:, 1])
    assert own.contains(keys[:, 0], keys[:, 1]).all()
    other = rng.integers(-2**63, 2**63 - 1, (50_000, 2))
    assert own.contains(other[:, 0], other[:, 1]).mean() < 0.001
    own = lines.CuckooFilter.load(own.dump())
    own.remove(keys[:100, 0], keys[:100, 1])
    assert own.contains(keys[100:, 0], keys[100:, 1]).all() and own.contains(keys[:100, 0], keys[:100, 1]).mean() < 0.05
    full = lines.CuckooFilter(4)
    assert not full.add(keys[:40, 0], keys[:40, 1])
    assert len(lines.CuckooFilter.of(keys[:0, 0], keys[:0, 1]).table) == 4
