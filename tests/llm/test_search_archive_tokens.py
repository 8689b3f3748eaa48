import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowframe.llm import bpe, topk, warc
from flowframe.llm.oracle import ORACLE_SQL


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k_against_brute_force_and_sql(spark, block):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * 0.3]) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (50, rows[50][1]), (250, None), (300, [float("nan")] * 8), (350, [None] * 8), (400, [1.0, 2.0]), (None, rows[1][1]), (450, []), (500, [0.0] * 8),
             (7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (401, [2.0, 1.0]), (100, rows[3][1])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id bigint, embedding array<double>, part int").repartition(4)
    fine = [(k, tuple(np.floor(256 * np.array(v)).astype(int))) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q in {q for q, _ in fine if q % 50 == 0}:
        scored = sorted((-int(np.dot(v, w)), k) for p, v in fine if p == q for k, w in fine if k != q and len(w) == len(v))[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scored)]
    out = topk.top_k(df, topk.queries_of(df), block_rows=block)
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(want)
    embeddings = pa.table({"vec_id": [k for k, v in rows if v is None or len(v) == 8], "embedding": pa.array([v for _, v in rows if v is None or len(v) == 8], pa.list_(pa.float64()))})  # noqa: F841
    told = duckdb.sql(ORACLE_SQL["op7_topk_search"]).fetchall()
    assert sorted((q, r, k, s) for q, r, k, s in told if q is not None and k is not None) == [r for r in got if r[0] != 400]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == [] and topk.top_k(df, df.limit(0)).collect() == []


def test_block_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (3000, 24))
    rows[:5] *= 3
    block = topk.Block(np.arange(3000), rows)
    for q in (0, 7, 99):
        score = rows @ rows[q]
        want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        assert block.top(rows[q], q, 5) == [(-s, i) for s, i in want]
    assert block.taken < 0.75 * block.offered
    wide = topk.Block(np.arange(3000), rows << 18)
    assert wide.top(rows[7] << 18, 7, 5) == [(s << 36, i) for s, i in block.top(rows[7], 7, 5)]


def pages(spark):
    rows = [(i, f"http://h/{i} ü", f"<p>page {i}</p>" * 40) for i in range(60)]
    rows += [(100, "http://a", "same"), (101, "http://b", "same"), (102, None, "same"), (103, "", None), (104, "x\r\ny", ""), (None, "http://n", "same"), (105, "u", "é" * 3000), (106, "v", "x" * 300_000), (106, "v", "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, 1, b"f") for r in rows], "page_id bigint, url string, html string, roll int, frame binary").repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    out = warc.read_archives(spark, warc.write_archives(df, warc.archive_path(spark))).collect()
    largest = {}
    for k, _, h in rows:
        h = h or ""
        largest[h] = k if largest.get(h) is None else largest[h] if k is None else max(largest[h], k)
    want = Counter()
    for k, _, h in rows:
        body = (h or "").encode()
        first = largest[h or ""]
        name = f"urn:page:{'null' if k is None else k}"
        want[(name, "response" if k == first else "revisit", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), None if k == first else f"urn:page:{first}", body if k == first else None)] += 1
    assert Counter((r.record_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out) == want
    assert {r.target_uri for r in out if r.record_id == "urn:page:103"} == {"urn:page:103"}
    empty = warc.write_archives(df.limit(0), warc.archive_path(spark))
    assert warc.read_archives(spark, empty).collect() == []
    apart = warc.read_archives(spark, warc.write_archives(df, warc.archive_path(spark), least_revisit_bytes=100)).where("record_type = 'revisit'")
    assert apart.isEmpty()


def test_archives_roll_and_carry_dictionaries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    _, df = pages(spark)
    big = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).withColumn("page_id", F.col("page_id") * 10 + F.col("k")).withColumn("html", F.concat("html", F.lit(" "), F.col("k").cast("string"))).coalesce(1)
    at = warc.write_archives(big, f"file://{tmp_path}/w")
    assert warc.read_archives(spark, at).count() == big.count()
    files = [p for p in (tmp_path / "w").rglob("part-*") if p.suffix != ".crc"]
    assert len(files) > 1 and any(p.read_bytes()[:4] == warc.DICTIONARY_MAGIC for p in files)


def test_bad_records_are_found():
    good = warc.format_record("urn:page:1", "http://x", b"body", None, "2020-01-01T00:00:00Z")
    assert warc.parse_record(good)[7] == b"body"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"body", b"bode"),
                good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"2020-01-01T", b"2020-1-1T"), good.replace(b"WARC-Date", b"WARC-Type: response\r\nWARC-Date"),
                good.replace(b"Content-Length: 4", b"Content-Length: 5\r\nContent-Length: 4"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"), good + b"x", b""):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.records(frame + warc.EMPTY_FRAME + frame)) == [good, good]
    for cut in (1, 5, 9, len(frame) - 1):
        assert isinstance(list(warc.records(frame + frame[:cut]))[-1], warc.BadRecord)
    own = warc.train([bytes(f"<html><body>text number {i} and more of it</body></html>" * 40, "utf8") for i in range(60)])
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own)).compress(good)
    for held in (own, zstandard.ZstdCompressor().compress(own)):
        lead = warc.DICTIONARY_MAGIC + len(held).to_bytes(4, "little") + held
        assert list(warc.records(lead + packed)) == [good]
    assert isinstance(list(warc.records(warc.DICTIONARY_MAGIC + b"\xff\xff\xff\x7fabc"))[0], warc.BadRecord)


def test_records_are_unpacked_up_to_a_bound():
    reader = zstandard.ZstdDecompressor()
    for told in (True, False):
        frame = zstandard.ZstdCompressor(write_content_size=told).compress(b"\0" * (5 << 20))
        assert len(frame) < 10_000 and warc.unpack(reader, frame, 5 << 20) == b"\0" * (5 << 20)
        with pytest.raises(warc.BadRecord):
            warc.unpack(reader, frame, (5 << 20) - 1)


def test_archives_hold_long_payloads_and_stay_whole(spark):
    """Whatever the session says of rows in a file, an archive keeps its dictionary; a payload may be long."""
    rows = [(i, f"http://h/{i}", f"<html><body>text number {i} and more of it</body></html>" * 40) for i in range(60)] + [(60, "http://long", "0123456789é" * (2 << 20))]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        out = warc.read_archives(spark, warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), warc.archive_path(spark)))
        assert {(r.record_id, bytes(r.payload)) for r in out.collect()} == {(f"urn:page:{k}", h.encode()) for k, _, h in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_lenient_reading_reports_faults(spark, tmp_path):
    good = warc.format_record("urn:page:1", "http://x", b"body", None, "2020-01-01T00:00:00Z")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(good) + b"junk")
    rows = warc.read_archives(spark, f"file://{tmp_path}/a", strict=False).collect()
    assert sorted(r.error is None for r in rows) == [False, True]
    with pytest.raises(Exception):
        warc.read_archives(spark, f"file://{tmp_path}/a").collect()


@pytest.fixture(scope="module")
def library():
    engine = bpe.Engine.get(None, None)
    return tiktoken.Encoding("library", pat_str=engine.pattern.pattern, mergeable_ranks={v: k for k, v in engine.tokens.items()}, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (37, 9), (5, 0)])
def test_tokens_against_the_library(docs, corpus, library, chunk, overlap):
    if chunk < 1000:
        docs, corpus = docs.where("length(text) < 3000 or text is null"), [(k, t) for k, t in corpus if len(t or "") < 3000]
    rows = bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows)
    assert Counter(bpe.encode(docs, chunk=chunk, overlap=overlap, decoded=True).collect()) == Counter(rows)
    want = Counter()
    for k, t in corpus:
        ids = library.encode_ordinary(t or "")
        want[(k, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode())] += 1
    assert got == want


def test_tokens_of_nothing(no_docs):
    assert bpe.encode(no_docs).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z1é'\n\t  　-!rels\U0001F600"), max_size=80), st.integers(1, 12), st.integers(0, 8))
def test_stitching_equals_one_pass(text, chunk, overlap):
    pattern = bpe.Engine.get(None, None).pattern
    parts = bpe.cut(text, chunk, overlap)
    ends = [bpe.boundaries(pattern, s, p, n == len(parts) - 1) for n, (s, p) in enumerate(parts)]
    runs = bpe.stitch(pattern, text, [s for s, _ in parts], ends)
    assert bpe.stitched_ends(runs, ends) == [m.end() for m in pattern.finditer(text)]
