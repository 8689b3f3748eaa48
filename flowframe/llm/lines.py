"""Line deduplication that can be taken back: cuckoo filters over exact reference counts.

Two exact tables are kept as runs, one a batch that changed anything: signed references (line key,
document), and the new count and largest document of each key that the batch touched. What a batch
writes, shuffles and aggregates is in proportion to the batch and to the references of the keys it
touches; runs are merged now and then. Beside them stand cuckoo filters, one a shard of the keys, of
those keys that have reached the count from which lines go. A filter answers "surely not" for nearly
all references without touching the exact counts; what passes is confirmed against them. Filters
support deletion, so documents can leave again and the lines they held down come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowframe.llm.common import arrow_map, column_name, discard, extended, materialize, scratch_path, streamed

#: Stripped at both ends of a line; with ASCII lower case this is what bytes.strip and bytes.lower do.
BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: A shard's filter takes about this many keys (about 2.3 bytes each).
SHARD_KEYS = 1 << 20
#: Filters of at most this many bytes in all are sent to every task; larger ones meet their shard's references in its tasks.
FILTER_BYTES = 24 << 20
#: References that one task takes past a shard's filter when filters are not sent to every task.
PROBE_ROWS = 4_000_000
#: A key of more documents is dealt over several tasks where references meet the exact table.
HOT_DOCS = 100_000
#: Runs of the index; with more they are merged into one.
MOST_RUNS = 8


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed 64-bit integers."""
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class CuckooFilter:
    """A cuckoo filter with 16-bit fingerprints, four to a bucket; 0 marks a free slot.

    A key is two 64-bit integers: the first gives the bucket, the second the fingerprint. ``add``
    places a batch where both buckets have room, and moves others along for the rest; when a
    chain of moves grows too long the table doubles and is filled anew by the caller (``add``
    returns False and leaves no key half placed).
    """

    MOST_MOVES = 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 4
        while buckets * SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (_mix(lo.view(np.uint64)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = _mix(hi.view(np.uint64)) & self.mask
        return print_, first, first ^ self.shift(print_)

    def shift(self, print_: np.ndarray) -> np.ndarray:
        """What separates a fingerprint's two buckets."""
        return _mix(print_.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) & self.mask

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, first, second = self.places(hi, lo)
        return (self.table[first] == print_[:, None]).any(1) | (self.table[second] == print_[:, None]).any(1)

    def add(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        print_, first, second = self.places(hi, lo)
        left = self._fill(print_, first, np.arange(len(print_)))
        left = self._fill(print_, second, left)
        return all(self._move(print_[i], int(second[i])) for i in left)

    def _fill(self, print_: np.ndarray, bucket: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; returns those without one."""
        for _ in range(SLOTS):
            if not len(left):
                break
            free = self.table[bucket[left]] == 0
            able = free.any(1)
            one, at = np.unique(bucket[left[able]], return_index=True)
            put = left[able][at]
            self.table[one, free[able][at].argmax(1)] = print_[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        return left

    def _move(self, print_: np.uint16, bucket: int) -> bool:
        state = 0x9E3779B9
        trail = []
        for _ in range(self.MOST_MOVES):
            row = self.table[bucket]
            if (free := np.flatnonzero(row == 0)).size:
                row[free[0]] = print_
                return True
            state = (state * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (state >> 16) % SLOTS
            trail.append((bucket, slot, print_))
            print_, row[slot] = row[slot], print_
            bucket = int(np.uint64(bucket) ^ self.shift(np.array([print_], np.uint16))[0])
        for bucket, slot, own in reversed(trail):  # take the moves back: no fingerprint is lost
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
        return False

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes one fingerprint out for each key; only for keys that were added."""
        for mark, *at in zip(*self.places(hi, lo)):
            for bucket in at:
                if (own := np.flatnonzero(self.table[bucket] == mark)).size:
                    self.table[bucket, own[0]] = 0
                    break

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        out = cls.sized(len(hi))
        while not out.add(hi, lo):
            out = cls(len(out.table) * 2)
        return out


class LineIndex:
    """Exact line references and their filters, in the shared folder; documents come and go.

    A document is its id: rows that share an id are one document. A reference (key, document)
    either stands or not, so inserting twice is as inserting once, and deleting twice as deleting
    once; ``delete`` takes the references of the given rows back, be they standing or not. Rows with
    a null id hold no references; their lines go wherever a key has reached the count, as no id of
    theirs can be the largest.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, min_chars: int = 20, path: str | None = None):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.path = path or scratch_path(spark, "line-index")
        self.runs: list[int] = []
        self.next_run = 0
        self.filter_runs: list[DataFrame] = []
        self.shards = 8

    def references(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, hi, lo) of each distinct key a row's text holds, keys of ``min_chars`` and more."""
        least = self.min_chars

        def make():
            def run(doc, text):
                seen = set()
                for line in text.split(b"\n"):
                    key = line_key(line)
                    if len(key) >= least and key not in seen and code_points(key) >= least:
                        seen.add(key)
                        yield (doc, *key_hash(key))

            return run

        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        return arrow_map(rows, make, "doc bigint, hi bigint, lo bigint", max_rows=32768)

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/run={n}" for n in self.runs]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, run int")
        return self.spark.read.schema(f"{schema}, run int").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def written(self) -> DataFrame:
        """The runs' references: (doc, hi, lo, sign, run). The sign of the last run tells whether a reference stands."""
        return self._read("refs", "doc bigint, hi bigint, lo bigint, sign int")

    def _standing(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("hi", "lo", "doc").agg(F.max_by("sign", "run").alias("sign")).where("sign > 0").drop("sign")

    def live(self) -> DataFrame:
        """The exact references: (hi, lo, doc) of those that stand."""
        return self._standing(self.written())

    def state(self) -> DataFrame:
        """The exact counts: (hi, lo, n_docs, last_doc) of each key."""
        rows = self._read("keys", "hi bigint, lo bigint, n_docs bigint, last_doc bigint, was_docs bigint")
        if len(self.runs) <= 1:
            return rows.select("hi", "lo", "n_docs", "last_doc")
        last = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("n_docs", "last_doc"), "run").alias("s"))
        return last.select("hi", "lo", "s.n_docs", "s.last_doc")

    @property
    def repeated(self) -> DataFrame:
        """(hi, lo, n_docs, last_doc) of the keys that have reached the count."""
        return self.state().where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._change(self.references(docs, id_col, text_col), 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Takes the documents' references back; docs are the rows as they were inserted."""
        return self._change(self.references(docs, id_col, text_col), -1)

    def _change(self, refs: DataFrame, sign: int) -> LineIndex:
        run, at = self.next_run, f"{self.path}/refs/run={self.next_run}"
        old_state, key = self.state(), ["hi", "lo"]
        if not self.runs:
            if sign < 0:
                return self
            # rows that share an id may repeat a reference; they count once
            refs.withColumn("sign", F.lit(1)).write.parquet(at)
            self._keep(run)
            counts = self.written().groupBy("hi", "lo", "doc").agg(F.lit(1)).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
            new = counts.withColumn("was_docs", F.lit(0).cast("bigint"))
        else:
            batch = materialize(refs.distinct(), "line-batch")
            standing = self._standing(self.written().join(batch, ["doc", "hi", "lo"], "left_semi"))
            changes = materialize(batch.join(standing, ["doc", "hi", "lo"], "left_anti" if sign > 0 else "left_semi").select("doc", "hi", "lo", F.lit(sign).alias("sign")), "line-changes")
            discard(self.spark, batch.path)
            if changes.isEmpty():
                discard(self.spark, changes.path)
                return self
            changes.write.parquet(at)
            self._keep(run)
            discard(self.spark, changes.path)
            changes = self.spark.read.schema("doc bigint, hi bigint, lo bigint, sign int").parquet(at)
            delta = changes.groupBy("hi", "lo").agg(F.sum("sign").alias("n"), F.max("doc").alias("doc"))
            was = F.coalesce("n_docs", F.lit(0).cast("bigint"))
            both = delta.join(old_state, key, "left").select("hi", "lo", (was + F.col("n")).alias("n_docs"), F.greatest("last_doc", "doc").alias("last_doc"), was.alias("was_docs"))
            if sign < 0:
                # only where the largest document left is the next one looked up
                headless = changes.join(old_state, key).where("doc = last_doc").select("hi", "lo").distinct()
                heirs = self._standing(self.written().join(headless, key, "left_semi")).groupBy("hi", "lo").agg(F.max("doc").alias("heir"))
                kept = delta.join(old_state, key).select("hi", "lo", (F.col("n_docs") + F.col("n")).alias("n_docs"), "last_doc", F.col("n_docs").alias("was_docs"))
                gone = headless.withColumn("headless", F.lit(True))
                both = kept.join(gone, key, "left").join(heirs, key, "left").withColumn("last_doc", F.when(F.col("headless"), F.col("heir")).otherwise(F.col("last_doc"))).drop("headless", "heir")
            new = both
        new.select("hi", "lo", "n_docs", "last_doc", "was_docs").write.parquet(f"{self.path}/keys/run={run}")
        self._refilter(run)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return self

    def _keep(self, run: int) -> None:
        self.runs.append(run)
        self.next_run = run + 1

    def compact(self) -> None:
        """Merges the runs into one of what stands."""
        run, old = self.next_run, list(self.runs)
        self.live().select("doc", "hi", "lo", F.lit(1).alias("sign")).write.parquet(f"{self.path}/refs/run={run}")
        self.state().where("n_docs > 0").withColumn("was_docs", F.col("n_docs")).write.parquet(f"{self.path}/keys/run={run}")
        self.runs = []
        self._keep(run)
        for n in old:
            for table in ("refs", "keys"):
                discard(self.spark, f"{self.path}/{table}/run={n}")

    def _shard(self, shards: int):
        return F.pmod(F.col("hi"), F.lit(shards)).cast("int")

    def _refilter(self, run: int) -> None:
        """Filters take in the keys that reached the count in this run and lose those that fell below."""
        if not self.filter_runs:
            self.filter_runs = [self._build()]
            return
        changed = self._read("keys", "hi bigint, lo bigint, n_docs bigint, last_doc bigint, was_docs bigint").where(F.col("run") == run)
        least = F.lit(self.min_docs)
        crossed = changed.where((F.col("n_docs") >= least) != (F.col("was_docs") >= least))
        rows = crossed.select(self._shard(self.shards).alias("shard"), "hi", "lo", F.when(F.col("n_docs") >= least, 1).otherwise(-1).alias("sign"))
        old = self.filters.join(rows.select("shard").distinct(), "shard", "left_semi")

        def update(_, filters, rows):
            shard = (filters if filters.num_rows else rows).column("shard")[0]
            hi, lo, sign = (rows.column(c).to_numpy() for c in ("hi", "lo", "sign"))
            own = CuckooFilter.load(filters.column("data")[0].as_py()) if filters.num_rows else CuckooFilter.sized(max(64, len(hi)))
            own.remove(hi[sign < 0], lo[sign < 0])
            data = own.dump() if own.add(hi[sign > 0], lo[sign > 0]) else None
            return pa.table({"shard": pa.array([shard.as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

        new = materialize(old.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(update, "shard int, data binary"), "line-filters")
        full = not new.where("data is null").isEmpty()
        self.filter_runs = [self._build()] if full else [*self.filter_runs, new]
        if len(self.filter_runs) > MOST_RUNS:
            self.filter_runs = [materialize(self.filters, "line-filters")]

    def _build(self) -> DataFrame:
        keys = self.repeated
        self.shards = max(8, -(-keys.count() // SHARD_KEYS))

        def build(table):
            hi, lo = (table.column(c).to_numpy() for c in ("hi", "lo"))
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "data": pa.array([CuckooFilter.of(hi, lo).dump()], pa.binary())})

        sharded = keys.select(self._shard(self.shards).alias("shard"), "hi", "lo")
        return materialize(sharded.groupBy("shard").applyInArrow(build, "shard int, data binary"), "line-filters")

    @property
    def filters(self) -> DataFrame:
        """(shard, data): each shard's filter as of its last change."""
        if len(self.filter_runs) <= 1:
            return self.filter_runs[0] if self.filter_runs else self.spark.createDataFrame([], "shard int, data binary")
        dated = [df.withColumn("run", F.lit(n)) for n, df in enumerate(self.filter_runs)]
        return reduce(DataFrame.unionAll, dated).groupBy("shard").agg(F.max_by("data", "run").alias("data"))

    def candidates(self, refs: DataFrame) -> DataFrame:
        """References (doc, hi, lo) whose key a filter knows."""
        refs, kind = refs.select("doc", "hi", "lo"), "doc bigint, hi bigint, lo bigint"
        size = self.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        if size > FILTER_BYTES:
            return self._candidates_by_shard(refs, kind)
        held = {row.shard: row.data for row in self.filters.collect()}  # bounded by FILTER_BYTES
        sent = self.spark.sparkContext.broadcast(held)
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {shard: CuckooFilter.load(data) for shard, data in sent.value.items()}
            for batch in batches:
                hi, lo = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("hi", "lo"))
                shard, keep = hi % shards, np.zeros(len(hi), bool)
                for s, own in filters.items():
                    at = np.flatnonzero(shard == s)
                    keep[at] = own.contains(hi[at], lo[at])
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return refs.mapInArrow(probe, kind)

    def _candidates_by_shard(self, refs: DataFrame, kind: str) -> DataFrame:
        """The same where filters are too large to send: references go to their shard's tasks, which hold its filter alone.

        A shard with more references than PROBE_ROWS, as that of a very common line, gets several tasks.
        """
        rows = refs.withColumn("shard", self._shard(self.shards))
        known = self.filters.select("shard").join(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard")
        # a row a shard: as many as there are millions of repeated keys
        tasks = materialize(known.select("shard", F.ceil(F.col("n") / PROBE_ROWS).cast("int").alias("tasks")), "line-shards")
        last = F.sum("tasks").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = tasks.select("shard", "tasks", (last - F.col("tasks")).cast("int").alias("first"))
        parts = tasks.agg(F.coalesce(F.sum("tasks"), F.lit(0))).first()[0]
        filters = self.filters.join(placed, "shard").select(F.explode(F.sequence("first", F.col("first") + F.col("tasks") - 1)).alias("part"), "data")
        dealt = rows.join(F.broadcast(placed), "shard").select((F.col("first") + F.pmod(F.xxhash64("doc"), F.col("tasks"))).cast("int").alias("part"), "doc", "hi", "lo")

        def probe(pieces):
            own = None
            for first, batch in pieces:
                if first == 0:
                    own = CuckooFilter.load(batch.column(batch.schema.get_field_index("data"))[0].as_py())
                    continue
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc", "hi", "lo")]
                keep = own.contains(columns[1].to_numpy(), columns[2].to_numpy())
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "hi", "lo"]).filter(pa.array(keep))

        return streamed(filters, dealt, max(1, parts), probe, kind)

    def doomed(self, refs: DataFrame) -> DataFrame:
        """(doc, keys): the keys whose lines a document loses, as sorted 16-byte strings in one binary."""
        parts = F.ceil(F.col("n_docs") / HOT_DOCS).cast("int")
        exact = self.repeated.select("hi", "lo", "last_doc", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        # keys so common are few: there are at most as many as references over HOT_DOCS
        hot = self.repeated.where(F.col("n_docs") > HOT_DOCS).select("hi", "lo", parts.alias("parts"))
        rows = self.candidates(refs).join(F.broadcast(hot), ["hi", "lo"], "left")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int"))
        hit = rows.join(exact, ["hi", "lo", "salt"]).where("doc <> last_doc")
        key = F.concat(F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0")))
        return hit.groupBy("doc").agg(F.collect_set(key).alias("keys"))


def _rebuild(text: bytes, keys: set[bytes], least: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not keys:
        return len(lines), 0, text
    kept = []
    for line in lines:
        key = line_key(line)
        if len(key) < least or code_points(key) < least or xxhash.xxh3_128_digest(key) not in keys:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20,
                index: LineIndex | None = None) -> DataFrame:
    """The rows with repeated lines dropped: all columns of docs, then n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    ``min_chars`` code points and more that ``min_docs`` documents or more hold lose all their
    lines but those in the largest id that holds them. Null and empty texts are one empty line
    and become empty texts. Ids are integers; rows that share one are one document. Rows with a null id are
    counted nowhere and lose every line whose key has reached the count. An index that already
    holds documents may be given; docs are then measured against it and not inserted. An empty table
    gives an empty one. Texts are taken whole, one at a time; a document's repeated keys must fit in a
    row. Columns named as the two results are replaced.
    """
    spark = docs.sparkSession
    if index is None:
        index = LineIndex(spark, min_docs, min_chars).insert(docs, id_col, text_col)
        refs = index.written()
    else:
        refs = index.references(docs, id_col, text_col)
    least = index.min_chars
    kept = docs.drop("n_lines", "n_dropped")
    doc, keys, mark = (column_name(kept, c) for c in ("doc", "keys", "mark"))
    lost = index.doomed(refs).select(F.col("doc").alias(doc), F.col("keys").alias(keys))
    # rows without an id stay out of the join: they would all meet in one task
    rows = kept.where(F.col(id_col).isNotNull()).join(lost, F.col(id_col).cast("bigint") == F.col(doc), "left").drop(doc)
    if not docs.where(F.col(id_col).isNull()).isEmpty():
        rows = rows.unionByName(_null_ids(index, kept.where(F.col(id_col).isNull()), text_col, keys, mark))
    schema = extended(rows.drop(keys), n_lines=T.LongType(), n_dropped=T.LongType())
    names = rows.columns
    at, key_at = names.index(text_col), names.index(keys)

    def make():
        def run(*row):
            text = (row[at] or "").encode("utf-8", "replace")
            n, gone, new = _rebuild(text, set(row[key_at] or ()), least)
            out = list(row)
            out[at] = new.decode("utf-8")
            del out[key_at]
            yield (*out, n, gone)

        return run

    return arrow_map(rows, make, schema)


def _null_ids(index: LineIndex, rows: DataFrame, text_col: str, keys: str, mark: str) -> DataFrame:
    """Rows without an id, each with the repeated keys its text holds, by a name made of its content."""
    named = rows.withColumn(mark, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    least = index.min_chars

    def make():
        def run(name, text):
            for key in {line_key(line) for line in text.split(b"\n")}:
                if len(key) >= least and code_points(key) >= least:
                    yield (name, *key_hash(key))

        return run

    found = arrow_map(named.select(mark, F.coalesce(F.col(text_col), F.lit("")).cast("binary")).distinct(), make, "name string, hi bigint, lo bigint")
    pair = F.concat(F.unhex(F.lpad(F.hex("hi"), 16, "0")), F.unhex(F.lpad(F.hex("lo"), 16, "0")))
    lost = found.join(index.repeated.select("hi", "lo"), ["hi", "lo"]).groupBy("name").agg(F.collect_set(pair).alias(keys))
    return named.join(lost, named[mark] == lost["name"], "left").drop("name", mark)
