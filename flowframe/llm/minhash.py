"""MinHash near-duplicates: bottom-k sketches of one hash function, and exact Jaccard at the end.

A document's set is that of its distinct word shingles, each hashed once to 64 bits; its sketch
is the k smallest hashes. Documents with equal sets form a class. Retained values are held in
inverted lists; the sketch of two classes' union estimates their similarity; what passes is
verified on the full sets, made anew from the texts.

Lists are kept short without losing links: values are ordered by the number of sketches that
retain them, rare ones first, and a class enters the lists of a prefix only. A pair that shares
x retained values must meet in the first (size - x + 1) of both. Lists are not expanded into
pairs either: their members are first compared with one leader each, in a few rounds. Where a
list still spans several components, its members are dealt into blocks, and exact overlaps are
counted inside pairs of blocks, of which only spanning links come out.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.llm.common import arrow_map, column_name, connected_components, discard, least_in_component, materialize

SHINGLE = 5
#: Similarity as a fraction: 75 / 100.
THRESHOLD = (75, 100)
K = 64
#: A pair at the threshold fails the sketches' tests with this probability at most.
MISS = 1e-7
#: Rounds in which the members of a list are compared with a leader only.
LEADER_ROUNDS = 2
#: Shingles in a block of texts whose overlaps one task counts.
BLOCK_SHINGLES = 300_000
#: Blocks of one list that a task pairs with the list's others.
LIST_CHUNK = 64
#: Texts of this many classes at most are picked out by a broadcast of their names, else by a join.
BROADCAST_NAMES = 300_000
#: Fixed odd factors that tell a shingle's places apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as ascending signed 64-bit hashes.

    Words lie between ASCII white space, A-Z in lower case (as bytes.lower and bytes.split do). A
    text of fewer words than a shingle has is one shingle; one without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < size:
        total = np.array([np.uint64(n)])
        for k in range(n):
            total = _mix(total * FACTORS[0] + h[k:k + 1])
        return total.view(np.int64)
    factors = FACTORS if size == len(FACTORS) else _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = h[:n - size + 1] * factors[0]
    for k in range(1, size):
        total = total + h[k:n - size + 1 + k] * factors[k]
    return np.unique(_mix(total).view(np.int64))


def least_shared(k: int = K, threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> int:
    """How many of the union's k smallest values a pair at the threshold shares, but for ``miss``.

    Drawn without replacement from the union; the binomial's tail is the wider one.
    """
    p = threshold[0] / threshold[1]
    below, count = 0.0, 0
    while count < k:
        below += comb(k, count) * p ** count * (1 - p) ** (k - count)
        if below > miss:
            break
        count += 1
    return max(1, count)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(key, text_hash, n_shingles, signature, sketch): one row a document; a set's signature has 128 bits."""
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))

    def make():
        def run(key, text_hash, text):
            own = shingles(text, size)
            yield key, text_hash, len(own), xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None, own[:k].tolist()

        return run

    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows, make, f"key {kind}, text_hash bigint, n_shingles bigint, signature binary, sketch array<bigint>")


def _lists(classes: DataFrame, k: int, threshold: tuple[int, int], shared: int) -> DataFrame:
    """(value, node): the inverted lists of the values in the classes' prefixes."""
    held = classes.select("node", F.explode("sketch").alias("value"))
    # a table of its own, so that the join deals a common value's rows over several tasks
    common = materialize(held.groupBy("value").agg(F.count(F.lit(1)).alias("n_sketches")).where("n_sketches > 1"), "minhash-common")
    own = held.join(common, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n_sketches", "value"))).alias("common"))
    size = F.size("sketch")
    # a set that lies whole in its sketch, as do all sets it can be linked with, shares a known part of it
    exact = F.ceil(size * F.lit(threshold[0]) / F.lit(threshold[1])).cast("int")
    need = F.when(size <= k * threshold[0] // threshold[1], exact).otherwise(F.least(F.lit(shared), exact))
    rows = classes.select("node", "sketch").join(own, "node")
    rows = rows.select("node", "common", (size - need + 1 - (size - F.size("common"))).alias("most")).where("most > 0")
    return rows.select(F.explode(F.slice("common", F.lit(1), F.col("most"))).alias("x"), "node").select("x.value", "node")


class _Verifier:
    """Tells which pairs of classes are linked: sketches first, then the texts' full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, size: int, threshold: tuple[int, int], shared: int):
        self.classes, self.k, self.size, self.threshold, self.shared = classes, k, size, threshold, shared
        self.texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("key", F.xxhash64("text").alias("text_hash"), "text")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose union's sketch leaves a link possible."""
        up, down = self.threshold
        side = lambda s: self.classes.select(F.col("node").alias(s), F.col("sketch").alias(f"{s}_sketch"), F.col("n_shingles").alias(f"{s}_n"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").where((F.col("a_n") * down >= F.col("b_n") * up) & (F.col("b_n") * down >= F.col("a_n") * up))
        union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, self.k)
        found = both.withColumn("u", union).withColumn("s", F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), F.col("u"))))
        whole = (F.col("a_n") <= self.k) & (F.col("b_n") <= self.k) & (F.size("u") < self.k)
        return found.where(F.when(whole, F.col("s") * down >= F.size("u") * up).otherwise(F.col("s") >= self.shared)).select("a", "b")

    def packed(self, nodes: DataFrame) -> DataFrame:
        """(node, packed): the compressed text of each class, as a table in the shared folder."""
        needed = materialize(self.classes.join(nodes, "node", "left_semi").select("node", F.col("rep.key").alias("rep_key"), F.col("rep.text_hash").alias("rep_hash")), "minhash-needed")
        few = needed.count() <= BROADCAST_NAMES
        texts = self.texts.join(F.broadcast(needed) if few else needed, (F.col("text_hash") == F.col("rep_hash")) & F.col("key").eqNullSafe(F.col("rep_key")))
        packed = arrow_map(texts.select("node", F.col("text").cast("binary")), _pack, "node bigint, packed binary")
        out = materialize(packed.groupBy("node").agg(F.first("packed").alias("packed")), "minhash-texts")
        discard(out.sparkSession, needed.path)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, as a table in the shared folder."""
        likely = materialize(self.likely(pairs), "minhash-likely")
        packed = self.packed(likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))).distinct())
        size, threshold = self.size, self.threshold

        def make():
            unpack = zstandard.ZstdDecompressor()
            last: dict[int, np.ndarray] = {}

            def own(node, data):
                if node not in last:
                    if len(last) >= 16:
                        last.clear()
                    last[node] = shingles(unpack.decompress(data), size)
                return last[node]

            def run(a, b, a_text, b_text):
                x, y = own(a, a_text), own(b, b_text)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if threshold[1] * both >= threshold[0] * (len(x) + len(y) - both):
                    yield a, b

            return run

        side = lambda s: packed.select(F.col("node").alias(s), F.col("packed").alias(f"{s}_text"))
        rows = likely.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
        out = materialize(arrow_map(rows, make, "a bigint, b bigint"), "minhash-links")
        for table in (likely, packed):
            discard(table.sparkSession, table.path)
        return out

    def spanning(self, lists: DataFrame) -> DataFrame:
        """Links (a, b) that span the components among members of common lists, by exact overlaps.

        Members are dealt into blocks of about BLOCK_SHINGLES shingles: by size first, as sets are
        only linked with those of about their size, and in a class of sizes those led by the same
        class together; a larger following fills several blocks. Blocks of like sizes meet where
        they share a list. In a pair of blocks the full sets' overlaps are counted over their own
        inverted lists; only spanning links leave the task.
        """
        # sets that can be linked lie in one class of sizes or in neighbouring ones
        ratio = log(self.threshold[1] / self.threshold[0] * 1.000001)
        sizes = self.classes.select("node", "n_shingles", F.floor(F.log("n_shingles") / ratio).cast("int").alias("sized"))
        lead = materialize(lists.groupBy("value").agg(F.min("node").alias("lead")), "minhash-leads")
        member = lists.join(lead, "value").groupBy("node").agg(F.min("lead").alias("lead")).join(sizes, "node")
        led = member.groupBy("sized", "lead").agg(F.sum("n_shingles").alias("weight"))
        # a row for each class of sizes, about eight of them for a tenfold size
        whole = led.groupBy("sized").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("buckets"))
        parts = F.ceil(F.col("weight") / BLOCK_SHINGLES)
        own = F.when(parts > 1, F.concat_ws(".", "sized", F.concat(F.lit("n"), F.col("lead")), F.pmod(F.xxhash64("node"), parts))).otherwise(
            F.concat_ws(".", "sized", F.pmod(F.xxhash64("lead"), "buckets")))
        dealt = materialize(member.join(led, ["sized", "lead"]).join(F.broadcast(whole), "sized").select("node", "sized", own.alias("block")), "minhash-blocks")
        meets = materialize(self._meetings(lists.select("value", "node").join(dealt, "node").select("value", "sized", "block").distinct()), "minhash-meets")
        dealt = dealt.select("node", "block")
        packed = self.packed(lists.select("node").distinct())
        rows = dealt.join(packed, "node")
        one = meets.join(rows.withColumnRenamed("block", "i"), "i").select("i", "j", F.lit(True).alias("left"), "node", "packed")
        two = meets.where("i < j").join(rows.withColumnRenamed("block", "j"), "j").select("i", "j", F.lit(False).alias("left"), "node", "packed")
        size, threshold = self.size, self.threshold

        def overlaps(table):
            unpack = zstandard.ZstdDecompressor()
            order = np.argsort(table.column("node").to_numpy())
            node = table.column("node").to_numpy()[order]
            left = table.column("left").to_numpy(zero_copy_only=False)[order]
            data = table.column("packed")
            sets = [shingles(unpack.decompress(data[int(k)].as_py()), size) for k in order]
            x, y = _linked_sets(sets, left, threshold)
            root = least_in_component(len(sets), x, y)
            at = np.flatnonzero(root != np.arange(len(sets)))
            return pa.table({"a": pa.array(node[root[at]], pa.int64()), "b": pa.array(node[at], pa.int64())})

        out = materialize(one.unionAll(two).groupBy("i", "j").applyInArrow(overlaps, "a bigint, b bigint"), "minhash-links")
        for table in (meets, packed, lead):
            discard(table.sparkSession, table.path)
        return out

    @staticmethod
    def _meetings(held: DataFrame) -> DataFrame:
        """(i, j), i <= j, of blocks that share a list (value, sized, block) and hold like sizes.

        The blocks of a long list are dealt into chunks: a task pairs a chunk with the others.
        """
        held = materialize(held, "minhash-held")
        long = materialize(held.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / LIST_CHUNK).cast("int").alias("chunks")).where("chunks > 1"), "minhash-long")
        rows = held.join(long, "value", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        left = rows.select("value", F.pmod(F.xxhash64("block"), "chunks").cast("int").alias("chunk"), F.col("block").alias("i"), F.col("sized").alias("i_sized"))
        right = rows.select("value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("block").alias("j"), F.col("sized").alias("j_sized"))
        return left.join(right, ["value", "chunk"]).where("i <= j and abs(i_sized - j_sized) <= 1").select("i", "j").distinct()


def _linked_sets(sets: list[np.ndarray], left: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs: a left one with a right one, or any two where all are left ones."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    target = np.ones(len(sets), bool) if left.all() else ~left
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    keep = target[owner]
    order = np.argsort(place[keep], kind="stable")
    posting, ends = owner[keep][order], np.cumsum(np.bincount(place[keep], minlength=len(values)))
    begins = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(n)])
    x, y = [], []
    for q in np.flatnonzero(left):
        own = place[first[q]:first[q + 1]]
        lengths = ends[own] - begins[own]
        if not lengths.sum():
            continue
        spots = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[spots], minlength=len(sets))
        hit = np.flatnonzero((threshold[1] * both >= threshold[0] * (n[q] + n - both)) & (both > 0))
        hit = hit[hit != q]
        x.append(np.full(len(hit), q))
        y.append(hit)
    empty = np.zeros(0, np.int64)
    return np.concatenate([*x, empty]).astype(np.int64), np.concatenate([*y, empty]).astype(np.int64)


def _pack():
    pack = zstandard.ZstdCompressor(level=1)

    def run(node, text):
        yield node, pack.compress(text)

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: tuple[int, int], k: int) -> tuple[DataFrame, DataFrame]:
    """The sketches' table, and (signature, root, component_id, rep) of each class: rep is the first (id, text) of its component."""
    shared = least_shared(k, threshold)
    rows = materialize(sketches(docs, id_col, text_col, k, size), "minhash-sketches")
    classes = rows.where("n_shingles > 0").groupBy("signature").agg(
        F.min(F.struct("key", "text_hash")).alias("rep"), F.min("key").alias("first_id"), F.min(F.struct(F.col("key").isNull(), "key", "text_hash")).alias("first_row"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    lists = materialize(_lists(classes, k, threshold, shared), "minhash-lists")
    verifier = _Verifier(docs, classes, id_col, text_col, k, size, threshold, shared)
    roots = _components(lists, verifier)
    known = classes.select("signature", "node", "first_id", "first_row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("first_row"))
    return rows, known.select("signature", "root").join(component, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, k: int = K) -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean), a row for each row of docs.

    Documents are linked when threshold[1] * |intersection| >= threshold[0] * |union| of their
    shingle sets. component_id is the smallest id reachable over links, kept whether it is the
    row's own. Null and empty texts and texts without words have no shingles and link with
    nothing. Equal sets are one class, so copies cost nothing more. Null ids are larger than all
    others; components of null ids alone have a null component_id and are kept. Rows that repeat
    an id are documents like others; an empty table gives an empty one. Texts are taken whole: a
    task holds one text and its shingles at a time. Other columns are not read.
    """
    rows, known = _grouped(docs, id_col, text_col, size, threshold, k)
    out = rows.where("n_shingles > 0").select("key", "n_shingles", "signature").join(known, "signature").select("key", "n_shingles", "component_id")
    out = out.unionAll(rows.where("n_shingles = 0").select("key", "n_shingles", "key"))
    return out.select(F.col("key").alias(id_col), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, k: int = K) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: that of the smallest id, nulls last.

    Rows are told apart by id and text, so rows that share an id are dropped or kept each on its
    own account; of rows that share both, one stays. Rows without shingles link with nothing and
    all stay. Columns are those of docs, none is replaced.
    """
    rows, known = _grouped(docs, id_col, text_col, size, threshold, k)
    own = rows.where("n_shingles > 0").select("key", "text_hash", "signature").join(known.select("signature", "first_row"), "signature")
    first = F.col("key").eqNullSafe(F.col("first_row.key")) & (F.col("text_hash") == F.col("first_row.text_hash"))
    marked = own.groupBy("key", "text_hash").agg(F.bool_or(first).alias("first"), F.count(F.lit(1)).alias("n"))
    # what goes, and the few first rows that have copies of id and text
    marked = materialize(marked.where("not first or n > 1").select(F.col("key").alias("d_key"), F.col("text_hash").alias("d_hash"), F.col("first").alias("d_first")), "minhash-marked")
    few = marked.count() <= BROADCAST_NAMES
    mark, name = column_name(docs, "d_first"), column_name(docs, "d_hash")
    named = docs.withColumn(name, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    marked = marked.withColumnsRenamed({"d_key": column_name(named, "d_key"), "d_hash": column_name(named, "m_hash"), "d_first": mark})
    key, hash_, _ = marked.columns
    joined = named.join(F.broadcast(marked) if few else marked, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(name) == F.col(hash_)), "left")
    single = joined.where(F.col(mark).isNull()).select(*docs.columns)
    if marked.where(F.col(mark)).isEmpty():
        return single
    again = joined.where(F.col(mark)).select(F.col(id_col).alias(key), F.col(name), F.struct(*docs.columns).alias(mark))
    return single.unionByName(again.groupBy(key, name).agg(F.any_value(mark).alias(mark)).select(f"{mark}.*"))


def _components(lists: DataFrame, verifier: _Verifier) -> DataFrame:
    """(node, root) of the classes with links."""
    spark = lists.sparkSession
    tested = spark.createDataFrame([], "a bigint, b bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    open_ = lists.withColumn("label", F.col("node"))
    for turn in range(LEADER_ROUNDS + 1):
        # lists that still span several components; in the first round the least node leads, then one drawn by hash
        rank = F.col("node") if turn == 0 else F.xxhash64("node", F.col("value") % 4, F.lit(turn))
        ends = open_.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("node", "label"), rank).alias("lead")).where("low < high")
        ends = materialize(ends, "minhash-ends")
        if turn < LEADER_ROUNDS:
            lead = ends.select("value", F.col("lead.node").alias("lead"), F.col("lead.label").alias("lead_label"))
            pairs = open_.join(lead, "value").where("label <> lead_label").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
            pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
            tested = tested.unionAll(pairs)
            found = verifier.linked(pairs)
        else:
            found = verifier.spanning(materialize(open_.join(ends.select("value"), "value", "left_semi").select("value", "node"), "minhash-rest"))
        if not found.isEmpty():
            # components of what is new, over the components known so far
            known = found.select(F.col("a").alias("x"), F.col("b").alias("y"))
            for end in ("x", "y"):
                known = known.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end))
            merged = connected_components(known.select(F.col("x").alias("a"), F.col("y").alias("b")), "minhash-components").select("node", F.col("root").alias("to"))
            moved = roots.join(merged.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            fresh = merged.join(roots, "node", "left_anti").select("node", F.col("to").alias("root"))
            roots = materialize(moved.unionAll(fresh), "minhash-roots")
        if turn == LEADER_ROUNDS or ends.isEmpty():
            break
        open_ = materialize(lists.join(ends.select("value"), "value", "left_semi").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "minhash-open")
    return roots
