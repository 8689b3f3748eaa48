"""Embedding near-duplicates by collision counting on one-dimensional projections.

Every vector is projected on many random directions. On each the values are sorted, and a query
collides with what lies in a window centred on it. Pairs that collide on enough directions are
verified by their cosine in double precision. The count that is enough is calibrated: a pair at
the threshold reaches it but for a probability of ``MISS``; closer pairs reach it more surely.

Collisions are counted for whole blocks at once: a window is the difference of two prefix bit
sets of the sorted order, and bit-sliced counters add one direction's windows to 64 candidates at
a time. No list of pairs is ever kept: links are added up and components merged as they are found,
and only sums and spanning edges leave a block.

Blocks are runs of the order on a direction of unit length; blocks farther apart than linked
vectors can be do not meet. On vectors without structure nearly all of them meet: one direction tells
little there, and the work grows with the square of the vectors.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import arrow_map, connected_components, least_in_component, materialize
from flowframe.operators.ordering import with_index

DIRECTIONS = 48
#: Half a window, in distances of a pair at the threshold.
WINDOW = 1.7
MISS = 1e-9
SEED = 20
#: Classes in a block, at least and at most; in between there are about BLOCKS blocks. A task holds two blocks.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 16, 256, 65_536
#: Candidates whose windows are held at once (13 MB of prefix bit sets).
TILE = 8192
QUERY_ROWS = 256
STEP = 32


def enough(directions: int = DIRECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold fails to reach with probability ``miss`` at most."""
    p = erf(window / sqrt(2))
    below, count = 0.0, 0
    while count < directions:
        below += comb(directions, count) * p ** count * (1 - p) ** (directions - count)
        if below > miss:
            break
        count += 1
    return max(1, count)


def directions(size: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, n))


def units(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision; their components may be as large or small as doubles are."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def strip_direction(size: int) -> np.ndarray:
    """A unit vector: values along it are no farther apart than the vectors are."""
    d = np.random.default_rng(SEED + 1).standard_normal(size)
    return d / np.linalg.norm(d)


class Windows:
    """The sorted projections of a block of unit vectors, as prefix bit sets."""

    def __init__(self, units: np.ndarray, base: np.ndarray):
        self.n, self.base = len(units), base
        self.words = -(-self.n // 64)
        values = units @ base
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, 0).T.copy()
        marks = -(-self.n // STEP)
        self.prefix = np.zeros((base.shape[1], marks + 1, self.words), np.uint64)
        for p in range(base.shape[1]):
            hit = np.zeros((marks, self.words * 64), np.uint8)
            hit[np.arange(self.n) // STEP, order[:, p]] = 1
            bits = np.packbits(hit, axis=1, bitorder="little").view(np.uint64)
            np.bitwise_or.accumulate(bits, axis=0, out=self.prefix[p, 1:])

    def collide(self, units: np.ndarray, half: float, least: int) -> np.ndarray:
        """A boolean row for each query: who collides with it on at least ``least`` directions."""
        values = units @ self.base
        planes = [np.zeros((len(units), self.words), np.uint64) for _ in range(max(1, (least - 1).bit_length()))]
        # the counters start so that they overflow at ``least``
        for k, plane in enumerate(planes):
            if (1 << len(planes)) - least >> k & 1:
                plane[:] = ~np.uint64(0)
        over = np.zeros_like(planes[0])
        for p in range(values.shape[1]):
            low = np.searchsorted(self.sorted[p], values[:, p] - half, "left") // STEP
            high = -(-np.searchsorted(self.sorted[p], values[:, p] + half, "right") // STEP)
            carry = self.prefix[p, high] ^ self.prefix[p, low]
            for plane in planes:
                both = plane & carry
                plane ^= carry
                carry = both
            over |= carry
        return np.unpackbits(over.view(np.uint8), axis=1, bitorder="little")[:, :self.n].view(bool)


def tally(a: np.ndarray, b: np.ndarray, threshold: float, least: int, same: bool, copies_a: np.ndarray, copies_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a's and of b's rows, in copies, and the least index in each row's component (a's rows, then b's).

    Rows are unit vectors; those with a cosine of ``threshold`` and more are linked, and with
    ``same`` a row is not linked with itself. Links are added up and components merged as they are
    found: no list of pairs is kept, however many there are.
    """
    half, n = WINDOW * sqrt(2 - 2 * threshold), len(a)
    of_a, of_b, label = np.zeros(n, np.int64), np.zeros(len(b), np.int64), np.arange(n + len(b))
    base = directions(a.shape[1])
    for from_b in range(0, len(b), TILE):
        tile = b[from_b:from_b + TILE]
        windows = Windows(tile, base)
        for at in range(0, n, QUERY_ROWS):
            part = a[at:at + QUERY_ROWS]
            q, c = np.nonzero(windows.collide(part, half, least))
            if len(q) > 0.02 * len(part) * len(tile):
                cosine = (part @ tile.T)[q, c]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", part[q[k:k + 8192]], tile[c[k:k + 8192]]) for k in range(0, len(q), 8192)] or [np.zeros(0)])
            good = cosine >= threshold
            q, c = q[good] + at, c[good] + from_b
            if same:
                q, c = q[q != c], c[q != c]
            if len(q):
                of_a += np.bincount(q, copies_b[c], n).astype(np.int64)
                of_b += np.bincount(c, copies_a[q], len(b)).astype(np.int64)
                label = least_in_component(n + len(b), q, n + c, label)
    return of_a, of_b, label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, miss: float = MISS) -> DataFrame:
    """(id, n_links long, component_id, kept boolean), a row for each row of vectors.

    Vectors with a cosine of ``threshold`` and more are linked. n_links counts a row's links to
    other rows, component_id is the smallest id reachable over links, kept says whether it is the
    row's own. Equal vectors are gathered in classes first, so copies cost nothing more. Null and
    empty vectors, zero vectors and those with null or non-finite components link with nothing, as
    do vectors of different lengths. A null id is smaller than none: components of null ids alone
    have a null component_id and are kept. Rows that repeat an id are rows like others. An empty
    table gives an empty one. Other columns are not read. A pair at the threshold is missed with
    probability ``miss`` at most.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    # floats take half the room of doubles
    narrow = np.dtype(np.float32 if vectors.schema[vector_col].dataType.elementType == T.FloatType() else np.float64)

    def prepare():
        def run(key, vector):
            x = np.array(vector, np.float64) if vector and None not in vector else np.zeros(1)
            if np.isfinite(x).all() and x.any():
                yield key, x.astype(narrow).tobytes(), float((units(x[None]) @ strip_direction(len(x)))[0])
            else:
                yield key, None, None

        return run

    rows = materialize(arrow_map(vectors.select(id_col, vector_col), prepare, f"key {kind}, raw binary, strip double"), "vectors")
    classes = rows.where("raw is not null").groupBy("raw").agg(F.min("key").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("strip").alias("strip"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = materialize(_links(classes, narrow, threshold, enough(miss=miss)), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    known = classes.select("raw", "node", "first_id", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(component, "root").select("raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("raw is not null").select("key", "raw").join(known, "raw").select("key", "n_links", "component_id")
    out = out.unionAll(rows.where("raw is null").select("key", F.lit(0).cast("bigint"), "key"))
    return out.select(F.col("key").alias(id_col), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, narrow: np.dtype, threshold: float, least: int) -> DataFrame:
    """(node, root, links): in each pair of blocks, a node's links and the least node of its component there.

    Blocks are runs of equal length in the order of the strip's values, ties by node, so equal
    values fill several blocks. Nothing comes to the driver but the number of classes.
    """
    n = classes.count()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    reach = sqrt(2 - 2 * threshold)
    placed = with_index(classes.select("strip", "node"), ["strip", "node"], "place", one_task_rows=0, bucket_rows=size).select("node", F.expr(f"cast(place div {size} as int)").alias("block"))
    dealt = classes.join(placed, "node").select("node", "raw", "copies", "strip", "block")
    # values along a unit vector are no farther apart than vectors, so blocks beyond reach share no link
    ends = dealt.groupBy("block").agg(F.min("strip").alias("low"), F.max("strip").alias("high"))
    ends = materialize(ends, "vector-ends")  # a row a block
    other = ends.select(F.col("block").alias("j"), F.col("low").alias("j_low"), F.col("high").alias("j_high"))
    meets = ends.join(other, (F.col("j") >= F.col("block")) & (F.col("j_low") <= F.col("high") + reach + 1e-9) & (F.col("low") <= F.col("j_high") + reach + 1e-9))
    meets = meets.select(F.col("block").alias("i"), "j")
    both = meets.select(F.col("i").alias("block"), "i", "j").unionAll(meets.where("i < j").select(F.col("j").alias("block"), "i", "j"))
    pairs = dealt.drop("strip").join(both, "block")

    def within(key, table):
        i, j = (k.as_py() for k in key)
        nodes, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        raw = table.column("raw").combine_chunks()
        _, offsets, data = raw.buffers()
        offsets = np.frombuffer(offsets, np.int32)[raw.offset:raw.offset + len(raw) + 1]
        lengths, data = np.diff(offsets), np.frombuffer(data, np.uint8)
        out: dict[str, list] = {"node": [], "root": [], "links": []}
        for length in np.unique(lengths):
            # the order in a group may differ from run to run
            a, b = (at[np.argsort(nodes[at])] for at in (np.flatnonzero((lengths == length) & (block == x)) for x in (i, j)))
            if not len(a) or not len(b):
                continue
            take = lambda at: units(data[offsets[at][:, None] + np.arange(length)].view(narrow))  # noqa: B023, E731
            left = take(a)
            of_a, of_b, label = tally(left, left if i == j else take(b), threshold, least, i == j, copies[a], copies[b])
            if i == j:
                # both sides are the same rows
                label = least_in_component(2 * len(a), np.arange(len(a)), len(a) + np.arange(len(a)), label)[:len(a)]
                rows, links, root = nodes[a], of_a, nodes[a][label]
            else:
                rows, links = np.concatenate([nodes[a], nodes[b]]), np.concatenate([of_a, of_b])
                root = rows[label]
            hit = np.flatnonzero(links)
            out["node"].append(rows[hit])
            out["root"].append(root[hit])
            out["links"].append(links[hit])
        return pa.table({c: pa.array(np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64), pa.int64()) for c, v in out.items()})

    return pairs.groupBy("i", "j").applyInArrow(within, "node bigint, root bigint, links bigint")
