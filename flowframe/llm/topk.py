"""Exact top-k search by integer inner product over an impact-ordered, score-at-a-time index.

Components become integers. Candidates lie in blocks; in a block every dimension's postings are
ordered by value and cut into segments, each with the largest impact it can have. A query works
through segments by descending impact, adding what their postings contribute. A candidate's score so
far and the impacts of the dimensions in which it has not been met yet bound its score; the exact
scores of the best few so far bound the k-th from below. It stops only on proof: when few
candidates can still reach that. Those are scored exactly.

A block's index is built once, in one task, and all queries stream past it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowframe.llm.common import streamed

#: Candidates in a block (its index takes about 1.5 KB a candidate at 64 dimensions).
BLOCK_ROWS = 8192
SEGMENTS = 4
#: Proof is looked for after this share of a query's segments each time.
STRIDE = 1 / 10
#: Candidates scored exactly whenever proof is looked for, to know the k-th score from below.
SEEDS = 16
#: Rescoring begins once at most this share of a block can still be members (all of them are rescored).
MOST_RESCORED = 1 / 8


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Block:
    """The index of one block of candidates with vectors of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, segments: int = SEGMENTS):
        self.ids, self.rows = ids, rows
        n = len(ids)
        # impacts are kept as distances from a dimension's least value: they are never negative
        self.low, self.high = rows.min(0), rows.max(0)
        self.reach = int((self.high - self.low).max(initial=0))
        # a dimension's postings lie together: candidates and values, largest value first
        self.order = np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T)
        values = np.take_along_axis(np.ascontiguousarray(rows.T), self.order, 1)
        # distances from the least value (for positive query components) and from the largest (for others)
        narrow = np.int32 if self.reach < 1 << 31 else np.int64
        self.up, self.down = (values - self.low[:, None]).astype(narrow), (values - self.high[:, None]).astype(narrow)
        self.cuts = np.linspace(0, n, min(segments, n) + 1).astype(int)
        #: Segments taken and offered, over all queries.
        self.taken = self.offered = 0
        self._unseen = None

    def impacts(self, query: np.ndarray) -> np.ndarray:
        """The largest contribution of each dimension's segments, from the dimension's least, and 0 behind the last."""
        n, cuts = len(self.rows), self.cuts
        best = np.where(query[:, None] > 0, self.up[:, cuts[:-1]], self.down[:, n - 1 - cuts[:-1]]) * query[:, None]
        return np.concatenate([best, np.zeros((len(query), 1), best.dtype)], 1)

    def top(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first, ties to the smaller id; ``own`` is left out."""
        rows, parts = self.rows, len(self.cuts) - 1
        alive = np.ones(len(rows), bool) if own is None else self.ids != own
        possible = np.flatnonzero(alive)
        used = np.flatnonzero(query)
        impact = self.impacts(query)
        # by impact; a dimension's own segments come in their order, as their impacts fall
        turns = used.repeat(parts)[(by := np.argsort(-impact[used, :parts].ravel(), kind="stable"))]
        turn_parts = np.tile(np.arange(parts), len(used))[by]
        # 32 bits where no sum of impacts can pass them; bounds are whole numbers that floats hold exactly
        most = int(np.abs(query).sum()) * self.reach
        kind, exactly = np.int32 if most < 1 << 31 else np.int64, np.float32 if most < 1 << 24 else np.float64
        weight, score = query.astype(kind), np.zeros(len(rows), kind)
        unseen, bound = self._ones(exactly), impact[:, 0].astype(exactly)
        bound[query == 0] = 0
        least = int((query * np.where(query > 0, self.low, self.high)).sum())
        stride, floor = max(1, int(len(turns) * STRIDE)), -1 << 63
        self.offered += len(turns)
        few = max(k, SEEDS, int(len(rows) * MOST_RESCORED))
        taken = 0
        while taken < len(turns) and len(possible) > few:
            for d, part in zip(turns[taken:taken + stride].tolist(), turn_parts[taken:taken + stride].tolist()):
                first, last = self._range(query[d], part)
                at = self.order[d, first:last]
                score[at] += weight[d] * (self.up if query[d] > 0 else self.down)[d, first:last]
                unseen[d, at] = 0
                bound[d] = impact[d, part + 1]
            taken = min(len(turns), taken + stride)
            if taken * 3 < len(turns):
                continue
            # what is known of the k-th score: that of the k-th best of the best so far
            known = score[possible]
            seeds = possible[np.argpartition(known, len(known) - SEEDS)[len(known) - SEEDS:]] if len(known) > SEEDS else possible
            if len(seeds) >= k:
                floor = max(floor, int(np.sort(rows[seeds] @ query)[-k]))
                possible = possible[least + known + (bound @ unseen)[possible] >= floor]
        self.taken += taken
        exact = rows[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return [(int(exact[i]), int(self.ids[possible[i]])) for i in best]

    def _ones(self, kind: type) -> np.ndarray:
        """A row of ones for each dimension; the block's own, filled anew for each query."""
        if self._unseen is None or self._unseen.dtype != kind:
            self._unseen = np.empty((self.rows.shape[1], len(self.rows)), kind)
        self._unseen.fill(1)
        return self._unseen

    def _range(self, weight: int, part: int) -> tuple[int, int]:
        """Where a segment lies: from the front for positive components, from the back for negative ones."""
        first, last, n = self.cuts[part], self.cuts[part + 1], len(self.rows)
        return (first, last) if weight > 0 else (n - last, n - first)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best candidates.

    Scores are inner products of floor(scale * x) as integers; candidates are all rows of vectors
    but those with the query's own id; ties go to the smaller id; with fewer candidates all are
    returned. Null ids and vectors, and those with null or non-finite components, take no part. A
    query meets vectors of its own length. Rows that repeat an id are candidates of their own, also
    where they repeat its vector; queries that repeat an id are ranked together, by id. An empty
    table gives an empty one. Other columns are not read. A task holds one block of candidates at a
    time; queries pass by in batches, however many there are.
    """
    own = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows, asked = own(vectors), own(queries)
    blocks = max(1, -(-rows.count() // block_rows))
    candidates = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    asking = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, flat components) in the order of the rows."""
        v = batch.column(batch.schema.get_field_index("v"))
        return batch.column(batch.schema.get_field_index("id")).to_numpy(), np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()

    def search(pieces):
        part, held, index = None, [], None
        for kind, batch in pieces:
            here = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            if here != part:
                part, held, index = here, [], None
            if kind == 0:
                held.append(matrix(batch))
                continue
            if index is None:
                index = {}
                if held:
                    ids, sizes, flat = (np.concatenate(x) for x in zip(*held))
                    starts, held = np.cumsum(sizes) - sizes, []
                    for size in np.unique(sizes):
                        at = np.flatnonzero(sizes == size)
                        index[int(size)] = Block(ids[at], flat[starts[at][:, None] + np.arange(size)])
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            ids, sizes, flat = matrix(batch)
            for key, size, start in zip(ids.tolist(), sizes.tolist(), (np.cumsum(sizes) - sizes).tolist()):
                if size in index:
                    for score, vec in index[size].top(flat[start:start + size], key, k):
                        for name, value in (("query_id", key), ("vec_id", vec), ("score", score)):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in out.items()})

    found = streamed(candidates, asking, blocks, search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries_of(vectors: DataFrame, id_col: str = "vec_id", every: int = 50) -> DataFrame:
    """The rows whose id is divisible by ``every``."""
    return vectors.where(F.col(id_col) % every == 0)
