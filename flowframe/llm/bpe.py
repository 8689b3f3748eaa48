"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised alone, in parallel for long
texts, and its pre-tokens are encoded there; neighbours are stitched at the first boundary both of
them have in the overlap (from there on the pattern, which never looks back, must cut alike). Only
pre-tokens that no chunk holds are encoded after stitching. Decoding concatenates the raw bytes of the
ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from struct import pack

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import arrow_map, extended

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
#: How far past a match's start the pattern may have to look before the match is certain.
LOOK_AHEAD = 3
#: Pre-tokens a worker remembers; a full memory is emptied, so it stays bounded.
CACHE_TOKENS = 60_000
_ENGINES: dict = {}


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        ids = self.encoding.encode_ordinary(piece)
        ids = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Engine:
    """The vocabulary of one rank file, loaded once a process."""

    def __init__(self, ranks_path: str | None, pattern: str | None):
        if ranks_path is None or pattern is None:
            import public_tokenizers

            ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
            pattern = pattern or public_tokenizers.PATTERN
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        # a pre-token is not taken apart again: the library's own pattern takes all it is given
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.encoding)
        self.tokens = {rank: token for token, rank in ranks.items()}

    @classmethod
    def get(cls, ranks_path: str | None, pattern: str | None) -> Engine:
        key = (ranks_path, pattern)
        if key not in _ENGINES:
            _ENGINES[key] = cls(ranks_path, pattern)
        return _ENGINES[key]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def cut(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, str]]:
    """(start, piece) of overlapping chunks that cover the text; each reaches ``overlap`` into the next."""
    return [(at, text[at:at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def boundaries(pattern: regex.Pattern, start: int, piece: str, last: bool) -> list[int]:
    """Where the chunk's pre-tokens end, as offsets in the whole text, as far as they are certain."""
    sure = len(piece) if last else len(piece) - LOOK_AHEAD
    out = []
    for m in pattern.finditer(piece):
        if m.end() > sure:
            break
        out.append(start + m.end())
    return out


def stitch(pattern: regex.Pattern, text: str, starts: list[int], ends: list[list[int]]) -> list[tuple[int, int, int]]:
    """The whole text's pre-tokens from those of its chunks, as runs (chunk, first, last) of a chunk's pre-tokens.

    Where two chunks share no certain boundary in their overlap (a word longer than it), the
    pattern runs on from the last certain boundary until it meets one of the later chunk; such a
    pre-token is a run (-1, begin, end) of the text's places.
    """
    out = [(0, 0, len(ends[0]))]
    at, place = 0, ends[0][-1] if ends[0] else 0  # the chunk that leads, and how far its pre-tokens reach
    for k in range(1, len(starts)):
        start, own = starts[k], ends[k]
        known = set(own) | {start}
        if out and out[-1][0] == at and at >= 0:
            chunk, first, last = out.pop()
            reached = ends[chunk]
            meet = next((i for i in range(bisect_left(reached, start, first, last), last) if reached[i] in known), None)
            out.append((chunk, first, last if meet is None else meet + 1))
            met = meet is not None
            place = reached[meet] if met else place
        else:
            met = place in known and place >= start
        if not met:
            for m in pattern.finditer(text, place):
                out.append((-1, place, m.end()))
                place = m.end()
                if place in known and place >= start:
                    met = True
                    break
        if met:
            out.append((k, bisect_left(own, place + 1), len(own)))
            at, place = k, own[-1] if own and own[-1] > place else place
        else:
            at = -1
    return [run for run in out if run[1] < run[2]]


def stitched_ends(runs: list[tuple[int, int, int]], ends: list[list[int]]) -> list[int]:
    """Where the pre-tokens of the runs end."""
    return [e for chunk, first, last in runs for e in ([last] if chunk < 0 else ends[chunk][first:last])]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
           pattern: str | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, decoded: bool = False) -> DataFrame:
    """(id, n_tokens long, ids binary): a text's ids as little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded in the same pass, as decode() does, into a binary column
    of that name. One row for each input row. Null and empty texts have no ids. Null and repeated ids stay as
    they are; other columns are not read, whatever their names. Texts up to ``chunk`` code points
    are encoded where they lie, without a shuffle. Chunks of longer ones are dealt over all tasks
    to be pre-tokenised and encoded and meet again in their document's group, which is as large as
    that one row and its ids. An empty table gives an empty one. ``ranks_path`` must be readable on every executor (None: the installed public file).
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded

    def whole():
        engine = Engine.get(ranks_path, pattern)

        def run(key, text):
            ids = engine.encode_pieces(engine.pattern.findall(text))
            yield (key, len(ids) // 4, ids, engine.decode(ids)) if decoded else (key, len(ids) // 4, ids)

        return run

    def chunks():
        def run(key, name, text):
            parts = cut(text, chunk, overlap)
            for n, (start, piece) in enumerate(parts):
                yield key, name, n, len(parts), start, piece

        return run

    def pretokens():
        engine = Engine.get(ranks_path, pattern)

        def run(key, name, n, of, start, piece):
            ends = boundaries(engine.pattern, start, piece, n == of - 1)
            parts = [engine.pieces[piece[a - start:b - start]] for a, b in zip([start, *ends], ends)]
            upto = np.cumsum([0, *map(len, parts)]).tolist()
            yield key, name, n, start, piece[:chunk] if n < of - 1 else piece, ends, b"".join(parts), upto

        return run

    def join(table):
        import pyarrow as pa

        engine = Engine.get(ranks_path, pattern)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "start", "piece", "ends", "ids", "upto", "id"))), key=lambda r: r[0])
        copies = sum(r[0] == 0 for r in rows)
        once = rows[::copies]
        text = "".join(r[2] for r in once)
        runs = stitch(engine.pattern, text, [r[1] for r in once], [r[3] for r in once])
        ids = b"".join(engine.encode_pieces([text[first:last]]) if k < 0 else once[k][4][once[k][5][first]:once[k][5][last]] for k, first, last in runs)
        columns = {"id": pa.array([rows[0][6]] * copies, table.schema.field("id").type), "n_tokens": pa.array([len(ids) // 4] * copies, pa.int64()), "ids": pa.array([ids] * copies, pa.binary())}
        if decoded:
            columns["decoded"] = pa.array([engine.decode(ids)] * copies, pa.binary())
        return pa.table(columns)

    short = arrow_map(base.where(F.length("text") <= chunk), whole, out)
    # a name by content: rows that are alike share a group and are counted there
    long = base.where(F.length("text") > chunk).select("id", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.sha2("text", 256)).alias("name"), "text")
    dealt = arrow_map(long, chunks, f"id {kind}, name string, n int, of int, start bigint, piece string").repartition("name", "n")
    ends = arrow_map(dealt, pretokens, f"id {kind}, name string, n int, start bigint, piece string, ends array<bigint>, ids binary, upto array<bigint>")
    both = short.unionByName(ends.groupBy("name").applyInArrow(join, out))
    return both.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids in a row, concatenated. Null ids: null.

    An id outside the vocabulary or a length that isn't a multiple of four raises an error. The
    result's other columns are those of the input; an input column named ``decoded`` is replaced.
    """
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    at = kept.index(ids_col)
    schema = extended(encoded.select(*kept), decoded=T.BinaryType())

    def make():
        engine = Engine.get(ranks_path, pattern)

        def run(*row):
            yield (*row, None if row[at] is None else engine.decode(row[at]))

        return run

    return arrow_map(encoded.select(*kept), make, schema)
