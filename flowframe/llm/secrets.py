"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

All in DataFrame functions. Two first-order Markov models over characters are trained from
labelled samples: random strings and ordinary identifiers. A run of token characters is reported
when the mean log-likelihood ratio of its character pairs favours the random model.

Work is in proportion to a text's length, whatever its tokens and matches: tokens are taken apart
once, running totals are made in nested chunks, and spans are compared in one ordered pass.
"""

from __future__ import annotations

import json
from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.llm.common import column_name

#: The patterns of the three kinds, and the lengths that a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_CHARS = 8
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_CHARS = 16
HEX = "[0-9a-f]"
HEX_CHARS = 32
KINDS = ("assign", "access", "hex", "random")

#: Token characters; candidates of the Markov models are runs of so many of them, with a digit and a letter.
TOKEN = "[A-Za-z0-9+/_=-]"
TOKEN_CHARS = 20
#: Mean log-likelihood ratio (nats a character pair) from which a token counts as random.
THRESHOLD = 0.35
#: Random strings made for training.
RANDOM_SAMPLES = 3000
#: The share of corpus words in the ordinary model's counts; the rest are the identifiers'.
CORPUS_SHARE = 0.5
#: Words of letters alone or of digits alone, free of other token characters: by this rule they are labelled ordinary.
WORD = "(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]{4,}|[0-9]{4,})(?![A-Za-z0-9+/_=-])"
#: Elements of a chunk of running totals, and how deep chunks are nested.
CHUNK, DEPTH = 64, 3
SIZE = 128

#: Ordinary parts of identifiers; every pair of them is joined in several styles.
IDENTIFIER_PARTS = (
    "account action address array base batch block buffer cache call chunk class client code column config content "
    "context count create current data date default delete device document domain error event field file filter first "
    "format function get group handler header host id image index info init input item key last length level limit "
    "line link list load local log map message method model module name network node number object option order "
    "output package page parent path point port process query queue read record request response result role root "
    "row schema server service session set size source stack start state status stream string table target task "
    "temp test text time token total type update url user value version view width write").split()


def samples(spark: SparkSession) -> DataFrame:
    """Labelled samples (text string, label int): 1 for random strings, 0 for ordinary identifiers.

    Random strings are digests of running numbers, spelt in hexadecimal, Base64 and Base62. The
    ordinary ones are pairs of common identifier parts in several styles.
    """
    n = F.col("id")
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), n.cast("string")), 256))
    b64 = F.base64(digest)
    random = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(
        F.lower(F.hex(digest)), F.substring(b64, 1, 40), F.regexp_replace(b64, "[+/=]", ""), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))).alias("text"), F.lit(1).alias("label"))
    parts = F.array(*map(F.lit, IDENTIFIER_PARTS))
    size = len(IDENTIFIER_PARTS)
    a, b = parts[(n % size).cast("int")], parts[F.floor(n / size).cast("int")]
    names = spark.range(size * size).select(F.explode(F.array(
        F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, F.initcap(b)), F.concat_ws("_", F.upper(a), F.upper(b)),
        F.concat(a, F.lit("/"), b, F.lit("_"), (n % 100).cast("string")), F.concat(a, (F.lit(1990) + n % 40).cast("string"), F.lit("-"), (n % 12).cast("string")))).alias("text"), F.lit(0).alias("label"))
    return random.unionAll(names)


def corpus_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text string, n long): the ordinary words of all documents by the rule WORD, and how often each occurs."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).alias("text"))
    return words.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _characters(text: Column) -> Column:
    """The codes of a text's characters, which is walked through once."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def _pair_counts(texts: DataFrame, n: Column) -> DataFrame:
    """(x, y, n): how often character y follows x, over all texts; at most 128 * 128 rows."""
    codes = texts.where("length(text) > 1").select(n.alias("n"), _characters(F.col("text")).alias("codes"))
    pairs = codes.select("n", F.explode(F.arrays_zip(F.col("codes").alias("x"), F.slice("codes", 2, F.size("codes") - 1).alias("y"))).alias("p")).select("n", "p.x", "p.y")
    return pairs.where("x < 128 and y < 128").groupBy("x", "y").agg(F.sum("n").cast("double").alias("n"))


def train(labelled: DataFrame, words: DataFrame | None = None, weight: float = 0.5, corpus_share: float = CORPUS_SHARE) -> list[float]:
    """Log-likelihood ratios of character pairs, at ``128 * first + second``, from (text, label).

    ``words`` (text, n) are counted among the ordinary samples; their counts are scaled to make up
    ``corpus_share`` of the ordinary ones, however large the corpus is. Each model's transitions are
    counted with ``weight`` added to each; characters outside ASCII are left out. The table has
    128 * 128 entries whatever the samples. Without samples it is 0.
    """
    one = F.lit(1)
    parts = {"r": _pair_counts(labelled.where("label = 1"), one), "o": _pair_counts(labelled.where("label = 0"), one)}
    if words is not None:
        parts["w"] = _pair_counts(words, F.col("n"))
    tagged = [part.select(F.lit(name).alias("of"), "x", "y", "n") for name, part in parts.items()]
    cells = reduce(DataFrame.unionAll, tagged).collect()  # at most 128 * 128 rows of each of three kinds
    counts = {name: {} for name in "row"}
    for c in cells:
        counts[c.of][c.x, c.y] = c.n
    ordinary, corpus = sum(counts["o"].values()), sum(counts["w"].values())
    scale = 1.0 if not ordinary else ordinary * corpus_share / (1 - corpus_share) / corpus if corpus else 0.0
    both = {k: counts["o"].get(k, 0.0) + scale * counts["w"].get(k, 0.0) for k in counts["o"].keys() | counts["w"].keys()}
    sums = {}
    for which, own in (("r", counts["r"]), ("o", both)):
        for (x, _), n in sorted(own.items()):
            sums[which, x] = sums.get((which, x), 0.0) + n
    alphabet, out = 66, [0.0] * (SIZE * SIZE)
    for x in {x for _, x in sums}:
        rs, os = (log(sums.get((which, x), 0.0) + weight * alphabet) for which in "ro")
        for y in range(SIZE):
            out[SIZE * x + y] = (log(counts["r"].get((x, y), 0.0) + weight) - rs) - (log(both.get((x, y), 0.0) + weight) - os)
    return out


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge, depth: int = DEPTH) -> Column:
    """Running totals of an array of integers by ``merge`` (0 changes nothing), an element each.

    Appending one by one takes the square of a chunk's length; chunks of CHUNK elements in chunks
    keep that small for arrays of up to CHUNK ** (DEPTH + 1) elements, and bearable beyond.
    """
    none = F.expr("cast(array() as array<int>)")

    def scan(a):
        step = lambda acc, x: F.struct(merge(acc["t"], x).alias("t"), F.concat(acc["out"], F.array(merge(acc["t"], x))).alias("out"))
        return F.aggregate(a, F.struct(F.lit(0).alias("t"), none.alias("out")), step)["out"]

    if depth == 0:
        return scan(values)

    def in_chunks(a):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda i: scan(F.slice(a, i * CHUNK + 1, F.lit(CHUNK))))
        return _let(chunks, lambda own: _let(running(F.transform(own, lambda c: F.element_at(c, -1)), merge, depth - 1), lambda ends: F.flatten(
            F.transform(own, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: merge(F.get(ends, i - 1), x)))))))

    return _let(values, lambda a: F.when(F.size(a) <= CHUNK, scan(a)).otherwise(in_chunks(a)))


def find_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, token_chars: int = TOKEN_CHARS) -> DataFrame:
    """Adds ``secrets`` to the rows of docs: array<struct<start int, kind string, end int, value string>>.

    Spans are in code points, end exclusive, ordered by start, then by kind in the order assign,
    access, hex, random. The first three kinds are the leftmost non-overlapping matches of their
    patterns, less those too short. ``random`` spans are added by the Markov models; they never
    overlap the others. Null and empty texts have none; repeated rows are rows like others; an empty
    table gives an empty one. Texts, tokens and matches may be of any length and number: work is in
    proportion to the text. A column named ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    text, base_at, token_at, found = (column_name(docs, c) for c in ("secret_text", "secret_base", "secret_tokens", "secret_found"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    t = F.col(text)
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))

    def pieces(pattern, maybe):
        """The gaps and the matches, each worked out once, where a cheap test says there may be any."""
        return F.when(maybe, F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found")))

    def placed(part: str, kind: int) -> Column:
        gaps, hits = F.col(part)["gaps"], F.col(part)["found"]
        sizes = F.zip_with(gaps, hits, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        spans = _let(running(sizes, add), lambda ends: F.transform(hits, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), m.alias("value"))))
        return F.when(F.col(part).isNull(), none).otherwise(spans)

    parts = [column_name(docs, f"secret_part{k}") for k in range(4)]
    tests = (t.rlike("(?i:passw|secret|token|api_?key)"), t.contains("AKIA"), t.rlike(f"{HEX}{{{HEX_CHARS}}}"), t.rlike(f"{TOKEN}{{{token_chars}}}"))
    # greedy runs of the last two kinds are whole runs, so the length can stand in the pattern
    patterns = (ASSIGN, ACCESS, f"{HEX}{{{HEX_CHARS},}}", f"{TOKEN}{{{token_chars},}}")
    for part, pattern, test in zip(parts, patterns, tests):
        rows = rows.withColumn(part, pieces(pattern, test))
    value = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    base = F.concat(F.filter(placed(parts[0], 0), lambda m: F.length(value(m)) >= ASSIGN_VALUE_CHARS),
                    F.filter(placed(parts[1], 1), lambda m: F.length(m["value"]) >= ACCESS_CHARS), placed(parts[2], 2))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")

    def ratio(token: Column) -> Column:
        both = lambda c: F.zip_with(c, F.slice(c, 2, F.size(c) - 1), lambda x, y: F.coalesce(F.get(table, x * SIZE + y), F.lit(0.0)))
        return _let(_characters(token), lambda c: F.aggregate(both(c), F.lit(0.0), lambda acc, x: acc + x) / (F.size(c) - 1))

    tokens = F.filter(placed(parts[3], 3), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    rows = rows.withColumn(base_at, base).withColumn(token_at, tokens)

    def merged(spans: Column, ends: Column) -> Column:
        # in order of start a token can only overlap a base span that ends late before it, or the span right after it
        alone = lambda m, i: (F.coalesce(F.get(ends, i - 1), F.lit(0)) <= m["start"]) & (F.coalesce(F.get(spans, i + 1)["start"], m["end"]) >= m["end"])
        return F.filter(spans, lambda m, i: F.when(m["kind"] < 3, True).when(alone(m, i), ratio(m["value"]) >= threshold).otherwise(False))

    ordered = F.array_sort(F.concat(F.col(base_at), F.col(token_at)))
    late = lambda spans: running(F.transform(spans, lambda m: F.when(m["kind"] < 3, m["end"]).otherwise(0)), F.greatest)
    both = _let(ordered, lambda spans: _let(late(spans), lambda ends: merged(spans, ends)))
    rows = rows.withColumn(found, F.when(F.size(token_at) > 0, both).otherwise(F.array_sort(base_at)))
    kinds = F.array(*map(F.lit, KINDS))
    named = F.transform(F.col(found), lambda m: F.struct(m["start"].alias("start"), F.get(kinds, m["kind"]).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    return rows.select(*docs.columns, named.alias("secrets"))
