"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, all of them encoded. A passage's features are the shares of its
byte classes and of pairs of neighbouring classes, and how often its words repeat. A gated attention layer, learned from labels
of documents alone, weighs the passages; the weighted mean representation is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowframe.llm.common import arrow_map, bound_batches, column_name, extended, return_freed_memory

#: Bytes of a passage; the last of a document may be shorter.
PASSAGE_BYTES = 512
#: Labelled documents a model is fitted on at most: those with the smallest hashes of their ids.
TRAIN_DOCS = 4000
HIDDEN, GATE = 16, 8
CLASSES = 14


def _classes() -> np.ndarray:
    """The class of each byte: kinds of letters, digits, blanks, and groups of punctuation."""
    out = np.full(256, 13, np.uint8)
    for n, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"'\"`", b"()[]{}<>", b"#$%&*@^~", b"|\\/_+=-")):
        out[list(chars)] = n
    out[0x80:0xC0] = 11
    out[0xC0:] = 12
    return out


CLASS_OF = _classes()
FEATURES = CLASSES * (CLASSES + 1) + 3


def passages(text: bytes) -> np.ndarray:
    """A row of features for each passage of the text; an empty text is one empty passage."""
    data = CLASS_OF[np.frombuffer(text, np.uint8)].astype(np.int64)
    n = max(1, -(-len(data) // PASSAGE_BYTES))
    own = np.arange(len(data)) // PASSAGE_BYTES
    single = np.bincount(own * CLASSES + data, minlength=n * CLASSES).reshape(n, CLASSES)
    inside = own[1:] == own[:-1]
    pair = (own[1:] * CLASSES + data[:-1]) * CLASSES + data[1:]
    double = np.bincount(pair[inside], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    size = np.maximum(1, single.sum(1, keepdims=True))
    repeats = np.array([_repeats(text[k * PASSAGE_BYTES:(k + 1) * PASSAGE_BYTES]) for k in range(n)])
    # roots of the shares: rare classes weigh more
    return np.concatenate([np.sqrt(single / size), np.sqrt(double / size), np.log1p(size) / np.log1p(PASSAGE_BYTES), repeats], 1).astype(np.float32)


def _repeats(passage: bytes) -> tuple[float, float]:
    """The shares of words that the passage has had before, and of those that equal the word before them."""
    words = passage.split()
    n = max(1, len(words))
    return 1 - len(set(words)) / n if words else 0.0, sum(map(eq, words, words[1:])) / n


@dataclass
class AttentionModel:
    """h = tanh(x W + b); a ~ exp(w . (tanh(h V) * sigmoid(h U))); logit = (sum of a h) . c + d."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return x, h, t, s, (t * s) @ p["w"]

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents; owner[i] is the document of passage i, in ascending order."""
        _, h, _, _, e = self.encode(x)
        first = np.searchsorted(owner, np.arange(n))
        a = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first)
        return 1 / (1 + np.exp(-(z @ self.weights["c"] + self.weights["d"])))


def fit(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 60, batch: int = 64, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the mean log loss, by hand-written gradients, in a fixed order of batches; ``rounds`` over all bags."""
    rng = np.random.default_rng(seed)
    # bags may be of half floats, and large together: no copy of all of them is made
    n = sum(map(len, bags))
    mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    scale = (sum(((b - mean) ** 2).sum(0) for b in bags) / n) ** 0.5 + 0.02
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    p = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE ** -0.5, GATE), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.zeros(())}
    model = AttentionModel(mean, scale, p)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float32)
            owner = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            start = np.searchsorted(owner, np.arange(len(pick)))
            x, h, t, s, e = model.encode(x)
            a = np.exp(e - np.maximum.reduceat(e, start)[owner])
            a /= np.add.reduceat(a, start)[owner]
            z = np.add.reduceat(a[:, None] * h, start)
            y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
            dl = (y - labels[pick]) / len(pick)
            dz = dl[:, None] * p["c"]
            da = (h * dz[owner]).sum(1)
            de = a * (da - np.add.reduceat(a * da, start)[owner])
            dg = de[:, None] * p["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            dh = a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T
            du = dh * (1 - h * h)
            grad = {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum()}
            step += 1
            for k in p:
                g = grad[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            model.weights = p
    return model


def held_out(id_col) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> AttentionModel | float:
    """A model from labelled documents that are not held out; a constant where they show one label only.

    The constant is the share of label 1, 0.5 without labelled documents. Null ids, texts and
    labels teach nothing; an id labelled twice counts once, with its smaller label. The features of
    all passages of at most ``train_docs`` documents come to the driver, 426 bytes a passage.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).cast("int").alias("label"))
    own = own.where(~held_out(F.col("key"))).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(train_docs)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(own), "key").select("key", "text", "label")  # at most train_docs rows

    def make():
        def run(key, text, label):
            x = passages(text)
            yield str(key), zlib.crc32(text), label, x.astype(np.float16).tobytes()

        return run

    found = arrow_map(rows, make, "key string, text_crc bigint, label int, features binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["key"], r["text_crc"]))
    y = np.array([r["label"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(r["features"], np.float16).reshape(-1, FEATURES) for r in found], y)


def score_quality(docs: DataFrame, model: AttentionModel | float, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs with score (double, 0 to 1) and predicted (1 where the score reaches the threshold).

    Every passage of a whole text counts. Null and empty texts are one empty passage. No other
    column is an input. Rows that repeat an id or a text are scored alike; an empty table gives an
    empty one; a score equal to the threshold counts as reaching it. Long texts are scored alone, a
    passage costs about 4 KB. Columns of docs named as the two results are replaced. With a
    constant instead of a model every score is that constant.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = extended(docs, score=T.DoubleType(), predicted=T.IntegerType())
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        return_freed_memory()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
                score = np.empty(len(texts))
                done = 0
                while done < len(texts):  # documents together up to a few MB; a long one alone
                    end, size = done, 0
                    while end < len(texts) and (end == done or size + len(texts[end]) < 1 << 20):
                        size += len(texts[end])
                        end += 1
                    if isinstance(model, float):
                        score[done:end] = model
                    else:
                        bags = [passages(t) for t in texts[done:end]]
                        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
                        score[done:end] = model.score(np.concatenate(bags), owner, len(bags))
                    done = end
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Learns from labels and scores docs: adds held_out, score and predicted."""
    model = learn(docs, labels, id_col, text_col, label_col)
    flag = column_name(docs.drop("held_out"), "held_out")
    return score_quality(docs.drop("held_out"), model, text_col, threshold).withColumn(flag, F.coalesce(held_out(F.col(id_col)), F.lit(False)))
