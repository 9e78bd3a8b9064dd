"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed features: its words, its word pairs (a pair of
equal words is one feature of its own, so repetition is seen for words never
met in training) and its character n-grams.  Each feature bucket has a learned
vector; a document is the average of its vectors, and a softmax layer gives
the class.  Training is stochastic gradient descent in numpy over a bounded
sample of labelled documents.  For scoring, every bucket's vector is folded
with the output layer to one number (the average and the logit difference of
the softmax are linear), a fixed-size table that is broadcast; whole texts are
scored by numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.llm import textkit

BITS = 18                       # feature buckets: 2 ** BITS
DIM = 8
CHAR_NS = (3, 4)                # bytes of the UTF-8 text, white space included
TRAIN_ROWS = 2000               # most labelled documents used for fitting
EPOCHS = 5
RATE = 0.5
SEED = 7

_GOLD = np.uint32(2654435761)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, word hashes, word pointer) of the texts."""
    raw, off = textkit.text_bytes(texts)
    starts, ends, ptr = textkit.word_spans(raw, off)
    return raw, off, textkit.hash_spans(raw, starts, ends), ptr


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each position."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    x = raw[:m].astype(np.uint32)
    for i in range(1, n):
        x |= raw[i:i + m].astype(np.uint32) << np.uint32(8 * i)
    return ((x ^ np.uint32(n * 0x1F1F1F1F)) * _GOLD) >> np.uint32(32 - BITS)


def feature_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first, end) for each kind of feature: row r of ``texts`` has
    the buckets first[r]:end[r]."""
    raw, off, h, ptr = _words(texts)
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.uint32), ptr[:-1], ptr[1:]
    if len(h) > 1:
        same = h[1:] == h[:-1]
        pair = textkit.rolling(h, 2)
        pair[same] = textkit.mix64(np.full(1, 99, np.uint64))[0]
        yield (pair >> shift).astype(np.uint32), ptr[:-1], np.maximum(ptr[1:] - 1, ptr[:-1])
    for n in CHAR_NS:
        yield _grams(raw, n), off[:-1], np.maximum(off[1:] - n + 1, off[:-1])


def row_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row: (distinct buckets, how often the row has each)."""
    runs = list(feature_runs(texts))
    out = []
    for r in range(len(texts)):
        own = np.concatenate([b[s[r]:e[r]] for b, s, e in runs])
        out.append(np.unique(own, return_counts=True))
    return out


def row_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row: (distinct buckets, their share of the row's features)."""
    return [(ids, (counts / max(int(counts.sum()), 1)).astype(np.float32)) for ids, counts in row_counts(texts)]


@dataclass
class Model:
    vectors: np.ndarray         # 2 ** BITS x DIM
    output: np.ndarray          # DIM x 2
    bias: np.ndarray            # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """(logit difference of each bucket, of the bias)."""
        w = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
        seed: int = SEED) -> Model:
    """SGD on (buckets, shares, label 0/1).  Without rows, or with one class
    only, the bias alone says so."""
    rng = np.random.default_rng(seed)
    model = Model(((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32),
                  np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    labels = np.array([y for _, _, y in rows], np.int64)
    if len(labels) == 0:
        return model
    share = np.bincount(labels, minlength=2) / len(labels)
    if share.min() == 0:
        model.bias[:] = np.where(share > 0, 2.0, -2.0)
        model.vectors[:] = 0
        return model
    weight = 0.5 / share        # both classes pull alike, whatever their share
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, part, y = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = model.vectors[ids]
            hidden = part @ own
            logit = hidden @ model.output + model.bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            back = model.output @ p
            model.output -= lr * np.outer(hidden, p)
            model.bias -= lr * 0.1 * p
            # the average divides the gradient by the features; a bucket's own step is not
            model.vectors[ids] -= (lr * np.minimum(part * 100, 1))[:, None] * back[None, :]
    return model


def score_rows(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """P(label 1) of each text; an empty text has the bias alone."""
    total = np.zeros(len(texts))
    count = np.zeros(len(texts), np.int64)
    for buckets, first, end in feature_runs(texts):
        live = np.flatnonzero(end > first)
        if len(live):
            # reduceat on (first, end) pairs: every other sum is a row's
            cut = np.stack([first[live], end[live]], 1).ravel()
            values = np.append(table[buckets], np.float32(0)).astype(np.float64)
            total[live] += np.add.reduceat(values, cut)[::2]
            count[live] += end[live] - first[live]
    z = total / np.maximum(count, 1) + bias
    return 1 / (1 + np.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents in a seeded
    order.  Rows of one document with different labels count by the larger, of
    several texts with one doc_id that with the smallest hash; null labels and
    ids are left out."""
    ids = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows))
    # at most ``rows`` pairs of numbers: the size is bounded
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label")
            .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "label"))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textkit.slices(batch, "text"):
            found = row_counts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()),
                 pa.array([textkit.packed(i.astype(np.uint64)) for i, _ in found], pa.binary()),
                 pa.array([textkit.planes(c.astype(np.uint32)) for _, c in found], pa.binary())],
                names=["doc_id", "label", "ids", "counts"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on the labelled documents given (see ``labelled``).  What reaches
    the driver is bounded: ``rows`` documents of at most 2 ** BITS features."""
    got = labelled(docs, labels, rows).mapInArrow(_featurise, "doc_id long, label int, ids binary, counts binary").collect()
    got.sort(key=lambda r: r["doc_id"])     # a document has one row
    sizes = [int.from_bytes(r["ids"][:4], "little") for r in got]
    ends = np.cumsum(sizes, dtype=np.int64)
    # two large arrays and views of them: their memory goes back when the fit ends
    ids, shares = np.empty(sum(sizes), np.uint32), np.empty(sum(sizes), np.float32)
    for r, n, end in zip(got, sizes, ends.tolist(), strict=True):
        counts = textkit.from_planes(r["counts"], np.uint32)
        ids[end - n:end] = textkit.unpacked(r["ids"])
        shares[end - n:end] = counts / max(int(counts.sum()), 1)
    return fit([(ids[end - n:end], shares[end - n:end], r["label"]) for r, n, end in zip(got, sizes, ends.tolist(), strict=True)])


def score(spark: SparkSession, docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with one more column: P(label 1) from the text alone (a column
    of that name is replaced).

    Defined cases: null and empty texts get the score of the bias; repeated
    rows score alike; other columns pass through; an empty table stays empty.
    """
    table = spark.sparkContext.broadcast(model.folded())   # 2 ** BITS floats, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, bias = table.value
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                got = pa.array(score_rows(part.column("text"), z, bias), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, column])

    from pyspark.sql.types import DoubleType, StructField, StructType
    kept = docs.drop(column)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))
