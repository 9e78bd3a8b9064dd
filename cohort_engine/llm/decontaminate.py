"""Benchmark decontamination: size-partitioned MinHash containment search.

The Jaccard similarity of a short item and a long document is near 0, so equal
MinHash sketches on both sides would miss it.  The search is one-sided: an
item is represented by its smallest shingle hashes (bottom-k MinHash), a
document by all of its shingles.  Items are partitioned by the size of their
shingle set into classes [2^c, 2^(c+1)); the class fixes k = u - ceil(t u) + 1
for its upper bound u.  An item of q <= u shingles with containment t has at
most q - ceil(t q) <= k - 1 shingles outside the document, so one of its k
smallest is inside: no item is missed.

Documents are read once.  A fixed-size bit table of the item shingles, sent to
the tasks, keeps the rolling hashes that may belong to an item.  Sketch hits
give candidate pairs; a pair is kept when the exact share of the item's
distinct shingles found in the document reaches the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.llm import textkit
from cohort_engine.llm.store import written

WORDS = 5
CONTAINMENT = 0.75
TABLE_BITS = 25                 # bit table of 2 ** 25 bits: 4 MB, whatever the benchmark's size
U64 = np.uint64


def sketch_size(n: int, containment: float) -> int:
    """k of the size class of a set of n shingles."""
    upper = (1 << n.bit_length()) - 1
    return upper - math.ceil(containment * upper - 1e-9) + 1


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, ptr = textkit.words(texts, textkit.PUNCTUATION)
    return textkit.shingles(h, ptr, n)


def item_shingles(items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS) -> DataFrame:
    """One row per item and distinct shingle: item_id, h, width (words of the
    shingle), n (size of the item's set), in_sketch.  An item with fewer words
    has its whole sequence as its one shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                h, ptr = textkit.words(part.column("text"), textkit.PUNCTUATION)
                sets, at = textkit.row_sets(*textkit.shingles(h, ptr, words))
                n = np.diff(at)
                k = np.array([sketch_size(int(x), containment) if x else 0 for x in n], np.int64)
                rank = np.arange(len(sets)) - np.repeat(at[:-1], n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))),
                     pa.array(textkit.signed(sets)), pa.array(np.repeat(np.minimum(np.diff(ptr), words), n).astype(np.int32)),
                     pa.array(np.repeat(n, n)), pa.array(rank < np.repeat(k, n))],
                    names=["item_id", "h", "width", "n", "in_sketch"])
    return items.select("item_id", "text").mapInArrow(run, "item_id long, h long, width int, n long, in_sketch boolean")


def bit_table(hashes: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Bits set at the top ``bits`` bits of column h; at most 2 ** (bits - 6)
    words come to the driver, whatever the number of hashes."""
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = (hashes.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def in_table(table: np.ndarray, hashes: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Which uint64 hashes may be among those of the table."""
    at = hashes >> U64(64 - bits)
    return (table[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
              words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every pair where
    the document holds at least ``containment`` of the item's distinct
    shingles.  Words are runs of letters and digits, A-Z lower-cased.

    Defined cases: null and empty texts, and items without words, match
    nothing; rows that share a doc_id (or have none) are one document, a pair
    appears once; the same for item_ids: the item with more shingles counts;
    other columns are not read; empty tables give an empty result.
    """
    shingles = written(item_shingles(items, containment, words), "decontaminate-items")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())   # at most ``words`` numbers
    packed = spark.sparkContext.broadcast(bit_table(shingles))              # TABLE_BITS fixes its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = packed.value
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                h, ptr = textkit.words(part.column("text"), textkit.PUNCTUATION)
                ids = part.column("doc_id").cast(pa.int64())
                for width in widths:
                    # windows of ``width`` words inside one row
                    if width == words:
                        grams, at = textkit.shingles(h, ptr, words)
                    else:
                        grams, at = short_windows(h, ptr, width)
                    hit = np.flatnonzero(in_table(table, grams))
                    row = np.searchsorted(at, hit, "right") - 1
                    found = np.unique(np.stack([row.astype(U64), grams[hit]]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(found[0].astype(np.int64))), pa.array(found[1].view(np.int64))], names=["doc_id", "h"])

    hits = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h long").distinct(), "decontaminate-hits")
    sketch = shingles.filter("in_sketch").select("item_id", "h")
    pairs = hits.join(sketch, "h").select("doc_id", "item_id").distinct()
    whole = shingles.select("item_id", F.col("h").alias("ih"), "n").distinct()
    asked = pairs.join(whole, pairs["item_id"].eqNullSafe(whole["item_id"])).select("doc_id", pairs["item_id"], "ih", "n")
    found = (asked.join(hits.withColumnRenamed("doc_id", "hd"), (F.col("ih") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("hd")))
             .groupBy("doc_id", "item_id").agg(F.max("n").alias("n_shingles"), F.countDistinct("ih").alias("n_found")))
    return (found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
            .filter(F.col("containment") >= containment - 1e-12)
            .select("doc_id", "item_id", "n_shingles", "n_found", "containment"))


def short_windows(h: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` words in a row, alike to the one shingle of a
    text of ``width`` words."""
    lens = np.maximum(np.diff(ptr) - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(lens)])
    first = np.repeat(ptr[:-1] - at[:-1], lens) + np.arange(int(at[-1]))
    flat = (first[:, None] + np.arange(width)).ravel()
    grams, _ = textkit.shingles(h[flat], np.arange(len(first) + 1) * width, width + 1)
    return grams, at


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item.  Each row is judged by its own text, also
    where rows share a doc_id or have none; equal texts are searched as one."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = contained(spark, texts, items, containment).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["__bad"], "left_anti")
