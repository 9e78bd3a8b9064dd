"""Phrase collocations by Toivonen's method.

A sample proposes phrases: those frequent in it at a lowered threshold.  A full
pass counts, exactly, all words, every proposed phrase and the negative border,
that is every phrase that is not proposed while the two phrases one word
shorter inside it are.  Where a phrase that wasn't proposed turns out frequent,
phrases around it weren't counted: the frequent ones join the proposals and a
further pass counts what is new, until nothing is.

The passes count by 64-bit hash of (language, phrase); proposals reach the
tasks as a bit table of at most 2 ** MOST_BITS bits, where a chance hit means
one phrase counted more, never less.  What is frequent is spelled from a few of
its occurrences: the more it has, the smaller the share of the documents that
is read for it.  What these did not show, and hashes that two phrases were seen
to share, are counted once more by their words over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_engine.llm import textkit
from cohort_engine.llm.decontaminate import in_table
from cohort_engine.llm.store import written

LEAST = 100                     # occurrences of a phrase
WORDS = 5                       # words of the longest phrase
BEST = 2000                     # phrases of a language in the report
SAMPLE = 0.125                  # share of the documents that proposes
LOWERED = 0.4                   # sample threshold, of the share's part of LEAST
LEAST_BITS, MOST_BITS = 25, 28  # bits of a proposal table: 4 to 32 MB
HELD = 1 << 18                  # counts of one length a task holds before it passes them on
SLICE_BYTES = 1 << 20           # text bytes whose phrases are hashed at a time
SPELLED = 1 << 19              # phrases a task holds before it passes them on
SPELL_FROM = 4                  # occurrences, of LEAST, expected in the documents that spell
TIERS = 4                       # each has phrases four times as frequent, and a quarter of the documents
SALTS = 64
U64 = np.uint64

_WORD_GAP = np.zeros(256, bool)
_WORD_GAP[[0x20, 0x09]] = True
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _lang_hash(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Grams:
    """Words of a slice of documents with the hashes of their phrases."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.raw, off = textkit.text_bytes(texts)
        self.starts, self.ends, ptr = textkit.word_spans(self.raw, off, _WORD_GAP | _PIECE_END)
        self.words = textkit.hash_spans(self.raw, self.starts, self.ends)
        row = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
        breaks = np.concatenate([[0], np.cumsum(_PIECE_END[self.raw])])[self.starts]
        self.join = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])     # word i and i + 1 are of one piece
        self.names = langs.to_pylist()
        known = {x: _lang_hash(x) for x in set(self.names)}
        self.row = row
        self.salt = np.array([known[x] for x in self.names], U64)[row] if len(row) else np.zeros(0, U64)
        self._made: dict[int, np.ndarray] = {}

    def hashes(self, k: int) -> np.ndarray:
        """Hash of (language, the k words from each position)."""
        if k not in self._made:
            h = textkit.rolling(self.words, k)
            self._made[k] = textkit.mix64(h ^ (self.salt[:len(h)] + U64(k * 0x9E3779B97F4A7C15 % 2**64)))
        return self._made[k]

    def whole(self, k: int) -> np.ndarray:
        """Which positions have k words in one piece."""
        n = max(len(self.words) - k + 1, 0)
        ok = np.ones(n, bool)
        for i in range(k - 1):
            ok &= self.join[i:i + n]
        return ok

    def inside(self, k: int, of: np.ndarray, size: int) -> np.ndarray:
        """Which phrases of k words have all inner phrases of ``size`` words
        marked in ``of``."""
        ok = self.whole(k)
        for i in range(k - size + 1):
            ok &= of[i:i + len(ok)]
        return ok

    def phrase(self, at: int, k: int) -> str:
        words = [self.raw[self.starts[i]:self.ends[i]].tobytes().translate(_FOLD) for i in range(at, at + k)]
        return b" ".join(words).decode("utf-8", "replace")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        for part in textkit.slices(batch, "text", SLICE_BYTES):
            yield Grams(part.column("text"), part.column("lang"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


_COUNT = "k int, h long, n long"


def _counter(pick: Callable[[Grams], Iterator[tuple[int, np.ndarray]]]):
    """Counts per task and hash of what ``pick`` chooses of each slice."""
    def out(k: int, parts) -> pa.RecordBatch:
        h, n = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(textkit.signed(h)), pa.array(n)], names=["k", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for grams in _slices(batches):
            for k, hashes in pick(grams):
                held.setdefault(k, []).append(np.unique(hashes, return_counts=True))
            for k, parts in held.items():
                if sum(len(p[0]) for p in parts) > 2 * HELD:
                    parts[:] = [_summed(parts)]
                    if len(parts[0][0]) > HELD:
                        yield out(k, parts)
                        parts.clear()
        for k, parts in held.items():
            if parts:
                yield out(k, parts)
    return run


def counts(docs: DataFrame, pick: Callable[[Grams], Iterator[tuple[int, np.ndarray]]], least: int) -> DataFrame:
    """(k, h, n) of the chosen phrases with at least ``least`` occurrences."""
    return (docs.mapInArrow(_counter(pick), _COUNT).groupBy("k", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


class Table:
    """Proposals as a broadcast bit table; its size follows their number up to
    32 MB.  Beyond it the table only gets fuller: more is counted, all right."""

    def __init__(self, spark: SparkSession, hashes: DataFrame):
        n = hashes.count()
        self.bits = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
        at = F.shiftrightunsigned("h", 64 - self.bits)
        parts = (hashes.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
                 .collect())                    # 2 ** (bits - 15) rows of 4 KB at most
        table = np.zeros(1 << (self.bits - 3), np.uint8)
        for p in parts:
            table[p["part"] << 12:(p["part"] + 1) << 12] = np.frombuffer(p["bits"], np.uint8)
        self.data = spark.sparkContext.broadcast(table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return in_table(self.data.value, hashes, self.bits)

    def __getstate__(self):
        return {"bits": self.bits, "data": self.data}


def border(table: Table, counted: list[Table], words: int, singles: bool):
    """Chooses the phrases whose two inner phrases one word shorter are in
    ``table``, and that no earlier pass chose; with ``singles`` all words too,
    and each language's words as k = 0."""
    def pick(g: Grams):
        if singles:
            yield 0, g.salt
            yield 1, g.hashes(1)
        for k in range(2, words + 1):
            ok = g.inside(k, table.has(g.hashes(k - 1)), k - 1)
            for old in counted:
                at = np.flatnonzero(ok)
                h = g.hashes(k - 1)
                ok[at] = ~(old.has(h[at]) & old.has(h[at + 1]))
            yield k, g.hashes(k)[ok]
    return pick


def _words(g: Grams):
    yield 1, g.hashes(1)


def _pairs(singles: Table):
    def pick(g: Grams):
        yield 2, g.hashes(2)[g.inside(2, singles.has(g.hashes(1)), 1)]
    return pick


def _longer(pairs: Table, words: int):
    def pick(g: Grams):
        known = pairs.has(g.hashes(2))
        for k in range(3, words + 1):
            yield k, g.hashes(k)[g.inside(k, known, 2)]
    return pick


def proposals(spark: SparkSession, sample: DataFrame, least: int, words: int) -> DataFrame:
    """(k, h, n): what is frequent in the sample; words, pairs of them, then
    phrases made of such pairs."""
    one = written(counts(sample, _words, least), "phrase-sample-1")
    table = Table(spark, one)
    two = written(counts(sample, _pairs(table), least), "phrase-sample-2")
    table.data.destroy()
    table = Table(spark, two)
    more = written(counts(sample, _longer(table, words), least), "phrase-sample-3")
    table.data.destroy()
    return one.unionByName(two).unionByName(more)


def frequent(spark: SparkSession, docs: DataFrame, least: int, words: int, sample: float, lowered: float) -> DataFrame:
    """(k, h, n) of every word or phrase with ``least`` occurrences or more; k = 0
    has the words of each language by its hash."""
    known = written(proposals(spark, docs.sample(False, sample, 42), max(1, int(least * sample * lowered)), words), "phrase-proposals").select("k", "h")
    table, counted = Table(spark, known), []
    found = written(counts(docs, border(table, [], words, True), least), "phrase-counts")
    while True:
        new = found.select("k", "h").filter((F.col("k") > 0) & (F.col("k") < words)).join(known, ["k", "h"], "left_anti")
        if new.isEmpty():
            break
        known = written(known.unionByName(found.select("k", "h")).distinct(), "phrase-proposals")
        counted.append(table)
        table = Table(spark, known)
        found = found.unionByName(written(counts(docs, border(table, counted, words, False), least), "phrase-counts"))
    for t in [*counted, table]:
        t.data.destroy()
    return found


_SPELLED = "lang string, k int, phrase string, n long"


def _spell(table: Table, words: int):
    """(lang, k, phrase, n) per task of the phrases in the table."""
    def out(held: dict) -> pa.RecordBatch:
        rows = [(lang, k, phrase, n) for (lang, k, phrase), n in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                          names=["lang", "k", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for g in _slices(batches):
            for k in range(1, words + 1):
                h = g.hashes(k)
                at = np.flatnonzero(g.whole(k) & table.has(h))
                _, first, n = np.unique(h[at], return_index=True, return_counts=True)
                for p, count in zip(at[first].tolist(), n.tolist()):
                    key = (g.names[g.row[p]], k, g.phrase(p, k))
                    held[key] = held.get(key, 0) + count
            if len(held) > SPELLED:
                yield out(held)
                held = {}
        if held:
            yield out(held)
    return run


_EXAMPLE = "k int, h long, lang string, phrase string"


def _examples(tables: list[Table], shares: list[float], words: int):
    """The phrase of each hash in ``tables``, once a task; rows of ``draw`` below
    ``shares[i]`` are read for table i."""
    def out(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.int64(), pa.string(), pa.string()))],
                                          names=["k", "h", "lang", "phrase"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for part in textkit.slices(batch, "text", SLICE_BYTES):
                g, held = Grams(part.column("text"), part.column("lang")), []
                draw = np.asarray(part.column("draw"))[g.row]
                for k in range(1, words + 1):
                    h = g.hashes(k)
                    hit = np.zeros(len(h), bool)
                    for table, share in zip(tables, shares, strict=True):
                        at = np.flatnonzero(draw[:len(h)] < share)
                        hit[at] |= table.has(h[at])
                    at = np.flatnonzero(hit & g.whole(k))
                    values, first = np.unique(h[at], return_index=True)
                    for value, p in zip(textkit.signed(values).tolist(), at[first].tolist()):
                        row = (k, value, g.names[g.row[p]], g.phrase(p, k))
                        if row not in seen:
                            seen.add(row)
                            held.append(row)
                if held:
                    yield out(held)
                if len(seen) > SPELLED:
                    seen.clear()
    return run


def spelled(spark: SparkSession, docs: DataFrame, found: DataFrame, least: int, words: int) -> DataFrame:
    """(lang, k, phrase, n) of the hashes ``found`` (k, h, n)."""
    shares = [min(1.0, SPELL_FROM / least) / 4 ** i for i in range(TIERS)]
    tier = F.least(F.floor(F.log2(F.col("n") / least) / 2), F.lit(TIERS - 1))
    tables = [Table(spark, found.filter(tier == i).select("h")) for i in range(TIERS)]
    drawn = docs.withColumn("draw", F.rand(7)).filter(F.col("draw") < shares[0])
    seen = written(drawn.mapInArrow(_examples(tables, shares, words), _EXAMPLE).distinct(), "phrase-examples")
    for t in tables:
        t.data.destroy()
    # chance hits of the tables fall out of the join; a hash that two phrases share counts as not seen
    one = (seen.groupBy("k", "h").agg(F.count(F.lit(1)).alias("phrases"), F.min(F.struct("lang", "phrase")).alias("of"))
           .filter("phrases = 1").select("k", "h", "of.lang", "of.phrase"))
    told = written(found.join(one, ["k", "h"], "left"), "phrase-spelled")
    out = told.filter("phrase IS NOT NULL").select("lang", "k", "phrase", "n")
    rest = told.filter("phrase IS NULL").select("k", "h")
    if rest.isEmpty():
        return out
    table = Table(spark, rest)
    again = docs.mapInArrow(_spell(table, words), _SPELLED).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # chance hits of this table are phrases that are spelled already
    more = written(again.join(out, ["lang", "k", "phrase"], "left_anti"), "phrase-rest")
    table.data.destroy()
    return out.unionByName(more)


def _langs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.array([_lang_hash(x) for x in batch.column("lang").to_pylist()], U64)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(textkit.signed(h))], names=["lang", "h"])


def phrase_counts(spark: SparkSession, docs: DataFrame, least: int = LEAST, words: int = WORDS, sample: float = SAMPLE,
                  lowered: float = LOWERED) -> DataFrame:
    """(lang, k, phrase, n) of every phrase of k <= ``words`` words with n >=
    ``least`` contiguous occurrences inside pieces, words joined by one space;
    k = 0 has the number of all word occurrences of each language that has
    ``least`` or more."""
    found = written(frequent(spark, docs, least, words, sample, lowered), "phrase-frequent")
    langs = docs.select("lang").distinct().mapInArrow(_langs, "lang string, h long")
    totals = found.filter("k = 0").join(langs, "h").select("lang", "k", F.lit("").alias("phrase"), "n")
    return written(spelled(spark, docs, found.filter("k > 0"), least, words).unionByName(totals), "phrases")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, words: int = WORDS, best: int = BEST,
                 sample: float = SAMPLE, lowered: float = LOWERED) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``words`` words: lang, rank,
    phrase, a (its occurrences), l, r (those of the two parts of its
    lowest-scoring cut, the first of them), n (all words of the language),
    score = floor(1000 * a * n / (l * r)).  Left out are phrases inside a longer
    candidate with as many occurrences.  Counts may reach 10 ** 17 - 1; products
    are decimals of 38 digits.

    Defined cases: null texts are empty, a null lang is ``und``; A-Z are
    lower-cased; equal scores go by a, then by the phrase's bytes; repeated rows
    count each; other columns are not read; empty tables give an empty result.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    f = phrase_counts(spark, docs, least, words, sample, lowered)
    total = f.filter("k = 0").select("lang", F.col("n").alias("n"))
    parts = f.filter("k > 0").select("lang", "phrase", F.col("n").alias("a"))
    cand = f.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = (cand.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
            .select("lang", "phrase", "a", "at", piece(F.lit(1), F.col("at")).alias("head"), piece(F.col("at") + 1, F.col("k") - F.col("at")).alias("tail")))
    side = lambda name, out: parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    wide = lambda c: f"cast({c} as decimal(17,0))"
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(total, "lang")
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("cut"))
    shorter = (cand.filter("k > 2").select("lang", "a", F.explode(F.array(piece(F.lit(1), F.col("k") - 1), piece(F.lit(2), F.col("k") - 1))).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (lowest.join(shorter, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = (kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("place") <= best))
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
