"""Language-model scoring with a log-frequency Bloom filter.

Training counts every word and every word pair of all training texts (with one
end token per text, which is also the context of a text's first word).  Counts
are quantised to logarithmic levels; an n-gram of level q is put into a Bloom
filter q times, as (n-gram, 1) ... (n-gram, q).  The filter is broadcast, and
the level of an n-gram is read back by probing (n-gram, 1), (n-gram, 2), ...
until a probe fails.  A text's probability is the interpolated, discounted
bigram model

    P(w | v) = max(c(v w) - D2, 0) / c(v) + a(v) P(w),   P(w) = (c(w) - D1) / N

with all counts read from the filter; a(v), the mass that the stored pairs of
v leave over, is a third kind of entry.

The filter grows with the corpus, ``BITS`` bits an entry; pairs seen once are
never stored.  Where it would be larger than ``MOST_SEGMENTS`` at ``LEAST_BITS``
bits an entry, it stays a table of segments.  Only a head filter is broadcast
then: words and pairs from a count of ``start`` (2, 4, 8, ...) on, with so many
bits that hardly an n-gram is taken for a frequent one.  What a slice of texts
does not find there is sent to its segments, probed, and sent back; the levels
are those of the whole filter.  All counts are made over all texts at every
size.

The add-one base score needs exact counts: those of the most frequent words (a
table of at most ``HEAD_WORDS`` words) are broadcast, the other words of every
text, none of which can be frequent, are joined to the table of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.llm import textkit
from cohort_engine.llm.store import written
from cohort_engine.llm.textkit import from_planes, packed, planes, unpacked

SEGMENT_BITS = 22               # a filter segment: 2 ** 22 bits, 512 KB
MOST_SEGMENTS = 64              # largest broadcast filter: 32 MB
BITS = 10                       # bits per entry of the whole filter
LEAST_BITS = 20                 # bits per entry of a head filter
MOST_PROBES = 14
SHARD = 8                       # segments that one task holds for probing: 4 MB
HEAD_WORDS = 1 << 19            # largest broadcast table of counts: 8 MB
FRAGMENT_BYTES = 12 << 20       # text bytes whose counts make one fragment
LEAST_FRAGMENT_BITS = 6
DEAL_ROWS = 1 << 20             # entries dealt to segments at a time
D2 = 1.5                       # discount of pairs
ALPHA = 32                      # levels of the mass left over
U64 = np.uint64
END = textkit.mix64(np.array([0x454E44], U64))
_TAG = textkit.mix64(np.array([11, 12, 13], U64))


def thresholds(per_octave: int, first: int, most: float = 2.0**62) -> np.ndarray:
    """Counts at which a level starts."""
    steps = np.ceil(2.0 ** (np.arange(0, int(math.log2(most)) * per_octave) / per_octave)).astype(np.int64)
    return np.unique(steps[steps >= first])


WORD_LEVELS = thresholds(4, 1)
PAIR_LEVELS = thresholds(2, 2)


def level_of(counts: np.ndarray, levels: np.ndarray, start: int) -> np.ndarray:
    """Level of each count; counts below ``start`` have level 0."""
    base = int(np.searchsorted(levels, start, "right")) - 1
    return np.maximum(np.searchsorted(levels, counts, "right") - max(base, 0), 0) * (counts >= start)


def count_of(level: np.ndarray, levels: np.ndarray, start: int) -> np.ndarray:
    """The count a level stands for: the geometric middle of its range."""
    base = max(int(np.searchsorted(levels, start, "right")) - 1, 0)
    middle = np.sqrt(levels[:-1].astype(float) * np.maximum(levels[1:] - 1, levels[:-1]))
    return np.where(level > 0, middle[np.minimum(base + np.maximum(level, 1) - 1, len(middle) - 1)], 0.0)


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words and ends, the word before each, row pointer)."""
    h, ptr = textkit.words(texts)
    seq = np.insert(h, ptr[1:], END[0])
    before = np.concatenate([END, seq[:-1]])
    return seq, before, ptr + np.arange(len(ptr))


def word_key(h: np.ndarray) -> np.ndarray:
    return textkit.mix64(h ^ _TAG[0])


def _context(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, 32 bits after it) of a word as a context."""
    return v >> U64(64 - bits), (v >> U64(32 - bits)) & U64(0xFFFFFFFF)


def pair_key(fragment: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return textkit.mix64(pair ^ textkit.mix64(fragment + _TAG[1]))


def context_key(fragment: np.ndarray, v: np.ndarray) -> np.ndarray:
    return textkit.mix64(v ^ textkit.mix64(fragment + _TAG[2]))


# -- counting --------------------------------------------------------------------

_PARTS = ("words", "word_counts", "pairs", "many", "many_counts")


def _count(bits: int):
    """Per slice and fragment: distinct words and pairs with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                seq, before, _ = stream(part.column("text"))
                if len(seq) == 0:
                    continue
                words, counts = np.unique(seq, return_counts=True)
                cut = np.searchsorted(words >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
                frag, v = _context(before, bits)
                pair = (v << U64(32)) | (seq >> U64(32))
                order = np.argsort(frag.astype(np.uint16) if bits <= 16 else frag, kind="stable")
                pair = pair[order]
                at = np.searchsorted(frag[order], np.arange((1 << bits) + 1, dtype=U64))
                out = {k: [] for k in ("fragment", *_PARTS)}
                for f in range(1 << bits):
                    if cut[f] == cut[f + 1] and at[f] == at[f + 1]:
                        continue
                    pairs, n = np.unique(pair[at[f]:at[f + 1]], return_counts=True)
                    many = np.flatnonzero(n > 1)
                    out["fragment"].append(f)
                    for k, x in zip(_PARTS, (packed(words[cut[f]:cut[f + 1]]), counts[cut[f]:cut[f + 1]].astype(np.uint32).tobytes(), packed(pairs),
                                             many.astype(np.uint32).tobytes(), n[many].astype(np.uint32).tobytes()), strict=True):
                        out[k].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("fragment", pa.int32())] + [(k, pa.binary()) for k in _PARTS]))
    return run


def _sums(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v = v[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c[order], first) if len(v) else c


class Counts:
    """Counts of one fragment; memory follows its distinct n-grams."""

    def __init__(self, fragment: int):
        self.fragment, self.size = fragment, 0
        self.words, self.pairs = ([], []), ([], [])

    def add(self, row: dict) -> None:
        self.words[0].append(unpacked(row["words"]))
        self.words[1].append(np.frombuffer(row["word_counts"], np.uint32).astype(np.int64))
        pairs = unpacked(row["pairs"])
        n = np.ones(len(pairs), np.int64)
        n[np.frombuffer(row["many"], np.uint32)] = np.frombuffer(row["many_counts"], np.uint32)
        self.pairs[0].append(pairs)
        self.pairs[1].append(n)
        self.size += len(pairs)
        if self.size > 4_000_000:
            self.settle()

    def settle(self) -> None:
        self.words, self.pairs = (tuple([x] for x in _sums(*k)) for k in (self.words, self.pairs))
        self.size = 0

    def rows(self, bits: int) -> pa.RecordBatch:
        """kind 1: words (key is the word's hash); 2: pairs seen twice or
        more; 3: contexts, with the level of the mass that these pairs hold."""
        self.settle()
        words, c = self.words[0][0], self.words[1][0]
        pairs, n = self.pairs[0][0], self.pairs[1][0]
        frag = np.array([self.fragment], U64)
        stored = n >= 2
        v = pairs >> U64(32)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        kinds = [np.full(len(words), 1), np.full(int(stored.sum()), 2)]
        keys, counts = [words, pair_key(frag, pairs[stored])], [c, n[stored]]
        if len(v):
            held = np.add.reduceat(np.where(stored, n - D2, 0.0), first)
            level = np.rint(ALPHA * held / np.add.reduceat(n, first)).astype(np.int64)
            some = level > 0
            kinds.append(np.full(int(some.sum()), 3))
            keys.append(context_key(frag, v[first][some]))
            counts.append(level[some])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)),
             pa.array(np.concatenate(counts).astype(np.int64))], names=["kind", "key", "c"])


def _merge(bits: int):
    """Rows come sorted by fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if now is None or row["fragment"] != now.fragment:
                    if now is not None:
                        yield now.rows(bits)
                    now = Counts(row["fragment"])
                now.add(row)
        if now is not None:
            yield now.rows(bits)
    return run


# -- the filter --------------------------------------------------------------------

@dataclass
class Filter:
    data: np.ndarray            # bytes of its segments
    probes: int
    segments: int = 0           # of the whole filter, if data has only a part of them
    first: int = 0              # segment that data starts with

    def test(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Membership of (key, level): a key is out at its first clear bit."""
        segment, spots = places(keys, level, self.segments or len(self.data) >> (SEGMENT_BITS - 3), self.probes)
        ok, live, base = np.ones(len(keys), bool), np.arange(len(keys)), (segment - U64(self.first)) << U64(SEGMENT_BITS)
        for spot in spots:
            at = base[live] + spot(live)
            hit = (self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
            ok[live[~hit]] = False
            live = live[hit]
        return ok

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """Level of each key: probes go on until one fails.  Keys are taken in
        the order of their segments, which keeps the probes near each other."""
        order = np.argsort(keys >> U64(32))
        own, out, live = keys[order], np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(1, most + 1):
            live = live[self.test(own[live], level)]
            if not len(live):
                break
            out[order[live]] = level
        return out


def places(keys: np.ndarray, level, segments: int, probes: int) -> tuple[np.ndarray, list]:
    """(segment, function per probe: bit in the segment) of (key, level)."""
    segment = ((keys >> U64(32)) * U64(segments)) >> U64(32)
    x = textkit.mix64(keys + np.asarray(level, U64) * U64(0x9E3779B97F4A7C15)) if probes else keys
    a, b, mask = x & U64(0xFFFFFFFF), (x >> U64(32)) | U64(1), U64((1 << SEGMENT_BITS) - 1)

    def probe(j: int):
        return lambda of=slice(None): (a[of] + U64(j) * b[of]) & mask
    return segment, [probe(j) for j in range(probes)]


def _levels(kind: np.ndarray, c: np.ndarray, start: int) -> np.ndarray:
    """Entries of each n-gram in the filter."""
    return np.select([kind == 1, kind == 2], [level_of(c, WORD_LEVELS, start), level_of(c, PAIR_LEVELS, max(start, 2))], c)


def _deal(segments: int, start: int):
    def dealt(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, c, key = (np.concatenate([np.asarray(p.column(k)) for p in parts]) for k in ("kind", "c", "key"))
        key = key.view(U64)
        key = np.where(kind == 1, word_key(key), key)
        level = np.minimum(_levels(kind, c, start), 255).astype(np.uint8)
        segment, _ = places(key, 0, segments, 0)
        order = np.argsort(key)     # segments are ranges of keys
        order = order[level[order] > 0]
        cut = np.searchsorted(segment[order], np.arange(segments + 1, dtype=U64))
        some = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([packed(key[order[cut[s]:cut[s + 1]]]) for s in some], pa.binary()),
             pa.array([level[order[cut[s]:cut[s + 1]]].tobytes() for s in some], pa.binary())], names=["segment", "keys", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= DEAL_ROWS:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)
    return run


def _fill(segments: int, probes: int):
    """Rows come sorted by segment; one segment's bits are held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                              names=["segment", "bits"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != now:
                    if now is not None:
                        yield out()
                    now, bits = row["segment"], np.zeros(1 << SEGMENT_BITS, bool)
                keys, level = unpacked(row["keys"]), np.frombuffer(row["levels"], np.uint8)
                q = np.arange(int(level.sum())) - np.repeat(np.cumsum(level, dtype=np.int64) - level, level) + 1
                for spot in places(np.repeat(keys, level), q, segments, probes)[1]:
                    bits[spot()] = True
        if now is not None:
            yield out()
    return run


@dataclass
class Model:
    grams: DataFrame            # kind, key, c of all n-grams that may be stored
    bits: int                   # fragment bits: which part of a word's hash names it as a context
    tokens: int                 # N
    types: int                  # V
    discount: float             # D1
    start: int                  # first count of the broadcast filter (1: it is the whole filter)
    filter: Filter              # the broadcast one
    whole: DataFrame | None = None      # segment, bits of the whole filter, if it is not broadcast
    segments: int = 0           # of the whole filter
    probes: int = 0


def train(spark: SparkSession, docs: DataFrame, most_segments: int = MOST_SEGMENTS, least_bits: int = LEAST_BITS) -> Model:
    """Counts all texts of ``docs`` and builds the filter; a broadcast one has
    at most ``most_segments`` segments with ``least_bits`` bits an entry at
    least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_FRAGMENT_BITS, math.ceil(math.log2(max(size / FRAGMENT_BYTES, 1))))
    dealt = docs.select("text").mapInArrow(_count(bits), "fragment int, " + ", ".join(f"{k} binary" for k in _PARTS))
    grams = written(dealt.repartition("fragment").sortWithinPartitions("fragment")
                    .mapInArrow(_merge(bits), "kind int, key long, c long"), "lm-grams")
    # a histogram by power of two: a few dozen rows, whatever the corpus
    octave = F.floor(F.log2(F.col("c"))).cast("int")
    hist = (grams.groupBy("kind", octave.alias("octave")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"),
                                                              F.count(F.when(F.col("c") == 1, 1)).alias("ones"),
                                                              F.count(F.when(F.col("c") == 2, 1)).alias("twos")).collect())
    words = [r for r in hist if r["kind"] == 1]
    ones, twos = sum(r["ones"] for r in words), sum(r["twos"] for r in words)
    start = 1
    while (entries := _entries(hist, start)) * least_bits > most_segments << SEGMENT_BITS:
        start *= 2
    segments = min(max(1, math.ceil(entries * BITS / (1 << SEGMENT_BITS))), most_segments) if start == 1 else most_segments
    probes = _probes(segments, entries)
    data = np.zeros((segments, 1 << (SEGMENT_BITS - 3)), np.uint8)
    for r in _built(grams, segments, probes, start).toLocalIterator():      # a few segments at a time beside the filter itself
        data[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    model = Model(grams, bits, sum(r["c"] for r in words), sum(r["n"] for r in words), ones / (ones + 2 * twos) if ones else 0.5,
                  start, Filter(data.ravel(), probes))
    if start > 1:
        entries = _entries(hist, 1)
        model.segments = max(1, math.ceil(entries * BITS / (1 << SEGMENT_BITS)))
        model.probes = _probes(model.segments, entries)
        model.whole = written(_built(grams, model.segments, model.probes, 1), "lm-filter")
    return model


def _probes(segments: int, entries: int) -> int:
    return min(max(round(math.log(2) * (segments << SEGMENT_BITS) / max(entries, 1)), 1), MOST_PROBES)


def _built(grams: DataFrame, segments: int, probes: int, start: int) -> DataFrame:
    """(segment, bits) of the filter of counts from ``start`` on; contexts are
    in the whole filter only."""
    stored = grams if start == 1 else grams.filter((F.col("kind") < 3) & (F.col("c") >= start))
    return (stored.mapInArrow(_deal(segments, start), "segment int, keys binary, levels binary")
            .repartition("segment").sortWithinPartitions("segment").mapInArrow(_fill(segments, probes), "segment int, bits binary"))


def _entries(hist: list, start: int) -> int:
    """Upper bound of the filter's entries if the quantiser starts at ``start``."""
    total = 0
    for r in hist:
        if r["kind"] == 3:
            total += r["c"] * (start == 1)
        elif 2 ** r["octave"] >= start:
            top = np.array([2 ** (r["octave"] + 1) - 1])
            kind = np.array([r["kind"]])
            total += r["ones"] * int(_levels(kind, np.array([1]), start)[0]) + r["twos"] * int(_levels(kind, np.array([2]), start)[0])
            total += (r["n"] - r["ones"] - r["twos"]) * int(_levels(kind, top, start)[0])
    return total


# -- scoring -----------------------------------------------------------------------

@dataclass
class Grams:
    """Distinct n-grams of a slice of texts: its words, the same as contexts,
    and its pairs."""
    words: np.ndarray
    of: np.ndarray              # word of each token
    bits: int

    def __post_init__(self):
        b_of = np.empty_like(self.of)
        b_of[1:] = self.of[:-1]
        b_of[0] = np.searchsorted(self.words, END[0])
        pairs, self.p_of = np.unique(b_of * len(self.words) + self.of, return_inverse=True)
        self.pv, self.pw = pairs // len(self.words), pairs % len(self.words)
        frag, v = _context(self.words, self.bits)
        self.parts = (word_key(self.words), context_key(frag, v),
                      pair_key(frag[self.pv], (v[self.pv] << U64(32)) | (self.words[self.pw] >> U64(32))))

    def head_levels(self, f: Filter, start: int) -> np.ndarray:
        """Levels of all n-grams as far as the broadcast filter tells them."""
        most = (len(WORD_LEVELS), ALPHA if start == 1 else 0, len(PAIR_LEVELS))
        out = [f.levels(k, m) for k, m in zip(self.parts, most, strict=True)]
        for i, levels in ((0, WORD_LEVELS), (2, PAIR_LEVELS)):
            skipped = max(int(np.searchsorted(levels, start, "right")) - 1, 0)
            out[i] = np.where(out[i] > 0, out[i] + skipped, 0)
        return np.concatenate(out)

    def shards(self, asked: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the n-grams ``asked`` for in ascending order, which is that
        of their shards; the n-grams they are of; their shards."""
        keys = np.concatenate(self.parts)[asked]
        order = np.argsort(keys)
        keys = keys[order]
        return keys, asked[order], places(keys, 0, segments, 0)[0] // U64(SHARD)

    def logs(self, levels: np.ndarray, tokens: int, discount: float) -> np.ndarray:
        """log10 probability of each token."""
        n = len(self.words)
        count = count_of(np.minimum(levels[:n], len(WORD_LEVELS)), WORD_LEVELS, 1)
        left = np.minimum(levels[n:2 * n], ALPHA)
        both = np.minimum(levels[2 * n:], len(PAIR_LEVELS))
        alpha = np.where(left >= ALPHA, 0.5 / ALPHA, 1 - left / ALPHA)
        single = np.where(count > 0, np.maximum(count - discount, 0.25), max(discount, 0.25)) / max(tokens, 1)
        if tokens == 0:
            single[:] = 1.0
        seen = count_of(both, PAIR_LEVELS, 2)
        context = np.maximum(count[self.pv], np.maximum(seen, 1))
        known = count[self.pv] > 0
        p = np.where(known, np.maximum(seen - D2, 0) * (both > 0) / context + alpha[self.pv] * single[self.pw], single[self.pw])
        return np.log10(np.minimum(p, 1.0))[self.p_of]


def _ask(bits: int, segments: int):
    """Per slice and shard one row with the keys to probe there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams, asked = _grams(row, bits)
                keys, _, shard = grams.shards(asked, segments)
                some, at = np.unique(shard, return_index=True)
                ends = np.append(at[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["slice"], np.int64)), pa.nulls(len(some), pa.int32()),
                     pa.array([packed(keys[x:y]) for x, y in zip(at, ends, strict=True)], pa.binary())], names=["shard", "slice", "segment", "blob"])
    return run


def _grams(row: dict, bits: int) -> tuple[Grams, np.ndarray]:
    """The n-grams of a slice and which of them were not found."""
    grams = Grams(unpacked(row["words"]), from_planes(row["tokens"], np.uint32).astype(np.int64), bits)
    return grams, np.flatnonzero(from_planes(row["levels"], np.uint8) == 0)


def _probe(segments: int, probes: int):
    """Rows come sorted by shard, the segments of a shard before the keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != now:
                    now = row["shard"]
                    f = Filter(np.zeros(SHARD << (SEGMENT_BITS - 3), np.uint8), probes, segments, now * SHARD)
                if row["segment"] is not None:
                    at = (row["segment"] - f.first) << (SEGMENT_BITS - 3)
                    f.data[at:at + (1 << (SEGMENT_BITS - 3))] = np.frombuffer(row["blob"], np.uint8)
                    continue
                levels = f.levels(unpacked(row["blob"]), 255).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"slice": [row["slice"]], "shard": [now], "words": [None], "tokens": [None], "sizes": [None], "levels": [planes(levels)]},
                                                 schema=_ANSWERS)
    return run


_ANSWERS = pa.schema([("slice", pa.int64()), ("shard", pa.int32())] + [(k, pa.binary()) for k in ("words", "tokens", "sizes", "levels")])


def _combine(bits: int, segments: int, tokens: int, discount: float):
    """Rows come sorted by slice and shard, the slice itself (shard -1) first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []

        def out():
            grams, asked = _grams(held, bits)
            levels = from_planes(held["levels"], np.uint8).astype(np.int64)
            if answers:
                levels[grams.shards(asked, segments)[1]] = np.concatenate([from_planes(x, np.uint8) for x in answers])
            sizes = np.frombuffer(held["sizes"], np.int64)
            scores = np.add.reduceat(grams.logs(levels, tokens, discount), np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays([pa.array(held["slice"] + np.arange(len(sizes))), pa.array(scores)], names=["row", "score"])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] >= 0:
                    answers.append(row["levels"])
                    continue
                if held is not None:
                    yield out()
                held, answers = row, []
        if held is not None:
            yield out()
    return run


def _whole_scores(scored: DataFrame, model: Model) -> DataFrame:
    """(row, score) of the slices in ``scored``, whose n-grams that the head
    filter does not have are probed in the whole one."""
    slices = scored.filter("words IS NOT NULL").select(F.col("row").alias("slice"), F.lit(-1).alias("shard"), "words", "tokens", "sizes", "levels")
    asked = slices.mapInArrow(_ask(model.bits, model.segments), "shard int, slice long, segment int, blob binary")
    parts = model.whole.select(F.floor(F.col("segment") / SHARD).cast("int").alias("shard"), F.lit(-1).cast("long").alias("slice"), "segment",
                               F.col("bits").alias("blob"))
    # both written: the keys and then the slices in the shuffle files go before the next step
    answers = written(parts.union(asked).repartition("shard").sortWithinPartitions("shard", "slice")
                      .mapInArrow(_probe(model.segments, model.probes), "slice long, shard int, words binary, tokens binary, sizes binary, levels binary"), "lm-answers")
    return written(slices.union(answers).repartition("slice").sortWithinPartitions("slice", "shard")
                   .mapInArrow(_combine(model.bits, model.segments, model.tokens, model.discount), "row long, score double"), "lm-whole-scores")


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_tokens, n_known,
    base_score and score.

    Defined cases: null and empty texts have one token, the end; with nothing
    to learn from all probabilities are 1; repeated rows score alike; other
    columns are not read; an empty table gives an empty result.
    """
    # exact counts of the most frequent words: the lowest power of two that leaves at most HEAD_WORDS
    octaves = (model.grams.filter("kind = 1").groupBy(F.floor(F.log2("c")).cast("int").alias("o")).count().collect())
    octaves.sort(key=lambda r: -r["o"])
    least, room = 2**62, HEAD_WORDS
    for r in octaves:
        room -= r["count"]
        if room < 0:
            break
        least = 2 ** r["o"]
    counted = model.grams.filter("kind = 1").select(F.col("key").alias("h"), "c")
    head = counted.filter(F.col("c") >= least).toPandas().sort_values("h")
    sent = spark.sparkContext.broadcast((head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), model.filter))
    bits, tokens, discount, start = model.bits, model.tokens, model.discount, model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, f = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                texts = part.column("text")
                seq, _, ptr = stream(texts)
                h = seq.view(np.int64)
                words, of = np.unique(seq, return_inverse=True)     # each word is looked up once
                at = np.minimum(np.searchsorted(hashes, words.view(np.int64)), max(len(hashes) - 1, 0))
                known = hashes[at] == words.view(np.int64) if len(hashes) else np.zeros(len(words), bool)
                logs = np.where(known, np.log10(counts[at] + 1.0), 0.0)[of] if len(hashes) else np.zeros(len(h))
                hit = known[of]
                rest = np.concatenate([[0], np.cumsum(~hit)])[ptr]
                n = part.num_rows
                grams = Grams(words, of, bits)
                levels = grams.head_levels(f, start)
                score = pa.array(np.add.reduceat(grams.logs(levels, tokens, discount), ptr[:-1])) if start == 1 else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), *[part.column(k) for k in keep], pa.array(np.diff(ptr)),
                     pa.array(np.add.reduceat(hit.astype(np.int64), ptr[:-1])), pa.array(np.add.reduceat(logs, ptr[:-1])),
                     score, pa.LargeListArray.from_arrays(pa.array(rest), pa.array(h[~hit])).cast(pa.list_(pa.int64())),
                     *[pa.nulls(n, pa.binary())] * 4], names=names)
                if start > 1:       # the slice, for its n-grams that the head filter does not have
                    blobs = (packed(words), planes(of.astype(np.uint32)), np.diff(ptr).astype(np.int64).tobytes(), planes(np.minimum(levels, 255).astype(np.uint8)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), *[pa.nulls(1, part.column(k).type) for k in keep], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                         pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.int64())),
                         *[pa.array([x], pa.binary()) for x in blobs]], names=names)
                row += n

    names = ["row", *keep, "n_tokens", "head_known", "head_logs", "score", "rest", "words", "tokens", "sizes", "levels"]
    kept = docs.select(*keep, "text")
    schema = ", ".join(["row long", *[f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep],
                        "n_tokens long, head_known long, head_logs double, score double, rest array<long>",
                        *[f"{k} binary" for k in names[-4:]]])
    every = written(kept.mapInArrow(run, schema), "lm-scores")
    scored = every.filter("words IS NULL").drop(*names[-4:])
    if model.whole is not None:
        scored = scored.drop("score").join(_whole_scores(every, model), "row")
    tail = (scored.select("row", F.explode("rest").alias("h")).join(counted.filter(F.col("c") < least), "h")
            .groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("logs")))
    whole = math.log10(model.tokens + (model.types + 1))
    return (scored.drop("rest").join(tail, "row", "left")
            .select(*keep, "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    (F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score"))
