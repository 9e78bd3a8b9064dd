"""N-gram Jaccard self-join by vertical partitioning.

Every text is its set of word n-grams.  N-grams have one global order: by a
frequency class (from a fixed-size table of counts over the whole corpus, rare
first), then by hash.  The order is cut into fragments by hash range; a
fragment holds, of every text, the n-grams of its range, and is worked on
alone.

1. Texts with equal sets are one node.
2. Of every node the prefix of the order that any partner must share (its
   first n - ceil(t n) + 1 n-grams) is dealt to the fragments; a fragment
   returns the n-grams that two nodes or more have there.
3. Star steps: in each such group the nodes of a size band are paired with one
   leader, each node with a few leaders only.  Pairs are verified, links give
   components, and the next step pairs what is still apart with the largest
   ones; a group of g near copies costs a few g pairs.
4. Exact step: all pairs that share a prefix n-gram, pass the size and
   position bounds, differ in few enough bits of their marks (each n-gram of
   a set turns one bit over) and are not yet in one component are verified.
   No other pair can change a component.

A pair is verified by its partial overlaps: both sets are cut into fragments,
the common n-grams of each fragment are counted separately and summed.
N-grams are 64-bit hashes; nodes are 64-bit fingerprints of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_engine.llm import textkit
from cohort_engine.llm.components import components
from cohort_engine.llm.decontaminate import bit_table, in_table
from cohort_engine.llm.store import scratch, written

WORDS = 5
SIMILARITY = (3, 4)             # a pair links when 4 * common >= 3 * union
COUNT_BITS = 22                 # counts: 2 ** 22 buckets, 4 MB, whatever the corpus
COUNT_PARTS = 64
FRAGMENT_ENTRIES = 1_500_000    # prefix n-grams per fragment
LEAST_FRAGMENTS = 64
SET_FRAGMENT = 100_000          # n-grams of one text per fragment, when verifying
LEAST_GRAMS = 1 << 24           # so many n-grams of moved sets are no matter for the disk
MERGE_ENTRIES = 400_000
STAR_STEPS = ((4, 6), (16, 48))   # leaders a group offers, and a node is verified with, by step
SHARES_SLACK = 2                # a star pair's groups count so many times against the least a link has
EARLIER = 2                     # n-grams before one of a node's that are kept beside it
MARK_LONGS = 4                  # longs of a set's marks, whatever its size
MARKS = [f"m{k}" for k in range(MARK_LONGS)]
U64 = np.uint64


def doc_sets(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    h, ptr = textkit.words(part.column("text"))
    return textkit.row_sets(*textkit.shingles(h, ptr, words))


def fingerprints(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each row's set (0 for an empty one)."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(textkit.mix64(sets), dtype=U64)])
    n = np.diff(ptr)
    out = textkit.mix64(sums[ptr[1:]] - sums[ptr[:-1]] + n.astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return np.where(n > 0, out, U64(0))


def marks(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """64 * MARK_LONGS bits of each row's set, as longs: every n-gram turns one
    bit over, so that two sets differ in at least as many n-grams as bits."""
    width, rows = 64 * MARK_LONGS, len(ptr) - 1
    out = np.empty((rows, MARK_LONGS), np.int64)
    for at in range(0, rows, 4096):
        end = min(at + 4096, rows)
        own = textkit.mix64(sets[ptr[at]:ptr[end]]) % U64(width)
        spot = np.repeat(np.arange(end - at), np.diff(ptr[at:end + 1])) * width + own.astype(np.int64)
        odd = np.bincount(spot, minlength=(end - at) * width) % 2 == 1
        out[at:end] = np.packbits(odd).reshape(end - at, -1).copy().view(np.int64)
    return out


def prefix_size(n: np.ndarray) -> np.ndarray:
    num, den = SIMILARITY
    return n - (n * num + den - 1) // den + 1


# -- first reading: sizes, fingerprints, counts --------------------------------

def _measure(words: int):
    names = ["part", "doc_id", "n", "node", *MARKS, "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        seen = False
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                sets, ptr = doc_sets(part, words)
                seen = True
                counts += np.bincount((sets >> U64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, -1, np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(np.diff(ptr)),
                     pa.array(fingerprints(sets, ptr).view(np.int64)), *[pa.array(x) for x in marks(sets, ptr).T.copy()], pa.nulls(m, pa.binary())],
                    names=names)
        if seen:
            # partial counts up to 255 are kept as they are; more does not change a class by much
            small = np.minimum(counts, 255).astype(np.uint8).reshape(COUNT_PARTS, -1)
            none = pa.nulls(COUNT_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(COUNT_PARTS, dtype=np.int32)), *[none] * (3 + MARK_LONGS), pa.array([x.tobytes() for x in small], pa.binary())],
                names=names)
    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; one part's counts are held at a time."""
    now, total = None, None

    def out():
        classes = np.log2(np.maximum(total, 1)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["part", "classes"])
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            if part != now:
                if now is not None:
                    yield out()
                now, total = part, np.zeros((1 << COUNT_BITS) // COUNT_PARTS, np.int64)
            total += np.frombuffer(blob.as_buffer(), np.uint8)
    if now is not None:
        yield out()


def measured(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, marks) of every row, and the frequency class of each
    count bucket (2 ** COUNT_BITS bytes)."""
    longs = ", ".join(f"{m} long" for m in MARKS)
    mixed = written(docs.select("doc_id", "text").mapInArrow(_measure(words), f"part int, doc_id long, n long, node long, {longs}, counts binary"),
                    "ngram-sets")
    rows = (mixed.filter("part >= 0").select("part", "counts").repartition("part").sortWithinPartitions("part")
            .mapInArrow(_sum_counts, "part int, classes binary").collect())
    classes = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.uint8)
    for r in rows:
        classes[r["part"]] = np.frombuffer(r["classes"], np.uint8)
    return mixed.filter("part < 0").select("doc_id", "n", "node", *MARKS), classes.ravel()


# -- second reading: prefixes to fragments --------------------------------------

def _prefixes(words: int, classes, fragments: int):
    """Per slice and fragment one row: the entries' n-gram (48 bits), node
    number in the slice and place in the order, and the table of nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                for at in range(0, part.num_rows, 60_000):
                    sets, ptr = doc_sets(part.slice(at, 60_000), words)
                    nodes = fingerprints(sets, ptr)
                    _, first = np.unique(nodes, return_index=True)
                    first = first[nodes[first] != 0]
                    n = np.diff(ptr)
                    take = prefix_size(n)
                    cls = table[(sets >> U64(64 - COUNT_BITS)).astype(np.int64)]
                    picked = [sets[ptr[r]:ptr[r + 1]][np.argsort(cls[ptr[r]:ptr[r + 1]], kind="stable")[:take[r]]] for r in first]
                    if not picked:
                        continue
                    size = take[first]
                    grams = np.concatenate(picked)
                    owner = np.repeat(np.arange(len(first)), size)
                    rank = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
                    frag = ((grams >> U64(40)) * U64(fragments) >> U64(24)).astype(np.int64)
                    order = np.argsort(frag, kind="stable")
                    cut = np.searchsorted(frag[order], np.arange(fragments + 1))
                    out = {k: [] for k in ("fragment", "grams", "owners", "ranks", "nodes", "sizes")}
                    for f in np.flatnonzero(np.diff(cut)):
                        own = order[cut[f]:cut[f + 1]]
                        used, local = np.unique(owner[own], return_inverse=True)
                        out["fragment"].append(int(f))
                        out["grams"].append((grams[own] >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                        out["owners"].append(local.astype(np.uint16).tobytes())
                        out["ranks"].append(np.minimum(rank[own], 65535).astype(np.uint16).tobytes())
                        out["nodes"].append(nodes[first[used]].tobytes())
                        out["sizes"].append(n[first[used]].astype(np.int64).tobytes())
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                        [("fragment", pa.int32())] + [(k, pa.binary()) for k in ("grams", "owners", "ranks", "nodes", "sizes")]))
    return run


_BLOB = "fragment int, grams binary, owners binary, ranks binary, nodes binary, sizes binary"
_POSTING = np.dtype([("h", np.int64), ("node", np.int64), ("n", np.int64), ("rank", np.int32)])


def _entries(row: dict) -> np.ndarray:
    owners = np.frombuffer(row["owners"], np.uint16)
    out = np.empty(len(owners), _POSTING)
    wide = np.zeros((len(owners), 8), np.uint8)
    wide[:, :6] = np.frombuffer(row["grams"], np.uint8).reshape(-1, 6)
    out["h"] = wide.view(np.int64).ravel()
    out["node"] = np.frombuffer(row["nodes"], np.int64)[owners]
    out["n"] = np.frombuffer(row["sizes"], np.int64)[owners]
    out["rank"] = np.frombuffer(row["ranks"], np.uint16)
    return out


class Shared:
    """Entries of n-grams that come twice or more, as a fragment's rows come
    by.  Of each n-gram seen once its entry waits; memory follows the distinct
    n-grams of the fragment, not the size of its largest group."""

    def __init__(self):
        self.seen = np.zeros(0, np.int64)
        self.waiting = np.zeros(0, _POSTING)
        self.sent = np.zeros(0, bool)

    def add(self, new: np.ndarray) -> np.ndarray:
        new = new[np.argsort(new["h"], kind="stable")]
        h, first, count = np.unique(new["h"], return_index=True, return_counts=True)
        at = np.searchsorted(self.seen, h)
        known = at < len(self.seen)
        known[known] = self.seen[at[known]] == h[known]
        spot = at[known]
        out = [self.waiting[spot[~self.sent[spot]]]]
        self.sent[spot] = True
        many = known | (count > 1)
        out.append(new[np.repeat(many, count)])
        fresh = ~known
        where = at[fresh]
        self.seen = np.insert(self.seen, where, h[fresh])
        self.waiting = np.insert(self.waiting, where, new[first[fresh]])
        self.sent = np.insert(self.sent, where, many[fresh])
        return np.concatenate(out)


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by fragment."""
    now, state, held, size = None, Shared(), [], 0

    def flush():
        got = state.add(np.concatenate(held)) if held else np.zeros(0, _POSTING)
        return pa.RecordBatch.from_arrays([pa.array(got[k]) for k in _POSTING.names], names=list(_POSTING.names))
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["fragment"] != now:
                yield flush()
                now, state, held, size = row["fragment"], Shared(), [], 0
            held.append(_entries(row))
            size += len(held[-1])
            if size >= MERGE_ENTRIES:
                yield flush()
                held, size = [], 0
    yield flush()


def postings(spark: SparkSession, docs: DataFrame, classes: np.ndarray, entries: int, words: int = WORDS) -> DataFrame:
    """(h, node, n, rank): prefix n-grams that two texts or more have, with
    the nodes that have them."""
    fragments = max(LEAST_FRAGMENTS, math.ceil(entries / FRAGMENT_ENTRIES))
    sent = spark.sparkContext.broadcast(classes.tobytes())          # COUNT_BITS fixes its size
    dealt = docs.select("doc_id", "text").mapInArrow(_prefixes(words, sent, fragments), _BLOB)
    shared = (dealt.repartition("fragment").sortWithinPartitions("fragment")
              .mapInArrow(_share, "h long, node long, n long, rank int").distinct())
    return written(shared, "ngram-postings")


# -- verification ----------------------------------------------------------------

def _cut_sets(words: int, table, fragments: int):
    """(node, doc_id, fragment, grams) of the texts whose node may be asked
    for; of equal sets in a slice the smallest doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in textkit.slices(batch, "text"):
                sets, ptr = doc_sets(part, words)
                nodes = fingerprints(sets, ptr)
                ids = part.column("doc_id").cast(pa.int64())
                key = np.asarray(ids.fill_null(np.iinfo(np.int64).max))
                order = np.lexsort((key, nodes))
                order = order[np.concatenate([[True], nodes[order][1:] != nodes[order][:-1]])] if len(order) else order
                rows = order[(nodes[order] != 0) & in_table(bits, nodes[order])]
                values, sizes = [], []
                for r in rows:
                    own = sets[ptr[r]:ptr[r + 1]]
                    cuts = np.searchsorted(own, (np.arange(1, fragments, dtype=U64) * U64(2**63 // fragments)) << U64(1))
                    sizes.append(np.diff(np.concatenate([[0], cuts, [len(own)]])))
                    values.append(own)
                if not values:
                    continue
                off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[rows].view(np.int64), fragments)), ids.take(pa.array(np.repeat(rows, fragments))),
                     pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(rows))),
                     pa.LargeListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values).view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["node", "doc_id", "fragment", "grams"])
    return run


def verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int = WORDS,
             fragments: int = 2) -> DataFrame:
    """The pairs (a, na, b, nb) of nodes that link.  ``nodes``: (node, rep)."""
    asked = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep"), "node"), "ngram-asked")
    table = spark.sparkContext.broadcast(bit_table(asked.select(F.col("node").alias("h"))))
    cut = (docs.select("doc_id", "text").mapInArrow(_cut_sets(words, table, fragments), "node long, doc_id long, fragment int, grams array<long>"))
    # dealt by (node, fragment) from the start: the choice of one copy's sets (by
    # two bounds, which are no key to deal by), the join with a and that with b
    # use the same exchange
    every = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))
    own = asked.select(F.col("node").alias("k"), "rep", every.alias("part"))
    chosen = (F.col("doc_id").isNull() & F.col("rep").isNull()) | ((F.col("doc_id") >= F.col("rep")) & (F.col("doc_id") <= F.col("rep")))
    sets = cut.join(own, (F.col("node") == F.col("k")) & (F.col("fragment") == F.col("part")) & chosen).select("node", "fragment", "grams")
    num, den = SIMILARITY
    each = pairs.withColumn("fragment", every)
    left = each.join(sets.toDF("a", "fragment", "ga"), ["a", "fragment"])
    partial = (left.join(sets.toDF("b", "fragment", "gb"), ["b", "fragment"])
               .select("a", "na", "b", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("common")))
    return (partial.groupBy("a", "na", "b", "nb", "fragment").agg(F.max("common").alias("common"))
            .groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
            .filter(F.col("common") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "na", "b", "nb", "common"))


def links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, grams: int, words: int = WORDS, fragments: int = 2) -> DataFrame:
    """(a, b) of the pairs that link.  Every pair moves the set of its a: pairs
    whose sets have more than ``grams`` n-grams in all are verified in parts by
    a, one after the other, so what lies on disk at a time follows the text."""
    parts = max(1, -(-int(pairs.agg(F.sum("na")).first()[0] or 0) // max(grams, LEAST_GRAMS)))
    out = None
    for i in range(parts):
        own = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == i) if parts > 1 else pairs
        found = written(verified(spark, docs, nodes, own, words, fragments), "ngram-links").select("a", "b")
        out = found if out is None else out.union(found)
    return out


# -- the join ---------------------------------------------------------------------

def with_roots(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds root, the component of the node (itself when it has no link)."""
    if comps is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))


def enough(shares, na: str, nb: str):
    """Whether texts of ``na`` and ``nb`` n-grams that have ``shares`` prefix
    n-grams in common may link: past the end of the prefix that ends first
    they share no more than what its text has left."""
    num, den = SIMILARITY
    left = lambda n: F.ceil(F.col(n) * num / den) - 1  # noqa: E731  n - prefix_size(n)
    return (shares + F.greatest(left(na), left(nb))) * (num + den) >= (F.col(na) + F.col(nb)) * num


def near_enough(x: str, y: str, nx: str, ny: str):
    """Whether sets with the marks ``x`` and ``y`` (prefixes of the columns) may
    link: linked ones differ in (na + nb) / 7 n-grams at most."""
    num, den = SIMILARITY
    apart = sum((F.bit_count(F.col(x + m).bitwiseXOR(F.col(y + m))) for m in MARKS[1:]), F.bit_count(F.col(x + MARKS[0]).bitwiseXOR(F.col(y + MARKS[0]))))
    return apart * (num + den) <= (F.col(nx) + F.col(ny)) * (den - num)


def star_pairs(shared: DataFrame, nodes: DataFrame, comps: DataFrame | None, done: DataFrame | None, step: int) -> DataFrame:
    """Every node with a few leaders of its (n-gram, size band) groups that
    are in other components and were not tried: those of the largest groups,
    then those it shares most with.  A group's leaders are the largest nodes
    under a few orders that are the same in all groups.  ``STAR_STEPS`` has
    the numbers: the fewer nodes are still apart, the more leaders each can
    try.  A pair is left to the exact step when the groups it was found in are
    far too few for a link (``SHARES_SLACK`` allows for groups that the leader
    is in but does not lead).  ``nodes``: (node, n)."""
    offered, tried = STAR_STEPS[step]
    turns = [F.lit(int(x)) for x in textkit.signed(textkit.mix64(np.arange(offered, dtype=U64) + U64(1000 * step + 1)))]
    band = F.floor(F.log("n") / F.log(F.lit(SIMILARITY[1] / SIMILARITY[0]))).cast("int")
    group = Window.partitionBy("h", "band")
    # dealt once, as they are: each row gets its group's leaders afterwards
    rows = (with_roots(shared.select("h", "node", "n"), comps).withColumn("band", band).repartition("h", "band")
            .select("node", "n", "root", F.count(F.lit(1)).over(group).alias("g"),
                    F.min("root").over(group).alias("lo"), F.max("root").over(group).alias("hi"),
                    *[F.max(F.col("node").bitwiseXOR(x)).over(group).alias(f"lead{k}") for k, x in enumerate(turns)])
            .filter("lo <> hi"))
    asked = (rows.select("node", "n", "root", "g", F.explode(F.array_distinct(F.array(
                 *[F.col(f"lead{k}").bitwiseXOR(x) for k, x in enumerate(turns)]))).alias("b"))
             .filter("node <> b")
             .groupBy(F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "b")
             .agg(F.max("g").alias("g"), F.count(F.lit(1)).alias("shares")))
    known = with_roots(nodes.select("node", "n"), comps).toDF(*("b", "nb", "rb"))
    asked = (asked.join(known, "b").filter("ra <> rb").filter(enough(F.col("shares") * SHARES_SLACK, "na", "nb"))
             .select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "*"))
    if done is not None:
        asked = asked.join(done.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_anti")
    order = Window.partitionBy("a").orderBy(F.col("g").desc(), F.col("shares").desc(), "b")
    best = asked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= tried)
    first = F.col("a") <= F.col("b")
    return best.select(F.least("a", "b").alias("a"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"),
                       F.greatest("a", "b").alias("b"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def open_pairs(shared: DataFrame, nodes: DataFrame, comps: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that share a prefix n-gram, may link by size, place and marks, lie
    in different components and were not verified before; each comes from the
    first n-grams it shares.  ``nodes``: (node, marks)."""
    num, den = SIMILARITY
    placed = with_roots(shared, comps)
    group = Window.partitionBy("h")
    mixed = (placed.select("h", "node", "n", "rank", "root", F.min("root").over(group).alias("lo"), F.max("root").over(group).alias("hi"))
             .filter("lo <> hi").drop("lo", "hi"))
    # a pair that also shares an n-gram before this one has its row there
    order = Window.partitionBy("node").orderBy("rank", "h").rowsBetween(-EARLIER, -1)
    some = written(mixed.withColumn("earlier", F.collect_list("h").over(order)).join(nodes.select("node", *MARKS), "node"), "ngram-open")
    columns = ("node", "n", "rank", "root", "earlier", *MARKS)
    x = some.select("h", *[F.col(c).alias("x" + c) for c in columns])
    y = some.select("h", *[F.col(c).alias("y" + c) for c in columns])
    fits = ((F.col("xnode") < F.col("ynode")) & (F.col("xroot") != F.col("yroot"))
            & (F.col("xn") * den >= F.col("yn") * num) & (F.col("yn") * den >= F.col("xn") * num)
            & (F.least(F.col("xn") - F.col("xrank"), F.col("yn") - F.col("yrank")) * (num + den)
               >= (F.col("xn") + F.col("yn")) * num)
            & near_enough("x", "y", "xn", "yn") & ~F.arrays_overlap("xearlier", "yearlier"))
    pairs = (x.join(y, "h").filter(fits)
             .select(F.col("xnode").alias("a"), F.col("xn").alias("na"), F.col("ynode").alias("b"), F.col("yn").alias("nb")).distinct())
    return pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")


def link_components(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Defined cases: null and texts without words have the empty set, link with
    nothing and are their own component; equal sets always link; a component's
    id is its smallest doc_id, nulls apart (null when it has no other); rows
    that repeat a doc_id are texts of their own; other columns are not read;
    an empty table gives an empty result.
    """
    sizes, classes = measured(docs, words)
    known = sizes.agg(F.sum("n"), F.max("n")).first()
    entries = (known[0] or 0) * (SIMILARITY[1] - SIMILARITY[0]) // SIMILARITY[1]
    fragments = max(1, -(-(known[1] or 0) // SET_FRAGMENT))
    grams = known[0] or 0
    with scratch(spark, "ngram-steps") as keep:
        nodes = written(sizes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in MARKS]), "ngram-nodes")
        with scratch(spark, "ngram-tries") as hold:         # postings and tried pairs go before the last verification
            shared = postings(spark, docs, classes, entries, words)
            comps = done = None
            for step in range(len(STAR_STEPS)):
                pairs = written(star_pairs(shared, nodes, comps, done, step), "ngram-star")
                found = links(spark, docs, nodes, pairs, grams, words, fragments)
                done = pairs if done is None else done.union(pairs)
                comps = hold(components(found if comps is None else found.union(comps)), "ngram-components")
            rest = hold(open_pairs(shared, nodes, comps, done), "ngram-rest")
        more = links(spark, docs, nodes, rest, grams, words, fragments)
        comps = components(more.union(comps))      # a node and its root are a link that stands for all before
        placed = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
        where = placed.join(least, "root").select("node", "component_id")
        return keep(sizes.join(where, "node", "left")
                    .select("doc_id", F.col("n").alias("n_shingles"),
                            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "ngram-components")


def one_of_each(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with one of each component: that of the smallest doc_id
    (a row without doc_id only where no other is in the component).

    A document is its doc_id and text: different texts that share a doc_id, or
    have none, are judged each on its own.  Of rows that repeat both one stays;
    rows with neither doc_id nor words all stay."""
    text = F.xxhash64("text")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")
    with scratch(spark, "ngram-groups") as keep:
        found = (link_components(spark, docs.select(text.alias("doc_id"), "text"), words).filter("n_shingles > 0")
                 .select(F.col("doc_id").alias("h"), "component_id").distinct())
        placed = written(docs.select("doc_id", text.alias("h")).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
                         .join(found, "h", "left"), "ngram-placed")
        first = placed.filter("component_id IS NOT NULL").groupBy("component_id").agg(F.min(order).alias("first"))
        marked = placed.join(first, "component_id", "left").select(
            "doc_id", "h", "rows", "component_id", (F.col("first").isNull() | F.col("first").eqNullSafe(order)).alias("stays"))
        several = F.col("stays") & (F.col("rows") > 1) & (F.col("doc_id").isNotNull() | F.col("component_id").isNotNull())
        marked = keep(marked.filter(~F.col("stays") | several).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "stays"), "ngram-gone")
    same = docs["doc_id"].eqNullSafe(marked["__id"]) & (F.xxhash64(docs["text"]) == marked["__h"])
    rest = docs.join(marked, same, "left_anti")
    again = marked.filter("stays")
    if again.isEmpty():
        return rest
    row = F.min(F.struct(*docs.columns)).alias("__row")
    copies = docs.join(again, same, "left_semi")
    return rest.unionByName(copies.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h")).agg(row).select("__row.*"))
