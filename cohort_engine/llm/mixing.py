"""Mixing sources to target weights, in DataFrame operations only.

1. Size of every document in words; targets by water-filling: the total size
   is shared by source weight, no source above ``MOST`` times its own size.
2. Each source's documents are put in a seeded random order and laid end to
   end as a word stream, repeated when the target exceeds the source; the mix
   takes the first ``target`` words of it, so a document is taken whole at
   most ``MOST`` times and at most one document of a source is cut.
3. The taken stream is cut into blocks of ``block_words``.  The vector of
   block quotas (one entry per source) is split between output shards down a
   binary tree; each split draws the left child's vector from the multivariate
   hypergeometric distribution (one univariate draw per source, by inversion),
   so quotas stay exact and shards are balanced to one block.
4. Each shard takes its quota of every source's blocks, disjoint from all
   others, and shuffles its blocks locally.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_engine.llm.store import written

WEIGHTS = (5, 2, 1)             # by source in code point order, repeating
MOST = 3                        # a document is taken at most this often
BLOCK_WORDS = 1024
SHARD_WORDS = 1 << 22
BUCKET_ROWS = 50_000            # documents per prefix-sum bucket
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """row, doc_id, source, size and the seeded order of every row.  Without
    ``row_col`` the result must be written before it is used twice."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(row.alias("row"), F.col("doc_id"), F.col("source"),
                       F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                       F.md5(key).alias("h"), F.xxhash64("text").alias("tie"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: src (number in code point order, null last),
    source, source_size, target.  A source is at its limit when the level of
    the water, (total - limits so far) / (weights left), reaches
    limit / weight; in order of limit / weight these come first."""
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "src")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("src", (F.row_number().over(whole) - 1).cast("long"))
         .withColumn("weight", weight.cast("long"))
         .withColumn("limit", F.col("source_size") * most)
         .withColumn("ratio", F.col("limit").cast("double") / F.col("weight").cast("double"))
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double")
                     / F.sum("weight").over(after).cast("double"))
         .withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "src", "level"))).over(every)))
    full = F.col("free").isNull() | (F.struct("ratio", "src") < F.struct("free.ratio", "free.src"))
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("free.level") * F.col("weight").cast("double"))
    words = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("limit"))
    return (s.withColumn("target", target).withColumn("target_words", words)
            .select("src", "source", "source_size", "target", "target_words"))


def streams(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Adds src, source_size, target_words and ``start``: the words of the
    source before this row in its seeded order.  Prefix sums go by hash bucket
    (uniform, whatever the source's share), then inside the bucket."""
    digits = max(2, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    d = (sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
         .withColumn("b", F.substring("h", 1, digits)))
    sums = d.groupBy("src", "b").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "b").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(offsets, ["src", "b"])
            .withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("base"))
            .drop("b", "base", "h", "tie"))


def hypergeometric(total, marked, drawn, u):
    """Column: how many marked ones are among ``drawn`` of ``total``, by
    inversion at ``u`` in [0, 1).  The sum runs over the mode's neighbourhood
    of 10 standard deviations, beyond which a double holds nothing."""
    d = lambda x: x.cast("double")
    least = F.greatest(F.lit(0), drawn - (total - marked))
    most = F.least(drawn, marked)
    mode = F.floor(d(drawn + 1) * d(marked + 1) / d(total + 2)).cast("long")
    share = d(marked) / F.greatest(d(total), F.lit(1.0))
    var = d(drawn) * share * (1 - share) * d(total - drawn) / F.greatest(d(total - 1), F.lit(1.0))
    reach = F.ceil(F.sqrt(F.greatest(var, F.lit(0.0))) * 10).cast("long") + 10
    lo, hi = F.greatest(least, mode - reach), F.least(most, mode + reach)
    weight = lambda w, k: (w * d(marked - k) * d(drawn - k)
                           / F.greatest(d(k + 1) * d(total - marked - drawn + k + 1), F.lit(1.0)))
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    ks = F.sequence(lo, F.greatest(lo, hi))
    whole = F.aggregate(ks, zero, lambda a, k: F.struct(weight(a["w"], k).alias("w"), (a["s"] + a["w"]).alias("s"),
                                                        a["n"].alias("n")), lambda a: a["s"])
    return F.element_at(F.transform(F.array(whole * u), lambda aim: F.aggregate(
        ks, zero, lambda a, k: F.struct(weight(a["w"], k).alias("w"), (a["s"] + a["w"]).alias("s"),
                                        (a["n"] + F.when(a["s"] + a["w"] <= aim, 1).otherwise(0)).alias("n")),
        lambda a: F.least(lo + a["n"], hi))), 1)


def uniform(*parts, seed: int = SEED):
    """A number in [0, 1) from a seeded hash of the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def split_tree(spark: SparkSession, quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(shard, src, blocks): the quota vector ``quotas`` (src, blocks) split
    among 2 ** levels shards.  A node is one row with the vector of all
    sources (the sources and weights are the mix's settings)."""
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "blocks"))), lambda x: x["blocks"])
                       .alias("q")).withColumn("node", F.lit(1).cast("long"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def left(q, node):
        start = F.struct(add(q).alias("total"), F.floor(add(q) / 2).cast("long").alias("drawn"),
                         F.array().cast("array<bigint>").alias("got"))

        def step(a, x):
            i = F.size(a["got"])
            draw = F.array(hypergeometric(a["total"], x, a["drawn"], uniform(node, i, seed=seed)))
            return F.element_at(F.transform(draw, lambda n: F.struct(
                (a["total"] - x).alias("total"), (a["drawn"] - n).alias("drawn"),
                F.concat(a["got"], F.array(n)).alias("got"))), 1)
        return F.aggregate(q, start, step, lambda a: a["got"])

    for _ in range(levels):
        nodes = (nodes.withColumn("l", left(F.col("q"), F.col("node")))
                 .select(F.explode(F.array(
                     F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")),
                     F.struct((F.col("node") * 2 + 1).alias("node"),
                              F.zip_with("q", "l", lambda a, b: a - b).alias("q")))).alias("x")).select("x.*"))
    return nodes.select((F.col("node") - 2**levels).alias("shard"), F.posexplode("q").alias("src", "blocks")) \
        .withColumn("src", F.col("src").cast("long"))


def mix(spark: SparkSession, sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as pieces: shard, position (order inside the shard), row,
    doc_id, source, epoch (which repeat of the source), from_word, n_words.

    ``sizes`` comes from ``sized`` and ``sources`` from ``source_targets``.
    Defined cases: null sources are one source (last in order); null texts
    have size 0 and are never taken; a source without words has target 0;
    repeated rows are documents of their own; null doc_ids stay null; an empty
    table gives no pieces.  The same input gives the same mix.
    """
    known = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    levels = max(0, math.ceil(math.log2(max((known["words"] or 0) / shard_words, 1))))
    laid = streams(sizes, sources, known["n"])
    quotas = sources.select("src", F.ceil(F.col("target_words") / block_words).cast("long").alias("blocks"))
    shards = written(split_tree(spark, quotas, levels, seed), "mix-quotas")
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (shards.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0))).filter("blocks > 0")
             .select("src", "shard", F.explode(F.expr("sequence(base, base + blocks - 1)")).alias("block")))
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("target_words") - 1 - F.col("start")) / F.col("source_size")))
    runs = (laid.filter((F.col("size") > 0) & (F.col("start") < F.col("target_words")))
            .withColumn("epoch", F.explode(epochs))
            .withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
            .withColumn("end", F.least(F.col("at") + F.col("size"), F.col("target_words"))))
    pieces = (runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words),
                                                            F.floor((F.col("end") - 1) / block_words))))
              .withColumn("lo", F.greatest(F.col("at"), F.col("block") * block_words))
              .withColumn("hi", F.least(F.col("end"), (F.col("block") + 1) * block_words)))
    local = Window.partitionBy("shard").orderBy(F.xxhash64("src", "block", F.lit(seed)), "src", "block", "lo")
    return (pieces.join(drawn, ["src", "block"])
            .withColumn("position", F.row_number().over(local) - 1)
            .select("shard", "position", "row", "doc_id", "source", "epoch",
                    (F.col("lo") - F.col("at")).alias("from_word"), (F.col("hi") - F.col("lo")).alias("n_words")))


def _numbered(docs: DataFrame, stored: bool) -> DataFrame:
    """(doc, row): rows of stored files are named by file and place in it; the
    others are written, so that their numbers stay."""
    doc = F.struct(*docs.columns).alias("doc")
    if stored:
        try:
            place = docs.metadataColumn("_metadata")
            return docs.select(doc, F.struct(place["file_path"].alias("file"), place["row_index"].alias("at")).alias("row"))
        except AnalysisException:       # no files behind it
            pass
    return written(docs.select(doc, F.monotonically_increasing_id().alias("row")), "mix-documents")


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED, stored: bool = False) -> DataFrame:
    """The mixed documents with their own columns: one row per document and
    repeat the mix takes; of the document where a source's target ends, only
    the words taken (joined by single spaces; n_chars, if there is such a
    column, follows).  Other columns may have any names.  ``stored``: ``docs``
    is a plain read of Parquet files, which needs no copy."""
    kept = _numbered(docs, stored)
    sizes = written(sized(kept.select("row", "doc.doc_id", "doc.source", "doc.text"), seed, "row"), "mix-sizes")
    sources = written(source_targets(sizes), "mix-sources")
    taken = (mix(spark, sizes, sources, seed=seed).groupBy("row", "epoch").agg(F.sum("n_words").alias("taken"))
             .join(sizes.select("row", "size"), "row"))
    cut = F.col("taken") < F.col("size")
    words = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), 0), F.lit(1), F.col("taken").cast("int")), " ")
    fields = {c: F.col("doc").getField(c) for c in docs.columns}
    fields["text"] = F.when(cut, words).otherwise(fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(cut, F.length(words).cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return kept.select("row", "doc").join(taken, "row").select(*[v.alias(c) for c, v in fields.items()])
