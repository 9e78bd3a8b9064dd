"""Leak-free sampling.

Row order does not exist in Spark, so every random choice is a seeded hash:
``md5(seed || '|' || key)``.  Ranks inside a class are exact and
distributed: rows are bucketed by the first hex digits of that hash (uniform
by construction, so a class holding a third of all rows is spread evenly;
the prefix length grows with the class size, ~1M rows per bucket, at least
4096 buckets), per (class, bucket) counts give offsets, and the row number is
taken inside (class, bucket) only — never one window over a whole class.  A
split needs one rank per class, so it ranks one bucket per class and compares
all other rows with the row found there.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


HASH_BUCKET_HEX = 3          # at least 16^3 = 4096 buckets per class
ROWS_PER_HASH_BUCKET = 1_000_000
SENT_DRAWS = 1 << 18         # draws (two longs each) that go to every task; more are dealt by rank


def hash_digits(counts: dict, rows_per_bucket: int = ROWS_PER_HASH_BUCKET) -> int:
    """Hex digits of the hash prefix so the largest class has about
    ``rows_per_bucket`` rows per bucket (never fewer than 3 digits)."""
    n = max(counts.values(), default=0)
    need = math.ceil(math.log(max(n / rows_per_bucket, 1.0), 16)) if n else 0
    return max(HASH_BUCKET_HEX, min(need, 12))


def seeded_hash(key, seed: int = 42):
    """Portable seeded order: md5('<seed>|<key>') (same text in SQL engines)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_int(h, digits: int = 15):
    """First ``digits`` hex digits of a hash as a non-negative integer: 60
    bits by default, far above any row count, so a modulus reaches every rank."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def rank_within(df: DataFrame, label: str, key: str, seed: int = 42, col: str = "rank",
                digits: int = HASH_BUCKET_HEX) -> DataFrame:
    """Exact 1-based rank of each row inside its class by the seeded hash.
    ``digits`` hex digits of the hash form the buckets (see ``hash_digits``)."""
    h = seeded_hash(key, seed)
    d = df.withColumns({"__h": h, "__b": F.substring(h, 1, digits)})
    counts = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(label).orderBy("__b")
    offsets = counts.select(label, "__b", F.coalesce(F.sum("__n").over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    # The offsets, classes x 16^digits rows, are the side that is sent: left to
    # choose by its estimates, the planner sends the rows through the driver.
    # Null labels are a class of their own.
    j = d.alias("d").join(F.broadcast(offsets).alias("o"), F.col(f"d.{label}").eqNullSafe(F.col(f"o.{label}"))
                          & (F.col("d.__b") == F.col("o.__b"))).select("d.*", "o.__off")
    w = Window.partitionBy(label, "__b").orderBy("__h", key)
    return j.select(*df.columns, (F.row_number().over(w) + F.col("__off")).alias(col))


def class_counts(df: DataFrame, label: str) -> dict:
    """Fitted parameter: rows per class (one row per class)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def approximate_mode(counts: dict, total: int) -> dict:
    """Allocate ``total`` draws to classes proportionally: floors, then the
    remainder to the largest fractional parts (ties in class order)."""
    n = sum(counts.values())
    alloc = {c: math.floor(total * v / n) for c, v in counts.items()}
    rem = total - sum(alloc.values())
    order = sorted(counts, key=lambda c: (-(total * counts[c] / n - alloc[c]), str(c)))
    for c in order[:rem]:
        alloc[c] += 1
    return alloc


def split_sizes(counts: dict, test_frac: float) -> dict:
    """Exact per-class test sizes of a stratified split: the train share is
    allocated first, the test gets the rest of each class."""
    n = sum(counts.values())
    n_test = math.ceil(test_frac * n)
    train = approximate_mode(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def per_class(label: str, values: dict):
    """The class's value as a column (null labels are a class; null where none is given)."""
    out = F.lit(None)
    for c, v in values.items():
        out = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(v)).otherwise(out)
    return out


def rank_cuts(df: DataFrame, label: str, key: str, sizes: dict, seed: int, digits: int) -> dict:
    """Per class the (hash, key) of the row with rank ``sizes[class]``.  Counts
    by hash prefix name the one bucket it lies in; only that bucket's rows are
    ranked.  One row per class is collected."""
    h = F.coalesce(seeded_hash(key, seed), F.lit(""))
    d = df.select(F.col(label).alias("c"), F.col(key).alias("k"), h.alias("h"), F.substring(h, 1, digits).alias("b"))
    per = d.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edges = (per.withColumns({"upto": upto, "want": per_class("c", sizes).cast("bigint")})
             .filter((F.col("want") > F.col("upto") - F.col("n")) & (F.col("want") <= F.col("upto")))
             .select("c", "b", (F.col("want") - F.col("upto") + F.col("n")).alias("rest")).collect())
    near = per_class("c", {r["c"]: r["b"] for r in edges}) == F.col("b")
    rank = F.row_number().over(Window.partitionBy("c").orderBy("h", "k"))
    found = (d.filter(near).withColumn("rank", rank)
             .filter(F.col("rank") == per_class("c", {r["c"]: r["rest"] for r in edges})).collect()) if edges else []
    return {r["c"]: (r["h"], r["k"]) for r in found}


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = 42,
                     col: str = "split") -> DataFrame:
    """Exact stratified train/test split; adds ``split`` in {train, test}.

    Rows are compared with their class's cut, so the split itself moves no
    row.  Rows that share their key (or have none) stay on one side; sizes are
    exact when keys are unique."""
    counts = class_counts(df, label)
    cuts = rank_cuts(df, label, key, split_sizes(counts, test_frac), seed, hash_digits(counts))
    h = F.coalesce(seeded_hash(key, seed), F.lit(""))
    test = F.lit(False)
    for c, (ch, ck) in cuts.items():
        at = (h == F.lit(ch)) if ck is None else (h == F.lit(ch)) & (F.col(key) <= F.lit(ck))
        test = test | (F.col(label).eqNullSafe(F.lit(c)) & ((h < F.lit(ch)) | at))
    return df.withColumn(col, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """Stratified fold id (rank - 1) mod k inside each class."""
    r = rank_within(df, label, key, seed, "__rk", hash_digits(class_counts(df, label)))
    return r.withColumn(col, ((F.col("__rk") - 1) % k).cast("int")).drop("__rk")


def random_oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """R2: majority rows plus as many draws with replacement from each
    smaller class (detected, not assumed), so the classes are at parity.
    Rows without label are no class: they are kept as they are.

    Draw i picks rank (hash(seed|i) mod n) + 1 of a class of n rows; draws are
    a ``range`` joined to the ranked class on that rank (an equi-join; each
    rank receives ~n_major/n draws, so no key is hot).  Output carries
    ``draw`` (null for kept rows).
    """
    counts = {c: n for c, n in class_counts(df, label).items() if c is not None}
    n_maj = max(counts.values(), default=0)
    small = sorted((c for c in counts if counts[c] < n_maj), key=str)
    spark = df.sparkSession
    raised = F.lit(False)
    for c in small:
        raised = raised | F.col(label).eqNullSafe(F.lit(c))
    out = df.filter(~raised).withColumn("draw", F.lit(None).cast("bigint"))
    for c in small:
        n = counts[c]
        ranked = rank_within(df.filter(F.col(label).eqNullSafe(F.lit(c))), label, key, seed, "__rk", hash_digits({c: n}))
        draws = spark.range(n_maj).select(F.col("id").alias("draw"),
                                          (hash_int(seeded_hash(F.col("id"), seed)) % n + 1).alias("__rk"))
        # The ranked class is never sent: its estimated size says little about
        # its rows (AQE splits any skewed draw partition).
        draws = F.broadcast(draws) if n_maj <= SENT_DRAWS else draws.hint("merge")
        out = out.unionByName(draws.join(ranked, "__rk").drop("__rk"))
    return out


def resample_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class counts before and after resampling."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("after"))
    return b.unionByName(a).select("stage", label, "n")
