"""Exact stratified split / folds / oversampling on the cohort binding."""
from pyspark.sql import functions as F

from cohort_engine.operators import sampling
from cohort_engine.sources import bindings

from places import SF01


def test_split_sizes_and_partition(spark):
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    s = sampling.stratified_split(c, "adherent", "patient_id", 0.2, 42).cache()
    sizes = {r["adherent"]: r["n"] for r in s.filter("split = 'test'").groupBy("adherent")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 171, 1: 129}
    assert s.count() == c.count() == s.select("patient_id").distinct().count()


def test_split_is_deterministic_and_seeded(spark):
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    a = {r[0] for r in sampling.stratified_split(c, "adherent", "patient_id").filter("split='test'").collect()}
    b = {r[0] for r in sampling.stratified_split(c.repartition(7), "adherent", "patient_id")
         .filter("split='test'").collect()}
    other = {r[0] for r in sampling.stratified_split(c, "adherent", "patient_id", seed=7)
             .filter("split='test'").collect()}
    assert a == b and a != other


def test_rank_within_is_exact_permutation(spark):
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    r = sampling.rank_within(c, "adherent", "patient_id")
    g = r.groupBy("adherent").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count(F.lit(1)))
    for row in g.collect():
        assert row[1] == 1 and row[2] == row[3] == row[4]


def test_folds_balanced(spark):
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    f = sampling.stratified_folds(c, "adherent", "patient_id", 5)
    per = f.groupBy("adherent", "fold").count().collect()
    by = {}
    for r in per:
        by.setdefault(r["adherent"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by.values())


def test_oversample_parity(spark):
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    o = sampling.random_oversample(c, "adherent", "patient_id")
    counts = {r["adherent"]: r["count"] for r in o.groupBy("adherent").count().collect()}
    assert counts[0] == counts[1] == 853
    # draws come from the minority only, and are seeded
    assert o.filter(F.col("draw").isNotNull()).select("adherent").distinct().count() == 1


def test_split_sizes_helper():
    assert sampling.split_sizes({0: 853, 1: 647}, 0.2) == {0: 171, 1: 129}


def test_hash_digits_grow_with_class_size(spark):
    assert sampling.hash_digits({0: 10}) == 3
    assert sampling.hash_digits({0: 6 * 10**11}) == 5
    # exact ranks do not depend on the bucket granularity
    c = bindings.cohort(spark, SF01).select("patient_id", "adherent")
    a = {tuple(r) for r in sampling.rank_within(c, "adherent", "patient_id", digits=1).collect()}
    b = {tuple(r) for r in sampling.rank_within(c, "adherent", "patient_id", digits=4).collect()}
    assert a == b


def test_split_equals_full_ranking_and_moves_no_row(spark):
    df = spark.range(20000).select((F.col("id") * 7).alias("key"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    got = sampling.stratified_split(df, "y", "key", 0.23, 5)
    counts = sampling.class_counts(df, "y")
    sizes = sampling.split_sizes(counts, 0.23)
    want = {c: set() for c in counts}
    for r in sampling.rank_within(df, "y", "key", 5).collect():
        if r["rank"] <= sizes[r["y"]]:
            want[r["y"]].add(r["key"])
    have = {c: set() for c in counts}
    for r in got.filter("split = 'test'").collect():
        have[r["y"]].add(r["key"])
    assert have == want and None in have and got.count() == 20000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # copies of a key and rows without one stay together; no row is lost
    odd = df.unionByName(df).unionByName(spark.range(50).select(F.lit(None).cast("bigint").alias("key"), F.lit(1).cast("bigint").alias("y")))
    split = sampling.stratified_split(odd, "y", "key", 0.23, 5)
    assert split.count() == 40050
    assert split.groupBy("key").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert sampling.stratified_split(df.limit(0), "y", "key").count() == 0
