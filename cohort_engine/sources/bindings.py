"""Bindings of the cohort data model to the driver tables.

``cohort``: one row per customer that has orders (customer join the
per-customer order aggregate, nation and region).  Nulls are injected by a
fixed rule on the key because the driver tables contain none.

Plan shape at scale: orders is aggregated with a map-side partial
aggregate (a customer holding a third of all orders collapses to one row
per task before the shuffle), so the join sees one row per customer and
cannot skew.  nation/region are the fixed-size TPC-H dimensions; Spark's
size estimate broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.functions.scalar import guarded_ratio
from cohort_engine.sources.tables import table

# Fixed binding rules (null injection and derived columns), shared with the
# oracle SQL in cohort_engine.plans.oracle.
NULL_MOD = 25
NULL_CONTRIBUTION = 3
NULL_CLAIM = 11
NULL_CONDITION = 19

COHORT_COLUMNS = ["patient_id", "age", "gender", "insurance_type", "annual_contribution",
                  "claim_amount", "expected_refills", "refills_received", "days_supply",
                  "chronic_condition", "num_medications", "adherent"]


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"])
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    # The mean price is taken over exact integer cents and divided once, so
    # the claim amount does not depend on summation order.
    per_cust = (orders.groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders"),
                     F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("bigint").alias("n_filled"),
                     F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")))
    k = F.col("c_custkey")
    m = k % NULL_MOD
    # by size in bytes of the compressed files a large customer table still looks
    # small enough to be sent through the driver: both sides are dealt by key
    df = (cust.hint("shuffle_hash").join(per_cust, cust.c_custkey == per_cust.o_custkey, "inner")
          .join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
          .join(region, nation.n_regionkey == region.r_regionkey, "inner"))
    return df.select(
        k.alias("patient_id"),
        (F.lit(18) + k % 68).cast("int").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.col("r_name").alias("insurance_type"),
        F.when(m == NULL_CONTRIBUTION, F.lit(None)).otherwise(F.col("c_acctbal")).cast("double")
        .alias("annual_contribution"),
        F.when(m == NULL_CLAIM, F.lit(None))
        .otherwise(F.col("cents").cast("double") / (F.col("n_orders").cast("double") * F.lit(5000.0)))
        .cast("double").alias("claim_amount"),
        F.col("n_orders").cast("bigint").alias("expected_refills"),
        F.col("n_filled").cast("bigint").alias("refills_received"),
        (F.lit(30) * (F.lit(1) + k % 3)).cast("int").alias("days_supply"),
        F.when(m == NULL_CONDITION, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("chronic_condition"),
        (F.lit(1) + k % 7).cast("int").alias("num_medications"),
        F.when(F.col("n_filled") * 3 + k % 5 > F.col("n_orders") + 2, 1).otherwise(0).cast("int")
        .alias("adherent"),
    )


def claims_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item scale binding: label = returned line, four numerics, two
    categories, composite key (l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    return li.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalanced label binding: documents with quality labels."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "n_chars", "lang", "source"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return docs.join(labels, "doc_id", "inner")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def round4(x):
    """Half-up rounding to 4 dp written as floor(x*1e4 + 0.5)/1e4: plain IEEE
    operations, so every engine produces the identical double."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


# Score bindings without ML, so metric keys have an exact SQL oracle.
SCORE_MODELS = ("ratio_score", "burden_score")


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table (model, patient_id, y, p, y_hat).

    ratio_score  p = round4(0.7*refill_ratio + 0.3*(id % 100)/99)
    burden_score p = round4(0.6*(1 - burden/5) + 0.4*(id*7 % 100)/99)
    with burden the zero-policy ratio clipped to [0, 5].
    """
    c = cohort(spark, sf_dir)
    ratio = guarded_ratio("refills_received", "expected_refills", 0.0, 1.0)
    burden = guarded_ratio("claim_amount", "annual_contribution", 0.0, 5.0)
    pid = F.col("patient_id")
    p1 = round4(F.lit(0.7) * ratio + F.lit(0.3) * (pid % 100) / F.lit(99.0))
    p2 = round4(F.lit(0.6) * (F.lit(1.0) - F.coalesce(burden, F.lit(0.0)) / F.lit(5.0))
                + F.lit(0.4) * ((pid * 7) % 100) / F.lit(99.0))
    base = c.select(pid, F.col("adherent").alias("y"), p1.cast("double").alias("p1"),
                    p2.cast("double").alias("p2"))
    long = base.select(
        pid, "y",
        F.explode(F.array(
            F.struct(F.lit(SCORE_MODELS[0]).alias("model"), F.col("p1").alias("p")),
            F.struct(F.lit(SCORE_MODELS[1]).alias("model"), F.col("p2").alias("p")))).alias("s"))
    return long.select(F.col("s.model").alias("model"), "patient_id", "y", F.col("s.p").alias("p"),
                       (F.col("s.p") >= 0.5).cast("int").alias("y_hat"))


def claims_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item scale scores for the ranking-metric bench: one model, p from
    discount and quantity (4 dp, many ties), label = returned line."""
    li = claims_wide(spark, sf_dir)
    p = round4(F.lit(0.5) * F.col("l_discount") * F.lit(10.0) + F.lit(0.5) * F.col("l_quantity") / F.lit(50.0))
    return li.select(F.lit("claims").alias("model"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("patient_id"),
                     F.col("label").alias("y"), p.cast("double").alias("p"),
                     (p >= 0.5).cast("int").alias("y_hat"))


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalanced-label scores: quality label, p from document length."""
    d = doc_quality(spark, sf_dir)
    p = round4(F.least(F.col("n_chars").cast("double") / F.lit(5000.0), F.lit(1.0)))
    return d.select(F.lit("doc_length").alias("model"), F.col("doc_id").alias("patient_id"),
                    F.col("quality").alias("y"), p.alias("p"), (p >= 0.5).cast("int").alias("y_hat"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second ratio binding: per-user view and purchase counts from events
    (map-side partial aggregation; a user holding a third of all events is
    one row per task before the shuffle)."""
    e = table(spark, sf_dir, "events", ["user_id", "event_type"])
    return e.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).cast("bigint").alias("n_view"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("bigint").alias("n_purchase"),
        F.count(F.lit(1)).alias("n_events"))
