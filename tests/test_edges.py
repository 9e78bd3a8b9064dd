"""Null and degenerate groups, wide numbers, tails at any size."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_engine import session
from cohort_engine.functions import distributions as dist
from cohort_engine.functions import scalar
from cohort_engine.operators import metrics, profile, sampling, stats
from cohort_engine.sources import typed


def test_null_labels_stay_in_split_and_folds(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"))
    split = sampling.stratified_split(df, "y", "id")
    assert split.count() == 100 and split.filter("split = 'test' AND y IS NULL").count() == 4
    folds = sampling.stratified_folds(df, "y", "id")
    assert folds.count() == 100 and {r["count"] for r in folds.filter("y IS NULL").groupBy("fold").count().collect()} == {4}


def test_null_groups_stay_in_histogram_and_box(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "g string, x double")
    h = profile.histogram(df, "x", 2, "g", "per_group")
    assert sum(r["n"] for r in h.collect()) == 4 and h.filter("g IS NULL").count() == 2
    assert {(r["g"], r["n"], r["median"]) for r in profile.box_stats(df, "x", "g").collect()} == {("a", 2, 2.0), (None, 2, 7.0)}


def test_one_class_gives_null_for_its_model_only(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.2), ("one", 1, 0.4), ("one", 1, 0.6), (None, 0, 0.1), (None, 1, 0.3)]
    s = spark.createDataFrame(rows, "model string, y int, p double")
    assert {r["model"]: r["roc_auc"] for r in metrics.roc_auc(s).collect()} == {"m": 1.0, "one": None, None: 1.0}


def test_many_score_partitions_give_the_same_area(spark):
    rng = np.random.default_rng(0)
    rows = [("m", int(y), float(round(p, 3))) for y, p in zip(rng.integers(0, 2, 800), rng.random(800))]
    s = spark.createDataFrame(rows, "model string, y int, p double")
    whole = metrics.roc_auc(s).first()["roc_auc"]
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert metrics.roc_auc(s).first()["roc_auc"] == pytest.approx(whole, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_degenerate_statistics_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.0, 5.0), ("b", 1.0, 3.0, 5.0), ("b", 1.0, 4.0, 5.0), ("c", 0.0, 0.0, 5.0),
                                ("c", 1.0, 2.0, 5.0), ("c", 2.0, 5.0, 5.0)], "g string, x double, y double, k double")
    fit = {r["g"]: r["resid_se"] for r in stats.group_linear_fit(df, "y", "x", "g").collect()}
    assert fit["a"] is None and fit["b"] is None and fit["c"] is not None
    r = {(x["var1"], x["var2"]): x["r"] for x in stats.corr_matrix(df, ["x", "y", "k"]).collect()}
    assert r["x", "x"] == 1.0 and r["k", "k"] is None and r["x", "k"] is None and r["x", "y"] is not None
    one = stats.anova_oneway(df.filter("g = 'a'"), "y", "g").first()
    assert one["f"] is None and one["df_between"] == 0
    assert stats.welch_t(df.withColumn("one", F.lit(1)), ["y"], "one").first()["t"] is None


def test_tukey_limits_and_many_groups(spark):
    df = spark.createDataFrame([(g, float(g + d)) for g in range(3) for d in (-1, 0, 1)], "g int, x double")
    rows = {r["comparison"]: r for r in stats.tukey_pairs(df, "x", "g", pvalues=True).collect()}
    # MSW = 1, n = 3, df = 6: half-width q(.95; 3, 6) * sqrt(1/3) with the tabled q = 4.339
    r = rows["2-0"]
    assert r["diff"] == 2.0 and r["upper"] - r["diff"] == pytest.approx(4.339 * 3**-0.5, abs=2e-3) and r["lower"] < r["diff"]
    many = spark.range(2 * 1200).select((F.col("id") % 1200).alias("g"), F.rand(1).alias("x"))
    assert stats.tukey_pairs(many, "x", "g").count() == 1200 * 1199 // 2


def test_tails_at_any_size():
    assert dist.tukey_upper(3.3145, 3, 5001)[0] == pytest.approx(dist.tukey_upper(3.3145, 3, 5000)[0], abs=1e-7)
    assert dist.tukey_upper(3.3145, 3, 1e12)[0] == pytest.approx(1 - dist._range_cdf_inf(3.3145, 3)[0], abs=1e-8)
    for k in (1e4, 1.99e4, 2.01e4, 1e6, 1e9, 1e12):      # Q(k/2, k/2) = 1/2 - 1/(3 sqrt(pi k)) + ...
        assert dist.chi2_upper(k, k) == pytest.approx(0.5 - 1 / (3 * np.sqrt(np.pi * k)), abs=2e-7)
    normal = float(dist.normal_two_sided(1.959964))
    for df in (1e6, 1e9, 6e11, 1e15):
        assert dist.t_two_sided(1.959964, df) == pytest.approx(normal, abs=1 / df + 1e-10)
        assert dist.f_upper(3.0, 2, df) == pytest.approx(np.exp(-3.0), abs=10 / df + 1e-10)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("99999999999999999999", "1D", "1", "1e3"), ("5", "2D", "2.5", ".5")], "wide string, d string, r string, e string")
    types = typed.infer_types(df)
    assert types == {"wide": "WIDE", "d": "TEXT", "r": "REAL", "e": "REAL"}
    assert str(typed.apply_types(df, types).first()["wide"]) == "99999999999999999999"
    got = spark.createDataFrame([("5F",), ("5",), (" 7.5 ",), ("1d",), (None,), ("-inf",)], "t string")
    assert [r[0] for r in got.select(scalar.safe_number("t", -1)).collect()] == [-1.0, 5.0, 7.5, -1.0, -1.0, float("-inf")]


def test_draws_reach_every_rank(spark):
    h = spark.range(2000).select(sampling.hash_int(sampling.seeded_hash(F.col("id"))).alias("h"))
    assert h.filter(F.col("h") > F.lit(2**59)).count() > 800 and h.filter("h < 0").count() == 0


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
