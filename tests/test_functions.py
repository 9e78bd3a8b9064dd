"""Literal cases of the reference's feature and cleaning tests (FIXTURES 2-5)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_engine.functions import scalar
from cohort_engine.operators import clean, profile, quantiles
from cohort_engine.operators import features as feat
from cohort_engine.sources import typed

ROWS = [(25, 3000.0, 1500.0, 10, 8, 30, 1), (50, 2000.0, 4000.0, 8, 0, 60, 3), (70, 4000.0, 1000.0, 6, 6, 90, 6),
        (18, 1000.0, 0.0, 4, 4, 30, 2), (85, 5000.0, 2500.0, 12, 3, 90, 7)]
COLS = "age int, annual_contribution double, claim_amount double, expected_refills int, refills_received int, " \
       "days_supply int, num_medications int"


@pytest.fixture()
def lit5(spark):
    return spark.createDataFrame(ROWS, COLS).withColumn("i", F.monotonically_increasing_id())


def col(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def test_feature_literals(lit5):
    f = feat.derive_features(lit5)
    assert col(f, "refill_ratio") == pytest.approx([0.8, 0.0, 1.0, 1.0, 0.25])
    assert col(f, "financial_burden") == pytest.approx([0.5, 2.0, 0.25, 0.0, 0.5])
    assert col(f, "age_group") == [0, 1, 2, 0, 2]
    assert col(f, "medication_complexity") == [0, 1, 2, 0, 2]
    assert col(f, "supply_category") == [0, 1, 2, 0, 2]
    assert col(f, "refill_gap") == [2, 8, 0, 0, 9]


def test_zero_denominator(spark):
    df = spark.createDataFrame([(0, 3)], "expected_refills int, refills_received int")
    assert df.select(feat.refill_ratio().alias("r")).first()["r"] == 0.0


def test_burden_null_policy(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (0.0, 1.0), (-1.0, 1.0)],
                               "annual_contribution double, claim_amount double")
    out = [r["b"] for r in df.select(feat.financial_burden().alias("b")).collect()]
    assert out == [0.0, None, 0.0, 0.0]


def test_clip_keeps_nulls(spark):
    # greatest/least skip nulls; the clip must not.
    df = spark.createDataFrame([(None,), (7.0,), (-1.0,)], "x double")
    assert [r["c"] for r in df.select(scalar.clip("x", 0, 5).alias("c")).collect()] == [None, 5, 0]


def test_bucketize_outside_is_null(spark):
    df = spark.createDataFrame([(0,), (30,), (31,), (365,), (400,), (None,)], "d int")
    out = [r["b"] for r in df.select(scalar.bucketize("d", [30, 60], 0, 365).alias("b")).collect()]
    assert out == [None, 0, 1, 2, None, None]


def test_confidence_edges(spark):
    vals = [0.75, 0.7501, 0.60, 0.40, 0.25, 0.2499]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    out = [r["c"] for r in df.select(scalar.confidence_band("p").alias("c")).collect()]
    assert out == ["Medium", "High", "Low", "Low", "Medium", "High"]


def test_safe_number(spark):
    df = spark.createDataFrame([(" 2.7 ",), ("x",), (None,), ("-3.9",), ("nan",), ("1e3",)], "s string")
    r = df.select(scalar.safe_number("s", 0, integer=True).alias("i"), scalar.safe_number("s", 0.0).alias("f"))
    rows = r.collect()
    assert [x["i"] for x in rows] == [2, 0, 0, -3, 0, 1000]
    assert [x["f"] for x in rows][:4] == [2.7, 0.0, 0.0, -3.9]


def test_normalize_name():
    assert scalar.normalize_name(" PR-AUC (At-Risk) ") == "pr_auc_(at_risk)"
    assert scalar.normalize_name("F1 Score") == "f1_score"


def test_type_inference_cells(spark):
    df = spark.createDataFrame([("", "1", "1", "nan", "x"), ("", "2.5", "x", "1e3", "")],
                               "a string, b string, c string, d string, e string")
    assert typed.infer_types(df) == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "REAL", "e": "TEXT"}


def test_metric_types_infer_real(spark):
    df = spark.createDataFrame([(".68", "Gradient Boosting"), (".756", "x")], "v string, m string")
    assert typed.infer_types(df)["v"] == "REAL"


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("z",), ("a",), ("z",), ("a",), (None,)], "c string")
    p = clean.fit_impute(df, num_cols=[], cat_cols=["c"])
    assert p.modes["c"] == "a"
    assert clean.impute(df, p).filter(F.col("c").isNull()).count() == 0


def test_one_hot_first_level_dropped(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string").withColumn(
        "i", F.monotonically_increasing_id())
    out = clean.encode(df, clean.fit_encoder(df, onehot_cols=["c"]))
    assert [c for c in out.columns if c.startswith("c_")] == ["c_b"]
    assert [r["c_b"] for r in out.orderBy("i").collect()] == [1, 0, 0, 1]


def test_label_encode_sorted(spark):
    df = spark.createDataFrame([("Male",), ("Female",)], "gender string")
    out = clean.encode(df, clean.fit_encoder(df, label_cols=["gender"]))
    assert sorted((r["gender_encoded"]) for r in out.collect()) == [0, 1]
    assert "gender" not in out.columns


def test_iqr_cap_literal(spark):
    df = spark.createDataFrame([(a, 3000.0, 1000.0, 6, 5, 3) for a in (30, 31, 32, 33, 5000)],
                               "age int, annual_contribution double, claim_amount double, expected_refills int, "
                               "refills_received int, num_medications int")
    f = clean.fit_fences(df)
    assert (f.lower["age"], f.upper["age"]) == (28.0, 36.0)
    out = clean.cap(df, f)
    assert out.count() == 5
    assert out.agg(F.max("age")).first()[0] == 36.0
    assert {r["annual_contribution"] for r in out.collect()} == {3000.0}


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert clean.dedup(df).count() == 2
    r = clean.dedup_report(df).first()
    assert (r["rows_before"], r["rows_after"], r["removed"]) == (3, 2, 1)


def test_quantile_buckets_engine_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (-5, 1, 2, 3, 4, 5, 200)], "x double").withColumn(
        "i", F.monotonically_increasing_id())
    rules = feat.fit_bucket_rules(df, {"x": (0, 10)})
    assert not rules["x"].fixed
    out = df.select("i", feat.quantile_bucket("x", rules["x"].edges).alias("b"))
    assert [r["b"] for r in out.orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2]


def test_duplicate_quantile_edges_raise(spark):
    df = spark.createDataFrame([(float(v),) for v in (30, 30, 30, 60, 60, 90)], "x double")
    rules = feat.fit_bucket_rules(df, {"x": (1000, 2000)})
    with pytest.raises(ValueError):
        feat.quantile_bucket("x", rules["x"].edges)


def test_model_matrix_token_match(spark):
    df = spark.createDataFrame([(1, 0, 1, 2, 3, None)],
                               "patient_id int, adherent int, insurance_type_Medicaid int, expected_refills int, "
                               "age int, financial_burden double")
    mm = feat.model_matrix(df, "adherent", "patient_id")
    assert mm.columns == ["patient_id", "label", "insurance_type_Medicaid", "age", "financial_burden"]
    assert mm.first()["financial_burden"] == 0
    sub = feat.model_matrix(df, "adherent", "patient_id", substring=True)
    assert "insurance_type_Medicaid" not in sub.columns


def percentiles(df, cols, probs):
    row = df.agg(*[F.percentile(F.col(x).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(x) for x in cols]).first()
    return {x: [None] * len(probs) if row[x] is None else list(row[x]) for x in cols}


@pytest.mark.parametrize("finish", [quantiles.FINISH, 0, 3])
def test_radix_selection_equals_percentile(spark, monkeypatch, finish):
    """To the last bit, whether prefixes end by reading values or after 64 bits."""
    monkeypatch.setattr(quantiles, "FINISH", finish)
    rng = np.random.default_rng(2)
    wide = np.concatenate([rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, 1.7e308]])
    rows = [(float(w), None, int(i % 7), float(1 + i * 2.0**-52) if i % 3 else None, -float(i)) for i, w in enumerate(wide)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e float").repartition(5)
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1]
    assert quantiles.exact_quantiles(df, df.columns, probs) == percentiles(df, df.columns, probs)
    assert quantiles.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]} and quantiles.exact_quantiles(df, [], [0.5]) == {}


def test_infinities_and_nan_sort_last(spark):
    df = spark.createDataFrame([(float(x),) for x in ("nan", "inf", "-inf", "1", "2")], "a double")
    got = quantiles.exact_quantiles(df, ["a"], [0, 0.25, 0.5, 0.75, 1])["a"]
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and got[4] != got[4]


def test_fits_equal_percentile_and_mode(spark):
    from cohort_engine.sources import bindings
    from places import SF01
    c = bindings.cohort(spark, SF01)
    cols = ["age", "annual_contribution", "claim_amount", "expected_refills"]
    want = percentiles(c, cols, [0.25, 0.5, 0.75])
    f = clean.fit_fences(c, cols)
    assert f.q1 == {x: want[x][0] for x in cols} and f.q3 == {x: want[x][2] for x in cols}
    assert clean.fit_impute(c, cols, []).medians == {x: want[x][1] for x in cols}
    s = {r["column"]: r for r in profile.numeric_summary(c, cols, digits=None).collect()}
    assert {x: [s[x]["p25"], s[x]["p50"], s[x]["p75"]] for x in cols} == want


def test_mode_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.col("id").cast("string").alias("many"), F.when(F.col("id") % 2 == 0, "b").when(F.col("id") < 10, None)
                                       .otherwise("a").alias("few"), F.lit(None).cast("string").alias("none"))
    df = df.unionByName(spark.range(2).select(F.lit("77").alias("many"), F.lit("a").alias("few"), F.lit(None).cast("string").alias("none")))
    assert clean.modes(df, ["many", "few", "none"]) == {"many": "77", "few": "b", "none": None}
    tie = spark.createDataFrame([("y",), ("x",), ("x",), ("y",), (None,), (None,), (None,)], "t string")
    assert clean.modes(tie, ["t"]) == {"t": "x"}


def test_grouped_quantiles_equal_percentile(spark):
    from cohort_engine.sources import bindings
    from places import SF01
    f = feat.derive_features(bindings.cohort(spark, SF01))
    probs = [0.0, 0.25, 1 / 3, 0.5, 1.0]
    got = {(r["age_group"], r["col"]): (r["n"], r["q"]) for r in
           quantiles.grouped_quantiles(f, ["financial_burden", "age"], probs, ["age_group"]).collect()}
    for c in ("financial_burden", "age"):
        want = (f.groupBy("age_group").agg(F.count(c).alias("n"), F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias("q")))
        for r in want.collect():
            assert got[r["age_group"], c] == (r["n"], r["q"])


def test_no_value_map_in_the_fits():
    """No fit gathers a value map: ``percentile``, ``median`` and ``mode`` do."""
    import pathlib
    import re
    root = pathlib.Path(clean.__file__).parent.parent
    for sub in ("operators", "plans"):
        for path in (root / sub).glob("*.py"):
            assert not re.search(r"F\.(percentile|median|mode)\(", path.read_text()), path


def test_scoring_page_ratio_guard(spark):
    # scoring page: min(r / max(e, 1), 1) and min(claim / max(contribution, 1), 5)
    df = spark.createDataFrame([(0, 3, 100.0, 0.5), (4, 2, 100.0, 10.0), (2, 8, 60.0, -3.0)],
                               "expected_refills int, refills_received int, claim_amount double, "
                               "annual_contribution double")
    r = df.select(scalar.guarded_ratio("refills_received", "expected_refills", None, 1.0, "floor1").alias("r"),
                  feat.financial_burden(policy="floor1").alias("b")).collect()
    assert [x["r"] for x in r] == [1.0, 0.5, 1.0]
    assert [x["b"] for x in r] == [5.0, 5.0, 5.0]
