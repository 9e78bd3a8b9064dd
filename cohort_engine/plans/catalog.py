"""The registered queries (``queries()`` / ``oracle_sql()`` of the entry
module).  Each one reads the driver tables through the bindings, so its work
grows with the data; each has an independent SQL oracle where SQL can
express it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohort_engine.functions import scalar
from cohort_engine.operators import cart, clean, explain, irls, metrics, models, profile, reports, sampling, score, smote, stats
from cohort_engine.operators import features as feat
from cohort_engine.plans import bi, modeling, pipeline
from cohort_engine.plans.registry import register
from cohort_engine.plans.sqlbase import (
    BI,
    CLEANED,
    SCORES,
    CONDITION_LEVELS,
    COHORT,
    FEATURES,
    INSURANCE_LEVELS,
    OUTLIER_COLS,
    RFEAT,
    median_sql,
    mode_sql,
    with_,
)
from cohort_engine.session import cut_lineage, shared_path
from cohort_engine.sources import bindings


def metrics_cte():
    from cohort_engine.plans.sqlbase import CONFUSION
    return CONFUSION


def featured(spark, sf_dir):
    """Cohort with the six derived features (fixed buckets: the binding's
    values are in range by construction)."""
    return feat.derive_features(bindings.cohort(spark, sf_dir))


# --------------------------------------------------------------------------
# Minimum slice: one join, one CASE, one group-by.
# --------------------------------------------------------------------------

@register("rate_by_age_group", ids="A8", round6=("rate",), sql=with_(FEATURES, """
SELECT age_group, avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n
FROM features WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_rate_by_age_group(spark, sf_dir):
    return reports.rate_by(featured(spark, sf_dir), "adherent", "age_group")


@register("rate_by_complexity", ids="A8", round6=("rate",), sql=with_(FEATURES, """
SELECT medication_complexity, avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n
FROM features WHERE medication_complexity IS NOT NULL GROUP BY medication_complexity"""))
def q_rate_by_complexity(spark, sf_dir):
    return reports.rate_by(featured(spark, sf_dir), "adherent", "medication_complexity")


@register("rate_by_insurance", ids="A7", round6=("rate",), sql=with_(FEATURES, """
SELECT insurance_type, avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n
FROM features WHERE insurance_type IS NOT NULL GROUP BY insurance_type"""))
def q_rate_by_insurance(spark, sf_dir):
    return reports.rate_by(featured(spark, sf_dir), "adherent", "insurance_type")


@register("rate_by_condition", ids="A7", round6=("rate",), sql=with_(FEATURES, """
SELECT chronic_condition, avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n
FROM features WHERE chronic_condition IS NOT NULL GROUP BY chronic_condition"""))
def q_rate_by_condition(spark, sf_dir):
    return reports.rate_by(featured(spark, sf_dir), "adherent", "chronic_condition")


@register("rate_with_se", ids="A9,W1", round6=("rate", "se"), sql=with_(FEATURES, """
SELECT chronic_condition, avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n,
       stddev_samp(CAST(adherent AS DOUBLE)) / sqrt(count(adherent)) AS se
FROM features GROUP BY chronic_condition"""))
def q_rate_with_se(spark, sf_dir):
    # R keeps the null group.
    return reports.rate_by(featured(spark, sf_dir), "adherent", "chronic_condition", se=True,
                           drop_null_group=False)




# --------------------------------------------------------------------------
# Sources (S1) and cleaning
# --------------------------------------------------------------------------

@register("scan_cohort", ids="S1", sql=with_(COHORT, "SELECT * FROM cohort"))
def q_scan_cohort(spark, sf_dir):
    return bindings.cohort(spark, sf_dir)


@register("impute_median", ids="C1", round6=("annual_contribution", "claim_amount"), sql=with_(COHORT, f"""
SELECT patient_id,
       coalesce(annual_contribution, {median_sql('annual_contribution')}) AS annual_contribution,
       coalesce(claim_amount, {median_sql('claim_amount')}) AS claim_amount
FROM cohort"""))
def q_impute_median(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir)
    params = clean.fit_impute(raw, num_cols=["annual_contribution", "claim_amount"], cat_cols=[])
    return clean.impute(raw, params).select("patient_id", "annual_contribution", "claim_amount")


@register("impute_mode", ids="C2", sql=with_(COHORT, f"""
SELECT patient_id, coalesce(gender, {mode_sql('gender')}) AS gender,
       coalesce(insurance_type, {mode_sql('insurance_type')}) AS insurance_type,
       coalesce(chronic_condition, {mode_sql('chronic_condition')}) AS chronic_condition
FROM cohort"""))
def q_impute_mode(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir)
    params = clean.fit_impute(raw, num_cols=[], cat_cols=["gender", "insurance_type", "chronic_condition"])
    return clean.impute(raw, params).select("patient_id", "gender", "insurance_type", "chronic_condition")


@register("null_total", ids="C3", sql=with_(CLEANED, """
SELECT CAST(sum(CASE WHEN annual_contribution IS NULL THEN 1 ELSE 0 END)
          + sum(CASE WHEN claim_amount IS NULL THEN 1 ELSE 0 END)
          + sum(CASE WHEN chronic_condition IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_total
FROM imputed"""))
def q_null_total(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir)
    x = clean.impute(raw, clean.fit_impute(raw, exclude=("patient_id", "adherent")))
    return clean.null_total(x)


@register("dedup_rows", ids="C4", sql=with_(COHORT, """
SELECT CAST(count(*) AS BIGINT) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (patient_id) FROM cohort)) AS rows_after,
       CAST(count(*) AS BIGINT) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (patient_id) FROM cohort))
         AS removed
FROM cohort"""))
def q_dedup_rows(spark, sf_dir):
    # A unique key makes full-row dedup a no-op (Q5), so the report uses the
    # row without its key.
    raw = bindings.cohort(spark, sf_dir)
    return clean.dedup_report(raw, [c for c in raw.columns if c != "patient_id"])


_UNPIVOT_FENCES = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", q[1] AS q1, q[2] AS q3, q[1] - 1.5 * (q[2] - q[1]) AS lower, "
    f"q[2] + 1.5 * (q[2] - q[1]) AS upper FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q "
    f"FROM cohort)" for c in OUTLIER_COLS)


@register("iqr_fences", ids="C5", round6=("q1", "q3", "lower", "upper"), sql=with_(COHORT, _UNPIVOT_FENCES))
def q_iqr_fences(spark, sf_dir):
    return clean.fences_frame(bindings.cohort(spark, sf_dir), clean.OUTLIER_COLS)


_OUTLIERS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers "
    f"FROM cohort, (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM "
    f"(SELECT quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q FROM cohort))" for c in OUTLIER_COLS)


@register("iqr_outlier_counts", ids="C6", sql=with_(COHORT, _OUTLIERS))
def q_iqr_outlier_counts(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir)
    return clean.outlier_counts(raw, clean.fit_fences(raw))


@register("iqr_cap", ids="C7", round6=OUTLIER_COLS, sql=with_(CLEANED, f"""
SELECT patient_id, {", ".join(OUTLIER_COLS)} FROM capped"""))
def q_iqr_cap(spark, sf_dir):
    # the cohort feeds two fits and the output: written once, read three times
    raw = cut_lineage(bindings.cohort(spark, sf_dir))
    x = clean.impute(raw, clean.fit_impute(raw, exclude=("patient_id", "adherent")))
    return clean.cap(x, clean.fit_fences(x)).select("patient_id", *OUTLIER_COLS)


@register("label_encode", ids="C8", sql=with_(COHORT, """
SELECT patient_id, CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender_encoded FROM cohort"""))
def q_label_encode(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir).select("patient_id", "gender")
    return clean.encode(raw, clean.fit_encoder(raw, label_cols=["gender"]))


_ONEHOT_SQL = ",\n       ".join(
    [f"CAST(coalesce(insurance_type = '{v}', false) AS INTEGER) AS \"insurance_type_{v}\""
     for v in INSURANCE_LEVELS[1:]] +
    [f"CAST(coalesce(chronic_condition = '{v}', false) AS INTEGER) AS \"chronic_condition_{v}\""
     for v in CONDITION_LEVELS[1:]])


@register("one_hot", ids="C9", sql=with_(COHORT, f"SELECT patient_id, {_ONEHOT_SQL} FROM cohort"))
def q_one_hot(spark, sf_dir):
    # Nulls are kept (not imputed) so the null -> all-zeros rule is exercised.
    raw = bindings.cohort(spark, sf_dir).select("patient_id", "insurance_type", "chronic_condition")
    return clean.encode(raw, clean.fit_encoder(raw, onehot_cols=["insurance_type", "chronic_condition"]))


_STD_COLS = ("age", "annual_contribution", "claim_amount", "days_supply", "num_medications")


@register("standardize", ids="C10", round6=_STD_COLS, sql=with_(COHORT, "SELECT patient_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM cohort)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
    f"ELSE stddev_pop({c}) END FROM cohort) AS {c}" for c in _STD_COLS) + " FROM cohort"))
def q_standardize(spark, sf_dir):
    raw = bindings.cohort(spark, sf_dir)
    return clean.scale(raw, clean.fit_scaler(raw, list(_STD_COLS))).select("patient_id", *_STD_COLS)


_SCALE_CAND = ("age", "annual_contribution", "claim_amount", "expected_refills", "refills_received",
               "days_supply", "num_medications", "adherent")


@register("scale_columns", ids="P5", sql=with_(COHORT, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 2 AS scaled "
    f"FROM cohort" for c in _SCALE_CAND)))
def q_scale_columns(spark, sf_dir):
    found = profile.distinct_counts(bindings.cohort(spark, sf_dir), _SCALE_CAND)
    return found.select("column", "n_distinct", (F.col("n_distinct") > 2).alias("scaled"))


@register("burden_complete", ids="P7", sql=with_(COHORT, """
SELECT * FROM cohort WHERE claim_amount IS NOT NULL AND annual_contribution IS NOT NULL"""))
def q_burden_complete(spark, sf_dir):
    return bindings.cohort(spark, sf_dir).dropna(subset=["claim_amount", "annual_contribution"])


# --------------------------------------------------------------------------
# Features (F1-F14) and assembly
# --------------------------------------------------------------------------

@register("refill_ratio", ids="F1", round6=("refill_ratio",), sql=with_(FEATURES,
          "SELECT patient_id, refill_ratio FROM features"))
def q_refill_ratio(spark, sf_dir):
    return featured(spark, sf_dir).select("patient_id", "refill_ratio")


@register("financial_burden", ids="F2", round6=("financial_burden", "burden_r", "burden_dash", "burden_page"),
          sql=with_(FEATURES, """
SELECT patient_id, financial_burden,
       CASE WHEN claim_amount / CASE WHEN annual_contribution < 1 THEN 1.0 ELSE annual_contribution END > 5
            THEN 5.0 ELSE claim_amount / CASE WHEN annual_contribution < 1 THEN 1.0 ELSE annual_contribution END
       END AS burden_page,
       CASE WHEN annual_contribution IS NOT NULL AND annual_contribution > 0
            THEN claim_amount / annual_contribution END AS burden_r,
       CASE WHEN claim_amount IS NULL OR annual_contribution IS NULL THEN NULL
            WHEN annual_contribution = 0 THEN CASE WHEN claim_amount > 0 THEN 5.0 WHEN claim_amount < 0 THEN 0.0 END
            WHEN claim_amount / annual_contribution < 0 THEN 0.0
            WHEN claim_amount / annual_contribution > 5 THEN 5.0
            ELSE claim_amount / annual_contribution END AS burden_dash
FROM features"""))
def q_financial_burden(spark, sf_dir):
    df = featured(spark, sf_dir)
    return df.select("patient_id", "financial_burden",
                     feat.financial_burden(policy="floor1").alias("burden_page"),
                     feat.financial_burden(policy="null", cap=None).alias("burden_r"),
                     feat.financial_burden(policy="drop").alias("burden_dash"))


@register("age_group", ids="F4", sql=with_(FEATURES, "SELECT patient_id, age, age_group FROM features"))
def q_age_group(spark, sf_dir):
    return featured(spark, sf_dir).select("patient_id", "age", "age_group")


@register("medication_complexity", ids="F5", sql=with_(FEATURES,
          "SELECT patient_id, num_medications, medication_complexity FROM features"))
def q_medication_complexity(spark, sf_dir):
    return featured(spark, sf_dir).select("patient_id", "num_medications", "medication_complexity")


@register("supply_category", ids="F6", sql=with_(FEATURES,
          "SELECT patient_id, days_supply, supply_category FROM features"))
def q_supply_category(spark, sf_dir):
    return featured(spark, sf_dir).select("patient_id", "days_supply", "supply_category")


@register("refill_gap", ids="F3", sql=with_(FEATURES, "SELECT patient_id, refill_gap FROM features"))
def q_refill_gap(spark, sf_dir):
    return featured(spark, sf_dir).select("patient_id", "refill_gap")


@register("quantile_buckets", ids="F7", sql=with_(COHORT, """
, e AS (SELECT quantile_cont(claim_amount, [0.0, 1.0/3, 2.0/3, 1.0]) AS q FROM cohort)
SELECT patient_id,
       CASE WHEN claim_amount < q[1] THEN NULL WHEN claim_amount <= q[2] THEN 0
            WHEN claim_amount <= q[3] THEN 1 WHEN claim_amount <= q[4] THEN 2 END AS claim_bucket,
       CASE WHEN age <= 35 THEN 0 WHEN age <= 64 THEN 1 WHEN age IS NOT NULL THEN 2 END AS age_group
FROM cohort, e""".replace("\n, e AS", ", e AS", 1)))
def q_quantile_buckets(spark, sf_dir):
    # The F7 switch: age is fully in range -> fixed buckets; claim_amount is
    # checked against an unreachable range (nulls also count as outside) ->
    # 3-quantile buckets.
    raw = bindings.cohort(spark, sf_dir)
    rules = feat.fit_bucket_rules(raw, {"age": (0, 120), "claim_amount": (0, 1)})
    claim = feat.quantile_bucket("claim_amount", rules["claim_amount"].edges) \
        if not rules["claim_amount"].fixed else F.lit(None)
    age = feat.age_group() if rules["age"].fixed else feat.quantile_bucket("age", rules["age"].edges)
    return raw.select("patient_id", claim.alias("claim_bucket"), age.alias("age_group"))


_FM_DOUBLE = ("age", "annual_contribution", "claim_amount", "expected_refills", "refills_received",
              "num_medications", "refill_ratio", "financial_burden")


@register("feature_matrix", ids="F8,W8,W9,P1,C1-C9", round6=_FM_DOUBLE,
          sql=with_(CLEANED, "SELECT * FROM feature_matrix"))
def q_feature_matrix(spark, sf_dir):
    return pipeline.feature_table(bindings.cohort(spark, sf_dir))


@register("model_matrix", ids="P1-P3,P6", round6=("age", "annual_contribution", "claim_amount",
                                                  "num_medications", "refill_ratio", "financial_burden"),
          sql=with_(CLEANED, """
SELECT patient_id, adherent AS label,
       * EXCLUDE (patient_id, adherent, expected_refills, refills_received, financial_burden),
       coalesce(financial_burden, 0.0) AS financial_burden
FROM feature_matrix"""))
def q_model_matrix(spark, sf_dir):
    return pipeline.model_input(bindings.cohort(spark, sf_dir))


@register("indicators", ids="F9", sql=with_(COHORT, """
SELECT *, CAST(gender = 'Male' AS INTEGER) AS gender_male, CAST(age >= 65 AS INTEGER) AS elderly,
       CAST(days_supply = 90 AS INTEGER) AS long_supply, CAST(num_medications >= 5 AS INTEGER) AS high_med
FROM cohort"""))
def q_indicators(spark, sf_dir):
    return feat.indicators(bindings.cohort(spark, sf_dir))


@register("factor_rules", ids="F12", sql=with_(FEATURES, """
SELECT patient_id, factor_rank, factor, value, impact FROM (
  SELECT patient_id, 1 AS factor_rank, 'Refill Ratio' AS factor, printf('%.2f', round(refill_ratio, 2)) AS value,
         CASE WHEN refill_ratio > 0.75 THEN 'High ↑' ELSE 'Risk ↓' END AS impact FROM features
  UNION ALL
  SELECT patient_id, 2, 'Financial Burden', printf('%.2f', round(financial_burden, 2)),
         CASE WHEN financial_burden > 0.6 THEN 'Risk ↑' ELSE 'Low ↓' END FROM features
  UNION ALL
  SELECT patient_id, 3, 'Age Group', ['Young', 'Adult', 'Elderly'][age_group + 1],
         CASE WHEN age_group = 1 THEN 'Moderate' ELSE 'At Risk' END FROM features
  UNION ALL
  SELECT patient_id, 4, 'Medication Complexity', ['Low', 'Medium', 'High'][medication_complexity + 1],
         CASE WHEN medication_complexity = 0 THEN 'Low' WHEN medication_complexity = 1 THEN 'Medium'
              ELSE 'High Risk ↑' END FROM features
  UNION ALL
  SELECT patient_id, 5, 'Supply Category', ['Short(30d)', 'Medium(60d)', 'Long(90d)'][supply_category + 1],
         CASE WHEN supply_category = 2 THEN 'Positive ↑' ELSE 'Neutral' END FROM features
  UNION ALL
  SELECT patient_id, 6, 'Refill Gap', CAST(refill_gap AS VARCHAR),
         CASE WHEN refill_gap = 0 THEN 'Good ✓' ELSE printf('Gap of %d ↓', refill_gap) END FROM features
) t"""))
def q_factor_rules(spark, sf_dir):
    return feat.factor_rules(featured(spark, sf_dir))


@register("safe_parse", ids="F14", round6=("total_price",), sql="""
SELECT o_orderkey,
       coalesce(TRY_CAST(trim(CAST(o_totalprice AS VARCHAR)) AS DOUBLE), 0.0) AS total_price,
       CASE WHEN isfinite(TRY_CAST(trim(CAST(o_totalprice AS VARCHAR)) AS DOUBLE))
            THEN CAST(trunc(TRY_CAST(trim(CAST(o_totalprice AS VARCHAR)) AS DOUBLE)) AS BIGINT) ELSE 0 END AS price_int,
       CASE WHEN isfinite(TRY_CAST(trim(o_orderpriority) AS DOUBLE))
            THEN CAST(trunc(TRY_CAST(trim(o_orderpriority) AS DOUBLE)) AS BIGINT) ELSE 0 END AS priority_int,
       CASE WHEN isfinite(TRY_CAST(trim(substr(o_orderpriority, 1, 1)) AS DOUBLE))
            THEN CAST(trunc(TRY_CAST(trim(substr(o_orderpriority, 1, 1)) AS DOUBLE)) AS BIGINT) ELSE 0 END
            AS priority_code
FROM orders""")
def q_safe_parse(spark, sf_dir):
    o = bindings.table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    txt = F.col("o_totalprice").cast("string")
    return o.select("o_orderkey", scalar.safe_number(txt, 0.0).alias("total_price"),
                    scalar.safe_number(txt, 0, integer=True).alias("price_int"),
                    scalar.safe_number("o_orderpriority", 0, integer=True).alias("priority_int"),
                    scalar.safe_number(F.substring("o_orderpriority", 1, 1), 0, integer=True).alias("priority_code"))


# --------------------------------------------------------------------------
# Profiling
# --------------------------------------------------------------------------

_DTYPES = {"patient_id": "bigint", "age": "int", "gender": "string", "insurance_type": "string",
           "annual_contribution": "double", "claim_amount": "double", "expected_refills": "bigint",
           "refills_received": "bigint", "days_supply": "int", "chronic_condition": "string",
           "num_medications": "int", "adherent": "int"}


@register("profile_columns", ids="A1,A2", sql=with_(COHORT, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct, "
    f"{i} AS ordinal FROM cohort" for i, (c, t) in enumerate(_DTYPES.items()))))
def q_profile_columns(spark, sf_dir):
    return profile.profile_columns(bindings.cohort(spark, sf_dir))


@register("missing_report", ids="A3", sql=with_(COHORT, "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM cohort" for c in _DTYPES)
    + ") WHERE missing > 0"))
def q_missing_report(spark, sf_dir):
    return profile.missing_report(bindings.cohort(spark, sf_dir))


_NUM = [c for c, t in _DTYPES.items() if t != "string"]


@register("numeric_summary", ids="A4", sql=with_(COHORT, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, "
    f"round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS p50, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS p75, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM cohort"
    for c in _NUM)))
def q_numeric_summary(spark, sf_dir):
    return profile.numeric_summary(bindings.cohort(spark, sf_dir), _NUM, digits=2)


@register("value_counts", ids="A5", sql=with_(COHORT, """
SELECT insurance_type, count(*) AS n FROM cohort WHERE insurance_type IS NOT NULL GROUP BY insurance_type"""))
def q_value_counts(spark, sf_dir):
    return profile.value_counts(bindings.cohort(spark, sf_dir), "insurance_type")


@register("cohort_kpis", ids="A6", round6=("rate",), sql=with_(COHORT, """
SELECT count(*) AS total, CAST(sum(CASE WHEN adherent = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(sum(CASE WHEN adherent = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
       avg(CAST(adherent AS DOUBLE)) AS rate FROM cohort"""))
def q_cohort_kpis(spark, sf_dir):
    return reports.cohort_kpis(bindings.cohort(spark, sf_dir), "adherent")


def _hist_sql(value, by, bins, src, shared=True):
    if shared:
        rng = f"(SELECT min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi FROM {src} " \
              f"WHERE {value} IS NOT NULL) r"
        join = f"FROM {src} s, {rng}"
    else:
        rng = f"(SELECT {by} AS rk, min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi " \
              f"FROM {src} WHERE {value} IS NOT NULL GROUP BY {by}) r"
        join = f"FROM {src} s JOIN {rng} ON s.{by} = r.rk"
    b = (f"CAST(CASE WHEN hi > lo THEN least(floor((CAST(s.{value} AS DOUBLE) - lo) / (hi - lo) * {float(bins)}), "
         f"{bins - 1}) ELSE 0 END AS INTEGER)")
    return f"""
SELECT {by}, bin, lo + bin * ((hi - lo) / {float(bins)}) AS lo_edge, lo + (bin + 1) * ((hi - lo) / {float(bins)}) AS hi_edge,
       count(*) AS n
FROM (SELECT s.{by}, lo, hi, {b} AS bin {join} WHERE s.{value} IS NOT NULL) t
GROUP BY {by}, bin, lo, hi"""


@register("ratio_histogram", ids="A11,A12", round6=("lo_edge", "hi_edge"),
          sql=with_(FEATURES, _hist_sql("refill_ratio", "adherent", 20, "features")))
def q_ratio_histogram(spark, sf_dir):
    return profile.histogram(featured(spark, sf_dir), "refill_ratio", 20, by="adherent")


@register("age_histogram", ids="A12", round6=("lo_edge", "hi_edge"),
          sql=with_(FEATURES, _hist_sql("age", "adherent", 15, "features", shared=False)))
def q_age_histogram(spark, sf_dir):
    return profile.histogram(featured(spark, sf_dir), "age", 15, by="adherent", range_mode="per_group")


@register("box_stats", ids="A13", round6=("q1", "median", "q3", "whisker_low", "whisker_high"),
          sql=with_(FEATURES, """
, q AS (SELECT age_group, count(*) AS n, quantile_cont(financial_burden, 0.25) AS q1,
              quantile_cont(financial_burden, 0.5) AS median, quantile_cont(financial_burden, 0.75) AS q3
       FROM features WHERE financial_burden IS NOT NULL GROUP BY age_group)
SELECT q.age_group, n, q1, median, q3,
       min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
       max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
       CAST(sum(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
         AS outliers
FROM (SELECT age_group, financial_burden AS x FROM features WHERE financial_burden IS NOT NULL) f
JOIN q ON f.age_group = q.age_group
GROUP BY q.age_group, n, q1, median, q3""".replace("\n, q AS", ", q AS", 1)))
def q_box_stats(spark, sf_dir):
    return profile.box_stats(featured(spark, sf_dir), "financial_burden", "age_group")


@register("scatter_sample", ids="A14", sql=with_(FEATURES, """
SELECT patient_id, annual_contribution, claim_amount, adherent FROM features
WHERE claim_amount IS NOT NULL AND annual_contribution IS NOT NULL AND financial_burden < 4
ORDER BY md5('42|' || CAST(patient_id AS VARCHAR)) LIMIT 500"""))
def q_scatter_sample(spark, sf_dir):
    df = featured(spark, sf_dir).dropna(subset=["claim_amount", "annual_contribution"])
    df = df.filter(F.col("financial_burden") < 4)
    # Deterministic seeded sample: a top-n by a hash of (seed, key) — the
    # limit is the feature (at most n points), not a cost cap.
    return (df.orderBy(F.md5(F.concat(F.lit("42|"), F.col("patient_id").cast("string"))))
            .limit(500).select("patient_id", "annual_contribution", "claim_amount", "adherent"))


@register("feature_means", ids="A19", round6=("mean",), sql=with_(FEATURES, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean FROM features" for c in feat.FEATURE_COLS)))
def q_feature_means(spark, sf_dir):
    return reports.feature_means(featured(spark, sf_dir), feat.FEATURE_COLS)


# --------------------------------------------------------------------------
# Classification metrics (K1-K11) on the long score table
# --------------------------------------------------------------------------

def scores(spark, sf_dir):
    return bindings.score_table(spark, sf_dir)


_CM = ("accuracy", "precision", "recall", "at_risk_recall", "f1_score")


@register("class_metrics", ids="K1,K2,K3", round6=_CM, sql=with_(SCORES + "," + metrics_cte(),
          "SELECT model, accuracy, precision, recall, at_risk_recall, f1_score FROM cm2"))
def q_class_metrics(spark, sf_dir):
    return metrics.class_metrics(scores(spark, sf_dir))


@register("roc_auc", ids="K4", round6=("roc_auc",), sql=with_(SCORES + "," + metrics_cte(),
          "SELECT model, roc_auc FROM auc"))
def q_roc_auc(spark, sf_dir):
    return metrics.roc_auc(scores(spark, sf_dir))


@register("pr_auc_at_risk", ids="K5", round6=("pr_auc_at_risk",), sql=with_(SCORES + "," + metrics_cte(),
          "SELECT model, pr_auc_at_risk FROM ap"))
def q_pr_auc_at_risk(spark, sf_dir):
    return metrics.average_precision(scores(spark, sf_dir), positive=0)


@register("confusion_matrix", ids="K6", sql=with_(SCORES + "," + metrics_cte(),
          "SELECT model, tn, fp, fn, tp FROM conf"))
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion(scores(spark, sf_dir))


@register("class_report", ids="K7", round6=("precision", "recall", "f1_score"),
          sql=with_(SCORES + "," + metrics_cte(), """
, pr AS (
  SELECT model, tn, fp, fn, tp,
    coalesce(CAST(tn AS DOUBLE) / nullif(CAST(tn + fn AS DOUBLE), 0), 0.0) AS p0,
    coalesce(CAST(tn AS DOUBLE) / nullif(CAST(tn + fp AS DOUBLE), 0), 0.0) AS r0,
    coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS p1,
    coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS r1
  FROM conf
), f AS (
  SELECT *, CASE WHEN p0 + r0 > 0 THEN 2.0 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
            CASE WHEN p1 + r1 > 0 THEN 2.0 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
            tn + fp AS s0, tp + fn AS s1 FROM pr
)
SELECT model, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
UNION ALL SELECT model, '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / CAST(s0 + s1 AS DOUBLE),
       (r0 * s0 + r1 * s1) / CAST(s0 + s1 AS DOUBLE), (f0 * s0 + f1 * s1) / CAST(s0 + s1 AS DOUBLE), s0 + s1 FROM f
""".replace("\n, pr AS", ", pr AS", 1)))
def q_class_report(spark, sf_dir):
    return metrics.class_report(scores(spark, sf_dir))


@register("roc_curve", ids="K8", round6=("fpr", "tpr"), sql=with_(SCORES, """
, d AS (SELECT model, p AS s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
        FROM scored GROUP BY model, p),
c AS (
  SELECT model, s, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
         lead(pos) OVER w2 AS next_pos, lead(neg) OVER w2 AS next_neg, row_number() OVER w2 AS rn
  FROM d
  WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY model ORDER BY s DESC)
),
t AS (SELECT model, sum(pos) AS tp_all, sum(neg) AS tn_all FROM d GROUP BY model)
SELECT c.model, s AS threshold,
       coalesce(CAST(cum_neg AS DOUBLE) / nullif(CAST(tn_all AS DOUBLE), 0), 0.0) AS fpr,
       coalesce(CAST(cum_pos AS DOUBLE) / nullif(CAST(tp_all AS DOUBLE), 0), 0.0) AS tpr
FROM c JOIN t ON c.model = t.model
WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL
SELECT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM t""".replace("\n, d AS", ", d AS", 1)))
def q_roc_curve(spark, sf_dir):
    return metrics.roc_points(scores(spark, sf_dir))


@register("pr_curve", ids="K9", round6=("threshold", "precision", "recall"), sql=with_(SCORES, """
, d AS (SELECT model, 1.0::DOUBLE - p AS s, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN y = 0 THEN 0 ELSE 1 END) AS BIGINT) AS neg
        FROM scored GROUP BY model, 1.0::DOUBLE - p),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM d
      WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT model, sum(pos) AS pa FROM d GROUP BY model)
SELECT c.model, s AS threshold, coalesce(CAST(cp AS DOUBLE) / nullif(CAST(cp + cn AS DOUBLE), 0), 0.0) AS precision,
       CASE WHEN pa = 0 THEN 1.0 ELSE cp / CAST(pa AS DOUBLE) END AS recall
FROM c JOIN t ON c.model = t.model
UNION ALL SELECT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM t""".replace("\n, d AS", ", d AS", 1)))
def q_pr_curve(spark, sf_dir):
    return metrics.pr_points(scores(spark, sf_dir), positive=0)


@register("pr_baseline", ids="K10", round6=("baseline",), sql=with_(SCORES, """
SELECT model, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS baseline FROM scored GROUP BY model"""))
def q_pr_baseline(spark, sf_dir):
    return metrics.prevalence(scores(spark, sf_dir), positive=0)


@register("model_metrics", ids="K11,B10", sql=with_(SCORES + "," + metrics_cte(), "SELECT * FROM model_metrics"))
def q_model_metrics(spark, sf_dir):
    return metrics.model_metrics(scores(spark, sf_dir))


@register("best_model", ids="A15,M12", sql=with_(SCORES + "," + metrics_cte(), """
SELECT max(roc_auc) AS best_roc_auc, (SELECT model FROM model_metrics ORDER BY roc_auc DESC, model LIMIT 1)
       AS best_model FROM model_metrics"""))
def q_best_model(spark, sf_dir):
    return reports.best_by(bi.model_metrics_table(spark, sf_dir), "model", "roc_auc")


@register("metrics_long", ids="A18,B10", sql=with_(SCORES + "," + metrics_cte(), """
UNPIVOT model_metrics ON accuracy, precision, recall, at_risk_recall, f1_score, roc_auc, pr_auc_at_risk
INTO NAME metric VALUE value"""))
def q_metrics_long(spark, sf_dir):
    return reports.metrics_long(bi.model_metrics_table(spark, sf_dir), "model",
                                ["accuracy", "precision", "recall", "at_risk_recall", "f1_score", "roc_auc",
                                 "pr_auc_at_risk"])


# --------------------------------------------------------------------------
# Export and BI panels
# --------------------------------------------------------------------------

@register("predictions_export", ids="S10,M13,F10,P14", sql=with_(BI, "SELECT * FROM final_predictions"))
def q_predictions_export(spark, sf_dir):
    return bi.final_predictions(spark, sf_dir)


@register("confidence_bands", ids="F10,F11", sql=with_(SCORES, """
SELECT model, patient_id, p,
       CASE WHEN p > 0.75 OR p < 0.25 THEN 'High' WHEN p > 0.60 OR p < 0.40 THEN 'Medium' ELSE 'Low' END AS confidence,
       CAST(p >= 0.5 AS INTEGER) AS decision, 1.0::DOUBLE - p AS risk
FROM scored"""))
def q_confidence_bands(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("model", "patient_id", "p", scalar.confidence_band("p").alias("confidence"),
                    (F.col("p") >= 0.5).cast("int").alias("decision"), (F.lit(1.0) - F.col("p")).alias("risk"))


@register("bi_cohort", ids="S11,P14", sql=with_(BI, "SELECT * FROM tableau_output"))
def q_bi_cohort(spark, sf_dir):
    return bi.tableau_output(spark, sf_dir)


# Oracle SQL of the panels, written from their meaning (sums and counts).
_PANEL_SQL = {
    "bi_total": "SELECT count(patient_id) AS value FROM final_predictions",
    "bi_rate": "SELECT round(CAST(sum(actual_adherence) AS DOUBLE) * 100 / count(*), 2) AS value FROM final_predictions",
    "bi_accuracy": "SELECT round(CAST(count(*) FILTER (correct_prediction = 1) AS DOUBLE) * 100 / count(*), 2) AS value "
                   "FROM final_predictions",
    "bi_best_auc": "SELECT round(roc_auc, 4) AS value FROM model_metrics ORDER BY roc_auc DESC LIMIT 1",
    "bi_rate_by_age": "SELECT age_group_label AS group_name, round(CAST(sum(adherent) AS DOUBLE) * 100 / count(adherent), 2) "
                      "AS adherence_rate FROM tableau_output GROUP BY 1",
    "bi_rate_by_insurance": "SELECT insurance_type, round(CAST(sum(adherent) AS DOUBLE) * 100 / count(adherent), 2) "
                            "AS adherence_rate FROM tableau_output GROUP BY 1",
    "confidence_distribution": "SELECT confidence, count(patient_id) AS patients FROM final_predictions GROUP BY 1",
    "bi_metrics_table": "SELECT model, round(accuracy * 100, 2) AS accuracy_pct, precision, recall, f1_score, roc_auc "
                        "FROM model_metrics",
}


for _name, _build in bi.PANELS.items():
    register(_name, ids="B", sql=with_(BI, _PANEL_SQL[_name]))(_build)


@register("confusion_components", ids="B8,W6,K6", sql=with_(BI, """
SELECT c.metric, count(f.patient_id) AS value
FROM (VALUES ('TP', 1, 1), ('TN', 0, 0), ('FP', 0, 1), ('FN', 1, 0)) AS c(metric, y, y_hat)
LEFT JOIN final_predictions f ON f.actual_adherence = c.y AND f.predicted_adherence = c.y_hat
GROUP BY c.metric"""))
def q_confusion_components(spark, sf_dir):
    # One conditional aggregate + unpivot instead of four scans.
    fp = bi.final_predictions(spark, sf_dir).select(
        F.lit("fp").alias("model"), F.col("actual_adherence").alias("y"), F.col("predicted_adherence").alias("y_hat"))
    c = metrics.confusion(fp)
    return c.select(F.col("tp").alias("TP"), F.col("tn").alias("TN"), F.col("fp").alias("FP"),
                    F.col("fn").alias("FN")).unpivot([], ["TP", "TN", "FP", "FN"], "metric", "value")


_BROWSE_SQL = """SELECT * FROM final_predictions
WHERE prediction_label IN ('Adherent') AND confidence IN ('High', 'Medium') AND correct_prediction = 1"""


@register("browse_predictions", ids="P10", sql=with_(BI, _BROWSE_SQL))
def q_browse_predictions(spark, sf_dir):
    return reports.browse(bi.final_predictions(spark, sf_dir), labels=["Adherent"], bands=["High", "Medium"],
                          correct="correct")


@register("browse_kpis", ids="A16", round6=("accuracy", "mean_probability"), sql=with_(BI, """
SELECT count(*) AS rows, avg(CAST(correct_prediction AS DOUBLE)) AS accuracy,
       avg(adherence_probability) AS mean_probability, CAST(sum(correct_prediction) AS BIGINT) AS correct
FROM final_predictions WHERE confidence IN ('High', 'Medium')"""))
def q_browse_kpis(spark, sf_dir):
    return reports.browse_kpis(reports.browse(bi.final_predictions(spark, sf_dir), bands=["High", "Medium"]))


@register("report_kpis", ids="A17", round6=("adherence_rate", "accuracy"), sql=with_(BI, """
SELECT count(*) AS total,
       100.0 * coalesce(sum(actual_adherence), 0) / greatest(count(*), 1) AS adherence_rate,
       100.0 * coalesce(sum(correct_prediction), 0) / greatest(count(*), 1) AS accuracy
FROM final_predictions"""))
def q_report_kpis(spark, sf_dir):
    return reports.report_kpis(bi.final_predictions(spark, sf_dir))


@register("distinct_bands", ids="P16", sql=with_(BI, "SELECT DISTINCT confidence FROM final_predictions"))
def q_distinct_bands(spark, sf_dir):
    return reports.distinct_values(bi.final_predictions(spark, sf_dir), "confidence")


@register("prob_histogram", ids="A12", round6=("lo_edge", "hi_edge"),
          sql=with_(BI, _hist_sql("adherence_probability", "actual_adherence", 20, "final_predictions")))
def q_prob_histogram(spark, sf_dir):
    return profile.histogram(bi.final_predictions(spark, sf_dir), "adherence_probability", 20,
                             by="actual_adherence")


# --------------------------------------------------------------------------
# Grouped reports
# --------------------------------------------------------------------------

@register("summary_by_label", ids="A10", sql=with_(COHORT, """
SELECT CASE WHEN adherent = 1 THEN 'Adherent' ELSE 'Non-Adherent' END AS adherence_label, count(*) AS n,
       round(avg(age), 1) AS mean_age,
       round(avg(CASE WHEN expected_refills > 0 THEN CAST(refills_received AS DOUBLE) / expected_refills ELSE 0.0 END), 3)
         AS mean_refill_ratio,
       round(avg(claim_amount), 2) AS mean_claim_amount,
       round(avg(CASE WHEN annual_contribution IS NOT NULL AND annual_contribution > 0
                      THEN claim_amount / annual_contribution END), 3) AS mean_financial_burden,
       round(avg(num_medications), 1) AS mean_num_medications
FROM cohort GROUP BY 1"""))
def q_summary_by_label(spark, sf_dir):
    c = bindings.cohort(spark, sf_dir)
    r = c.select(scalar.code_label("adherent", {0: "Non-Adherent", 1: "Adherent"}).alias("adherence_label"), "age",
                 scalar.guarded_ratio("refills_received", "expected_refills", null_policy="zero")
                 .alias("refill_ratio"),
                 "claim_amount", feat.financial_burden(policy="null", cap=None).alias("financial_burden"),
                 "num_medications")
    return reports.summary_by(r, "adherence_label", {"age": 1, "refill_ratio": 3, "claim_amount": 2,
                                                     "financial_burden": 3, "num_medications": 1})


@register("class_share", ids="A20,A5", round6=("share",), sql=with_(COHORT, """
SELECT adherent, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM cohort GROUP BY adherent"""))
def q_class_share(spark, sf_dir):
    return reports.class_share(bindings.cohort(spark, sf_dir), "adherent")


@register("share_by_age_group", ids="W5", round6=("pct",), sql=with_(FEATURES, """
SELECT age_group, adherent, count(*) AS n,
       count(*) / CAST(sum(count(*)) OVER (PARTITION BY age_group) AS DOUBLE) AS pct
FROM features GROUP BY age_group, adherent"""))
def q_share_by_age_group(spark, sf_dir):
    return reports.share_within(featured(spark, sf_dir), "age_group", "adherent")


@register("share_by_supply", ids="W5", round6=("pct",), sql=with_(COHORT, """
SELECT days_supply, adherent, count(*) AS n,
       count(*) / CAST(sum(count(*)) OVER (PARTITION BY days_supply) AS DOUBLE) AS pct
FROM cohort GROUP BY days_supply, adherent"""))
def q_share_by_supply(spark, sf_dir):
    return reports.share_within(bindings.cohort(spark, sf_dir), "days_supply", "adherent")


@register("head_n", ids="P13", sql=with_(COHORT, "SELECT * FROM cohort ORDER BY patient_id LIMIT 5"))
def q_head_n(spark, sf_dir):
    return reports.head_n(bindings.cohort(spark, sf_dir), 5, "patient_id")


# --------------------------------------------------------------------------
# Statistical tests and association (ST1-ST12)
# --------------------------------------------------------------------------

def r_features(spark, sf_dir):
    """Cohort with the statistics-script feature forms (burden null when the
    contribution is null or <= 0, no cap) and the adherence label."""
    f = featured(spark, sf_dir)
    return f.withColumns({
        "burden_r": feat.financial_burden(policy="null", cap=None),
        "adherence_label": scalar.code_label("adherent", {0: "Non-Adherent", 1: "Adherent"})})


_WELCH_SQL = with_(RFEAT, """
, long AS (
  SELECT adherent, 'refill_ratio' AS measure, refill_ratio AS x FROM rfeat
  UNION ALL SELECT adherent, 'financial_burden', burden_r FROM rfeat
), m AS (
  SELECT measure,
    count(x) FILTER (WHERE adherent = 1) AS n1, avg(x) FILTER (WHERE adherent = 1) AS mean1,
    var_samp(x) FILTER (WHERE adherent = 1) AS var1,
    count(x) FILTER (WHERE adherent = 0) AS n2, avg(x) FILTER (WHERE adherent = 0) AS mean2,
    var_samp(x) FILTER (WHERE adherent = 0) AS var2
  FROM long WHERE x IS NOT NULL GROUP BY measure
)
SELECT measure, n1, mean1, var1, n2, mean2, var2,
       (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t,
       ((var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2)) /
       ((var1 / n1) * (var1 / n1) / (n1 - 1) + (var2 / n2) * (var2 / n2) / (n2 - 1)) AS df
FROM m""".replace("\n, long AS", ", long AS", 1))


@register("welch_t", ids="ST1,P11", round6=("mean1", "var1", "mean2", "var2", "t", "df"), sql=_WELCH_SQL)
def q_welch_t(spark, sf_dir):
    f = r_features(spark, sf_dir).select("adherent", "refill_ratio", F.col("burden_r").alias("financial_burden"))
    return stats.welch_t(f, ["refill_ratio", "financial_burden"], "adherent", first=1, second=0)


_ANOVA_SQL = with_(RFEAT, """
, g AS (SELECT age_group, count(*) AS n, avg(refill_ratio) AS mean, var_samp(refill_ratio) AS var
       FROM rfeat WHERE refill_ratio IS NOT NULL AND age_group IS NOT NULL GROUP BY age_group),
t AS (SELECT sum(n) AS N, sum(n * mean) / sum(n) AS grand, count(*) AS k FROM g),
s AS (SELECT sum(g.n * (g.mean - t.grand) * (g.mean - t.grand)) AS ss_between,
             sum((g.n - 1) * coalesce(g.var, 0.0)) AS ss_within, max(t.k) - 1 AS df_between,
             max(t.N) - max(t.k) AS df_within FROM g, t)
SELECT ss_between, ss_within, CAST(df_between AS BIGINT) AS df_between, CAST(df_within AS BIGINT) AS df_within,
       ss_between / df_between AS ms_between, ss_within / df_within AS ms_within,
       (ss_between / df_between) / (ss_within / df_within) AS f
FROM s""".replace("\n, g AS", ", g AS", 1))


@register("anova_oneway", ids="ST2", round6=("ss_between", "ss_within", "ms_between", "ms_within", "f"),
          sql=_ANOVA_SQL)
def q_anova_oneway(spark, sf_dir):
    return stats.anova_oneway(r_features(spark, sf_dir), "refill_ratio", "age_group")


_TUKEY_SQL = with_(RFEAT, """
, g AS (SELECT age_group, count(*) AS n, avg(refill_ratio) AS mean, var_samp(refill_ratio) AS var
       FROM rfeat WHERE refill_ratio IS NOT NULL AND age_group IS NOT NULL GROUP BY age_group),
t AS (SELECT sum(n) AS N, count(*) AS k, sum((n - 1) * coalesce(var, 0.0)) AS ssw FROM g)
SELECT CAST(b.age_group AS VARCHAR) || '-' || CAST(a.age_group AS VARCHAR) AS comparison,
       b.mean - a.mean AS diff,
       sqrt(t.ssw / (t.N - t.k) / 2 * (1.0 / a.n + 1.0 / b.n)) AS se,
       abs(b.mean - a.mean) / sqrt(t.ssw / (t.N - t.k) / 2 * (1.0 / a.n + 1.0 / b.n)) AS q,
       CAST(t.k AS BIGINT) AS k, CAST(t.N - t.k AS BIGINT) AS df
FROM g a JOIN g b ON a.age_group < b.age_group, t""".replace("\n, g AS", ", g AS", 1))


@register("tukey_pairs", ids="ST3", round6=("diff", "se", "q"), sql=_TUKEY_SQL)
def q_tukey_pairs(spark, sf_dir):
    return stats.tukey_pairs(r_features(spark, sf_dir), "refill_ratio", "age_group", levels=[0, 1, 2])


_CHI_SQL = with_(COHORT, """
, cells AS (SELECT insurance_type, adherent, count(*) AS o FROM cohort
            WHERE insurance_type IS NOT NULL AND adherent IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT insurance_type, sum(o) AS ra FROM cells GROUP BY 1),
cb AS (SELECT adherent, sum(o) AS cb FROM cells GROUP BY 1)
SELECT sum(CAST(o AS DOUBLE) * o / (ra * cb)) * sum(o) - sum(o) AS chi2,
       CAST((count(DISTINCT cells.insurance_type) - 1) * (count(DISTINCT cells.adherent) - 1) AS BIGINT) AS df,
       CAST(sum(o) AS BIGINT) AS n
FROM cells JOIN ra ON cells.insurance_type = ra.insurance_type JOIN cb ON cells.adherent = cb.adherent
""".replace("\n, cells AS", ", cells AS", 1))


@register("chi2_independence", ids="ST4", round6=("chi2",), sql=_CHI_SQL)
def q_chi2_independence(spark, sf_dir):
    return stats.chi2_independence(bindings.cohort(spark, sf_dir), "insurance_type", "adherent")


@register("contingency", ids="ST5", sql=with_(COHORT, """
SELECT insurance_type, count(*) FILTER (WHERE adherent = 0) AS "0", count(*) FILTER (WHERE adherent = 1) AS "1"
FROM cohort WHERE insurance_type IS NOT NULL AND adherent IS NOT NULL GROUP BY insurance_type"""))
def q_contingency(spark, sf_dir):
    return stats.contingency(bindings.cohort(spark, sf_dir), "insurance_type", "adherent", [0, 1])


_HEAT = ("adherent", "refill_ratio", "financial_burden", "age_group", "refill_gap", "medication_complexity",
         "supply_category")


def _corr_sql(cols, src, where=""):
    parts = [f"SELECT '{c}' AS var1, '{c}' AS var2, 1.0::DOUBLE AS r" for c in cols]
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            parts.append(f"SELECT '{x}', '{y}', (SELECT corr({x}, {y}) FROM {src} {where})")
            parts.append(f"SELECT '{y}', '{x}', (SELECT corr({x}, {y}) FROM {src} {where})")
    return "\nUNION ALL\n".join(parts)


@register("corr_pairwise", ids="ST8", round6=("r",), sql=with_(FEATURES, _corr_sql(_HEAT, "features")))
def q_corr_pairwise(spark, sf_dir):
    return stats.corr_matrix(featured(spark, sf_dir), _HEAT, nulls="pairwise")


_RCORR = ("adherent", "age", "refill_ratio", "burden_r", "num_medications", "expected_refills", "refills_received")
_RCORR_WHERE = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _RCORR)


@register("corr_listwise", ids="ST9,P8", round6=("r",), sql=with_(RFEAT, _corr_sql(_RCORR, "rfeat", _RCORR_WHERE)))
def q_corr_listwise(spark, sf_dir):
    return stats.corr_matrix(r_features(spark, sf_dir), _RCORR, nulls="listwise")


@register("corr_target", ids="ST10,W1", round6=("r",), sql=with_(RFEAT, "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS variable, r, CASE WHEN r > 0 THEN '+' ELSE '-' END AS direction FROM "
     f"(SELECT corr({c}, adherent) AS r FROM rfeat {_RCORR_WHERE})" for c in _RCORR])))
def q_corr_target(spark, sf_dir):
    return stats.corr_target(r_features(spark, sf_dir), "adherent", list(_RCORR[1:]), nulls="listwise")


@register("group_linear_fit", ids="ST11", round6=("slope", "intercept", "r2", "sxx", "x_mean", "resid_se",
                                                  "se_fit"), sql=with_(RFEAT, """
, g AS (
  SELECT adherence_label, regr_count(refill_ratio, burden_r) AS n, regr_slope(refill_ratio, burden_r) AS slope,
         regr_intercept(refill_ratio, burden_r) AS intercept, regr_r2(refill_ratio, burden_r) AS r2,
         regr_sxx(refill_ratio, burden_r) AS sxx, regr_syy(refill_ratio, burden_r) AS syy,
         regr_sxy(refill_ratio, burden_r) AS sxy, regr_avgx(refill_ratio, burden_r) AS x_mean
  FROM rfeat WHERE burden_r IS NOT NULL AND burden_r < 4 AND refill_ratio IS NOT NULL GROUP BY adherence_label
)
SELECT adherence_label, CAST(n AS BIGINT) AS n, slope, intercept, r2, sxx, x_mean,
       sqrt(greatest(syy - slope * sxy, 0.0) / (n - 2)) AS resid_se,
       sqrt(greatest(syy - slope * sxy, 0.0) / (n - 2)) * sqrt(1.0 / n) AS se_fit
FROM g""".replace("\n, g AS", ", g AS", 1)))
def q_group_linear_fit(spark, sf_dir):
    f = r_features(spark, sf_dir).filter(F.col("burden_r") < 4)
    return stats.group_linear_fit(f, "refill_ratio", "burden_r", "adherence_label")


@register("test_pvalues", ids="ST12")
def q_test_pvalues(spark, sf_dir):
    """Tail probabilities of the reduced test rows (pandas_udf finishers)."""
    rf = r_features(spark, sf_dir)
    w = stats.welch_t(rf.select("adherent", "refill_ratio", F.col("burden_r").alias("financial_burden")),
                      ["refill_ratio", "financial_burden"], "adherent", pvalues=True)
    a = stats.anova_oneway(rf, "refill_ratio", "age_group", pvalues=True)
    t = stats.tukey_pairs(rf, "refill_ratio", "age_group", levels=[0, 1, 2], pvalues=True)
    c = stats.chi2_independence(rf, "insurance_type", "adherent", pvalues=True)
    cols = ["test", "item", "statistic", "df1", "df2", "p_value"]
    return (w.select(F.lit("welch_t").alias("test"), F.col("measure").alias("item"), F.col("t").alias("statistic"),
                     F.col("df").alias("df1"), F.lit(None).cast("double").alias("df2"), "p_value")
            .unionByName(a.select(F.lit("anova").alias("test"), F.lit("refill_ratio~age_group").alias("item"),
                                  F.col("f").alias("statistic"), F.col("df_between").cast("double").alias("df1"),
                                  F.col("df_within").cast("double").alias("df2"), "p_value"))
            .unionByName(t.select(F.lit("tukey").alias("test"), F.col("comparison").alias("item"),
                                  F.col("q").alias("statistic"), F.col("k").cast("double").alias("df1"),
                                  F.col("df").cast("double").alias("df2"), F.col("p_adj").alias("p_value")))
            .unionByName(c.select(F.lit("chi2").alias("test"), F.lit("insurance_type x adherent").alias("item"),
                                  F.col("chi2").alias("statistic"), F.col("df").cast("double").alias("df1"),
                                  F.lit(None).cast("double").alias("df2"), "p_value"))
            .select(*cols))


# --------------------------------------------------------------------------
# Sampling (R1, R2, R4, R5)
# --------------------------------------------------------------------------

_RANKED = """
, ranked AS (
  SELECT patient_id, adherent,
         row_number() OVER (PARTITION BY adherent ORDER BY md5('42|' || CAST(patient_id AS VARCHAR)), patient_id) AS rk
  FROM cohort
)"""

_SPLIT_CTES = _RANKED.replace("\n, ranked AS", ", ranked AS", 1) + """,
cc AS (SELECT adherent, count(*) AS n FROM cohort GROUP BY adherent),
tot AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_train FROM cc),
fl AS (SELECT adherent, n, n_train, floor(n_train * n / total) AS fl,
              n_train * n / total - floor(n_train * n / total) AS frac FROM cc, tot),
al AS (SELECT adherent, n - (fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, CAST(adherent AS VARCHAR))
                                       <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS test_size FROM fl)"""
_SPLIT_LAST = """SELECT r.patient_id, r.adherent, CASE WHEN r.rk <= al.test_size THEN 'test' ELSE 'train' END AS split
FROM ranked r JOIN al ON r.adherent = al.adherent"""
_SPLIT_SQL = with_(COHORT, _SPLIT_CTES + _SPLIT_LAST)
_SPLIT_SQL_CTES = COHORT + _SPLIT_CTES + ", parted AS (" + _SPLIT_LAST + ")"


@register("stratified_split", ids="R1,S9", sql=_SPLIT_SQL)
def q_stratified_split(spark, sf_dir):
    c = bindings.cohort(spark, sf_dir).select("patient_id", "adherent")
    return sampling.stratified_split(c, "adherent", "patient_id", 0.2, 42)


@register("stratified_folds", ids="R4", sql=with_(COHORT, _RANKED.replace("\n, ranked AS", ", ranked AS", 1) + """
SELECT patient_id, adherent, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM ranked"""))
def q_stratified_folds(spark, sf_dir):
    c = bindings.cohort(spark, sf_dir).select("patient_id", "adherent")
    return sampling.stratified_folds(c, "adherent", "patient_id", 5, 42)


_OVERSAMPLE_SQL = with_(COHORT, _RANKED.replace("\n, ranked AS", ", ranked AS", 1) + """,
cc AS (SELECT adherent, count(*) AS n FROM cohort GROUP BY adherent),
mn AS (SELECT adherent AS minority, n AS n_min FROM cc ORDER BY n, CAST(adherent AS VARCHAR) LIMIT 1),
mx AS (SELECT n AS n_maj FROM cc ORDER BY n DESC, CAST(adherent AS VARCHAR) LIMIT 1),
draws AS (
  SELECT i AS draw, CAST(('0x' || substr(md5('42|' || CAST(i AS VARCHAR)), 1, 15)) AS BIGINT) % n_min + 1 AS rk
  FROM mx, mn, range(0, (SELECT n_maj FROM mx)) t(i)
)
SELECT c.patient_id, c.adherent, CAST(NULL AS BIGINT) AS draw FROM cohort c, mn WHERE c.adherent <> mn.minority
UNION ALL
SELECT r.patient_id, r.adherent, d.draw FROM draws d JOIN ranked r ON r.rk = d.rk JOIN mn ON r.adherent = mn.minority""")


@register("random_oversample", ids="R2,W7", sql=_OVERSAMPLE_SQL)
def q_random_oversample(spark, sf_dir):
    c = bindings.cohort(spark, sf_dir).select("patient_id", "adherent")
    return sampling.random_oversample(c, "adherent", "patient_id", 42)


@register("resample_report", ids="R5,A5", sql=with_(COHORT, """
, cc AS (SELECT adherent, count(*) AS n FROM cohort GROUP BY adherent)
SELECT 'before' AS stage, adherent, n FROM cc
UNION ALL
SELECT 'after', adherent, (SELECT max(n) FROM cc) FROM cc""".replace("\n, cc AS", ", cc AS", 1)))
def q_resample_report(spark, sf_dir):
    c = bindings.cohort(spark, sf_dir).select("patient_id", "adherent")
    return sampling.resample_report(c, sampling.random_oversample(c, "adherent", "patient_id", 42), "adherent")


_SMOTE = ("age", "num_medications", "refills_received", "annual_contribution", "claim_amount")
_SMOTE_KNN = """
fit AS (
  SELECT patient_id, adherent, {cols} FROM cohort
  WHERE annual_contribution IS NOT NULL AND claim_amount IS NOT NULL AND age IS NOT NULL AND num_medications IS NOT NULL
    AND refills_received IS NOT NULL
), pairs AS (
  SELECT a.adherent, a.patient_id AS key, b.patient_id AS neighbour, {distance} AS distance2
  FROM fit a JOIN fit b ON a.adherent = b.adherent AND a.patient_id <> b.patient_id
), knn AS (
  SELECT adherent, key, row_number() OVER (PARTITION BY key ORDER BY distance2, neighbour) AS rank, neighbour, distance2 FROM pairs
  QUALIFY rank <= 5
)""".format(cols=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SMOTE),
            distance="(" * len(_SMOTE) + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c}))" for c in _SMOTE))


@register("smote_knn", ids="R3", round6=("distance2",), sql=with_(COHORT + "," + _SMOTE_KNN, """
SELECT CAST(adherent AS VARCHAR) AS cls, key, CAST(rank AS INTEGER) AS rank, neighbour, distance2 FROM knn"""))
def q_smote_knn(spark, sf_dir):
    return smote.smote_knn(bindings.cohort(spark, sf_dir), "adherent", "patient_id", _SMOTE)


_HASH15 = "CAST(('0x' || substr(md5('42|{}|' || CAST(i AS VARCHAR)), 1, 15)) AS BIGINT)"
_SMOTE_SQL = with_(COHORT + "," + _SMOTE_KNN + """,
cc AS (SELECT adherent, count(*) AS n FROM cohort GROUP BY adherent),
small AS (
  SELECT cc.adherent, (SELECT max(n) FROM cc) - cc.n AS want, count(fit.patient_id) AS n
  FROM cc LEFT JOIN fit ON fit.adherent = cc.adherent WHERE cc.n < (SELECT max(n) FROM cc) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY adherent ORDER BY md5('42|' || CAST(patient_id AS VARCHAR)), patient_id) AS rk FROM fit
), draws AS (
  SELECT small.adherent, i AS draw, """ + _HASH15.format("base") + """ % n + 1 AS rk, """ + _HASH15.format("near") + """ % least(5, n - 1) + 1 AS rank,
         CAST(""" + _HASH15.format("u") + """ AS DOUBLE) / 1152921504606846976.0::DOUBLE AS u
  FROM small, unnest(range(0, want)) AS t(i)
)""", """
SELECT patient_id, adherent, {plain}, CAST(NULL AS BIGINT) AS draw, CAST(NULL AS BIGINT) AS base, CAST(NULL AS BIGINT) AS neighbour, CAST(NULL AS DOUBLE) AS u
FROM cohort
UNION ALL
SELECT NULL, d.adherent, {mixed}, d.draw, x.patient_id, y.patient_id, d.u
FROM draws d JOIN ranked x ON x.adherent = d.adherent AND x.rk = d.rk
JOIN knn ON knn.key = x.patient_id AND knn.rank = d.rank JOIN fit y ON y.patient_id = knn.neighbour""".format(
    plain=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SMOTE), mixed=", ".join(f"x.{c} + d.u * (y.{c} - x.{c}) AS {c}" for c in _SMOTE)))


@register("smote_oversample", ids="R3,R5", round6=(*_SMOTE, "u"), sql=_SMOTE_SQL)
def q_smote_oversample(spark, sf_dir):
    return smote.smote_oversample(bindings.cohort(spark, sf_dir), "adherent", "patient_id", _SMOTE)


# --------------------------------------------------------------------------
# Models (M1-M9, ST6, ST7): MLlib PipelineModels; results are not bit-equal
# to other libraries (binned splits, RNG), so these get the rows-only check
# plus quality-floor unit tests.
# --------------------------------------------------------------------------

def _fit_query(name):
    def build(spark, sf_dir):
        s = modeling.test_scores(spark, sf_dir, [name])
        return metrics.model_metrics(s)
    return build


for _key, _name in (("fit_logistic", "Logistic Regression"), ("fit_tree", "Decision Tree"),
                    ("fit_forest", "Random Forest"), ("fit_gbt", "Gradient Boosting")):
    register(_key, ids="M1-M4,M6")(_fit_query(_name))


@register("score_test", ids="M6")
def q_score_test(spark, sf_dir):
    return modeling.test_scores(spark, sf_dir, ["Random Forest"])


@register("score_all_models", ids="M7,K11")
def q_score_all_models(spark, sf_dir):
    s = modeling.test_scores(spark, sf_dir, list(models.MODEL_SPECS))
    return metrics.model_metrics(s)


@register("cv_auc", ids="M5,R4")
def q_cv_auc(spark, sf_dir):
    """5-fold stratified CV ROC-AUC (mean, population sd) of all four models on
    the training split; each fold fits on the other four, oversampled there."""
    train, _ = modeling.train_test(spark, sf_dir, oversample=False)
    return modeling.cross_validate(train, list(models.MODEL_SPECS), 5, 42)


@register("cv_folds", ids="M5,R4", sql=with_(_SPLIT_SQL_CTES, """
SELECT fold, adherent AS label, count(*) AS n FROM (
  SELECT adherent, (row_number() OVER (PARTITION BY adherent ORDER BY md5('42|' || CAST(patient_id AS VARCHAR)), patient_id) - 1) % 5 AS fold
  FROM parted WHERE split = 'train')
GROUP BY ALL"""))
def q_cv_folds(spark, sf_dir):
    """Rows of every fold and class of the cross-validation."""
    train, _ = modeling.train_test(spark, sf_dir, oversample=False)
    return modeling.folds(train, 5, 42).groupBy(F.col("fold").cast("long").alias("fold"), modeling.LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("feature_importance", ids="M9,W3")
def q_feature_importance(spark, sf_dir):
    return models.feature_importance(spark, modeling.fitted(spark, sf_dir, "Random Forest"), top=15)


_GLM_FEATURES = ["refill_ratio", "burden_r", "age", "gender_male", "long_supply", "high_med"]


@register("glm_summary", ids="ST6,F9")
def q_glm_summary(spark, sf_dir):
    return models.glm_summary(_complete_glm(spark, sf_dir), "adherent", _GLM_FEATURES)


def _complete_glm(spark, sf_dir):
    return feat.indicators(r_features(spark, sf_dir)).filter(F.col("burden_r").isNotNull())


_GLM_SQL = {"(Intercept)": "1.0", "refill_ratio": "refill_ratio", "burden_r": "burden_r", "age": "age", "gender_male": "CAST(gender = 'Male' AS INTEGER)",
            "long_supply": "CAST(days_supply = 90 AS INTEGER)", "high_med": "CAST(num_medications >= 5 AS INTEGER)"}


@register("glm_score_equations", ids="ST6,M1", round6=("total",), sql=with_(RFEAT + """,
g AS (SELECT adherent, {} FROM rfeat), h AS (SELECT * FROM g WHERE {})""".format(
    ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(_GLM_SQL.values())),
    " AND ".join(f"x{i} IS NOT NULL" for i in range(len(_GLM_SQL)))), "\nUNION ALL\n".join(
    f"SELECT '{t}' AS term, count(*) AS n, sum(CASE WHEN adherent = 1 THEN x{i} ELSE 0.0 END) AS total FROM h" for i, t in enumerate(_GLM_SQL))))
def q_glm_score_equations(spark, sf_dir):
    """Fitted totals of every term; at the optimum those of the positive rows."""
    rf = _complete_glm(spark, sf_dir)
    return irls.fitted_totals(rf, "adherent", _GLM_FEATURES, irls.fit(rf, "adherent", _GLM_FEATURES))


_TREE_COLUMNS = ("refill_ratio", "burden_r", "age", "days_supply", "num_medications")
_TREE_DATA = RFEAT + """,
t AS (SELECT adherent AS y, {} FROM rfeat WHERE {}),
whole AS (SELECT count(*) AS n, sum(y) AS pos FROM t),
cells AS ({}),
runs AS (SELECT f, v, lead(v) OVER w AS after, CAST(sum(n) OVER w AS BIGINT) AS n_left, CAST(sum(pos) OVER w AS BIGINT) AS pos_left
         FROM (SELECT f, v, count(*) AS n, sum(y) AS pos FROM cells GROUP BY ALL) WINDOW w AS (PARTITION BY f ORDER BY v)),
cuts AS (SELECT f, v / 2 + after / 2 AS threshold, n_left, pos_left, CAST(n_left AS DOUBLE) AS a, CAST(pos_left AS DOUBLE) AS b,
                CAST(n - n_left AS DOUBLE) AS c, CAST(pos - pos_left AS DOUBLE) AS d
         FROM runs, whole WHERE after IS NOT NULL AND n_left >= 10 AND n - n_left >= 10)""".format(
    ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_TREE_COLUMNS)),
    " AND ".join(f"{c} IS NOT NULL" for c in _TREE_COLUMNS),
    " UNION ALL ".join(f"SELECT {i} AS f, x{i} AS v, y FROM t" for i in range(len(_TREE_COLUMNS))))


@register("tree_root_splits", ids="M2", round6=("threshold", "purity"), sql=with_(_TREE_DATA, """
SELECT f, threshold, purity, n_left, pos_left,
       CAST(row_number() OVER (ORDER BY purity DESC, f, threshold) AS INTEGER) AS place
FROM (SELECT *, (b * b + (a - b) * (a - b)) / a + (d * d + (c - d) * (c - d)) / c AS purity FROM cuts
      QUALIFY row_number() OVER (PARTITION BY f ORDER BY purity DESC, threshold) = 1)"""))
def q_tree_root_splits(spark, sf_dir):
    """The best exact split of every column at the root of the tree; the first
    place is the split that the tree takes."""
    data = cart.prepared(r_features(spark, sf_dir), "adherent", _TREE_COLUMNS)
    found = cart.candidates(data, F.lit(cart.ROOT), _TREE_COLUMNS, 10)
    best = F.min(F.struct((-F.col("purity")).alias("p"), "threshold", "n_left", "pos_left")).alias("b")
    each = found.groupBy("node", "f").agg(best).select("node", "f", "b.threshold", (-F.col("b.p")).alias("purity"), "b.n_left", "b.pos_left")
    # a row per column
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("purity"), "f", "threshold"))
    return each.withColumn("place", place).drop("node")


@register("odds_ratios", ids="ST7")
def q_odds_ratios(spark, sf_dir):
    return models.odds_ratios(q_glm_summary(spark, sf_dir))


# --------------------------------------------------------------------------
# Explanations and record scoring
# --------------------------------------------------------------------------

_ABL_FEATURES = ("refill_ratio", "financial_burden", "age", "num_medications", "days_supply", "refill_gap")
# Fixed weights of the closed-form logistic score used by the SQL-checkable
# ablation (not a fitted model).
_ABL_WEIGHTS = {"refill_ratio": 4.0, "financial_burden": -1.5, "age": -0.02, "num_medications": -0.3,
                "days_supply": 0.01, "refill_gap": -0.2}
_ABL_BIAS = 0.5


@register("baseline_medians", ids="M10", round6=("median",), sql=with_(FEATURES, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median FROM features" for c in _ABL_FEATURES)))
def q_baseline_medians(spark, sf_dir):
    return explain.medians_frame(featured(spark, sf_dir), _ABL_FEATURES)


def _abl_sql():
    z = " + ".join(f"{w!r} * {c}" for c, w in _ABL_WEIGHTS.items())
    cf_rows = "\nUNION ALL\n".join(
        f"SELECT patient_id, '{c}' AS feature, (SELECT {c} FROM med) AS median, "
        f"1.0 / (1.0 + exp(-({_ABL_BIAS!r} + " +
        " + ".join(f"{w!r} * " + (f"(SELECT {c2} FROM med)" if c2 == c else c2) for c2, w in _ABL_WEIGHTS.items())
        + f"))) AS p FROM x WHERE {c} IS DISTINCT FROM (SELECT {c} FROM med)" for c in _ABL_FEATURES)
    return with_(FEATURES, f"""
, x AS (SELECT patient_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _ABL_FEATURES)} FROM features),
med AS (SELECT {", ".join(f"median({c}) AS {c}" for c in _ABL_FEATURES)} FROM x),
base AS (SELECT patient_id, 1.0 / (1.0 + exp(-({_ABL_BIAS!r} + {z}))) AS base_p FROM x),
cf AS ({cf_rows}),
d AS (SELECT cf.patient_id, feature, median, base_p, base_p - p AS delta FROM cf JOIN base USING (patient_id)
      WHERE abs(base_p - p) >= 0.0001),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY round(abs(delta), 12) DESC, feature) AS rank FROM d)
SELECT patient_id, CAST(rank AS INTEGER) AS rank, feature,
       CASE feature """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in explain.FEATURE_LABELS.items()) + """
            ELSE feature END AS label,
       median, base_p, delta,
       CASE WHEN delta > 0 THEN 'Supports adherence' ELSE 'Raises risk' END AS direction
FROM r WHERE rank <= 6""".replace("\n, x AS", ", x AS", 1))


@register("ablation_linear", ids="M11,W4", round6=("median", "base_p", "delta"), sql=_abl_sql())
def q_ablation_linear(spark, sf_dir):
    f = featured(spark, sf_dir).select("patient_id", *[F.col(c).cast("double").alias(c) for c in _ABL_FEATURES])
    med = explain.baseline_medians(f, _ABL_FEATURES)
    return explain.local_drivers(f, explain.linear_scorer(_ABL_WEIGHTS, _ABL_BIAS), "patient_id",
                                 _ABL_FEATURES, med, top_n=6)


@register("local_drivers", ids="M11,W4,M3,M10")
def q_local_drivers(spark, sf_dir):
    """Forest ablation drivers for every record against the medians of all:
    all scores of a record in its row, top 6 per record.  A table in fewer
    partitions than there are cores is dealt to all of them first, as every
    row costs one forest call per feature."""
    every = modeling.split_table(spark, sf_dir).drop("split")
    cores = spark.sparkContext.defaultParallelism
    if every.rdd.getNumPartitions() < cores:
        every = every.repartition(cores, modeling.KEY)
    feats = modeling.feature_names(every)
    model = modeling.fitted(spark, sf_dir, "Random Forest")
    med = explain.baseline_medians(every, feats)
    return explain.local_drivers(every, explain.model_scorer(model), modeling.KEY, feats, med, top_n=6)


@register("score_batch", ids="M8,P12,F11")
def q_score_batch(spark, sf_dir):
    """Incoming profiles scored with the stored pipeline: derive features with
    the same functions, align to the model's columns, transform, label."""
    from cohort_engine.streaming.scoring import score_profiles
    model = modeling.fitted(spark, sf_dir, "Random Forest")
    profiles = bindings.cohort(spark, sf_dir)
    return score_profiles(profiles, model)


@register("score_records", ids="M8,C1,C7")
def q_score_records(spark, sf_dir):
    """Records scored with the batch pipeline's own imputation, capping and
    encoding; the held-out ones agree with ``score_test``."""
    from cohort_engine.streaming.scoring import score_records
    model = modeling.fitted(spark, sf_dir, "Random Forest")
    return score_records(bindings.cohort(spark, sf_dir), model, modeling.cleaning(spark, sf_dir))


# --------------------------------------------------------------------------
# Typed text loads
# --------------------------------------------------------------------------

def _typed_sql():
    parts = []
    for i, c in enumerate(bindings.COHORT_COLUMNS):
        t = f"trim(coalesce(CAST({c} AS VARCHAR), ''))"
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN ni = nb THEN 'INTEGER' WHEN nf = nb THEN 'REAL' ELSE 'TEXT' END "
            f"AS sql_type, nb AS non_blank, {i} AS ordinal FROM (SELECT count(*) FILTER (WHERE {t} <> '') AS nb, "
            f"count(*) FILTER (WHERE {t} <> '' AND regexp_full_match({t}, '[+-]?[0-9]+')) AS ni, "
            f"count(*) FILTER (WHERE {t} <> '' AND TRY_CAST({t} AS DOUBLE) IS NOT NULL) AS nf FROM cohort)")
    return with_(COHORT, "\nUNION ALL\n".join(parts))


@register("typed_load", ids="S5", sql=_typed_sql())
def q_typed_load(spark, sf_dir):
    from cohort_engine.sources import typed
    return typed.infer_frame(typed.as_text(bindings.cohort(spark, sf_dir)))


_REPORT_TEXT = ("patient_id", "age", "insurance_type", "claim_amount", "chronic_condition", "note")
_REPORT_NOTE = """CASE patient_id % 4 WHEN 0 THEN '  '
  WHEN 1 THEN ' said "' || insurance_type || '", then' || chr(10) || 'left' WHEN 2 THEN '"' || chr(13) || chr(10) || gender || ',' ELSE gender END"""


@register("csv_load", ids="S1,S2,S4,S5,S6", sql=with_(COHORT, """
SELECT CAST(patient_id AS BIGINT) AS patient_id, CAST(age AS BIGINT) AS age, insurance_type, claim_amount, chronic_condition,
       nullif(trim(note), '') AS note_text FROM (SELECT *, {} AS note FROM cohort)""".format(_REPORT_NOTE)))
def q_csv_load(spark, sf_dir):
    """The cohort written as CSV, with blanks, quotes and line ends in cells, and
    loaded again: names normalised, types inferred."""
    from cohort_engine.sources import tables, typed
    path = shared_path(spark, "csv")
    rows = bindings.cohort(spark, sf_dir).withColumn("note", F.expr(_REPORT_NOTE))
    rows = rows.select(*_REPORT_TEXT).withColumnRenamed("note", "Note Text")
    tables.write_table(rows, path, fmt="csv")
    return typed.typed_load(spark, path, normalize=True)


# The report's display header of the metric table.
METRIC_HEADERS = {"model": "Model", "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall",
                  "at_risk_recall": "At-Risk Recall", "f1_score": "F1 Score", "roc_auc": "ROC-AUC",
                  "pr_auc_at_risk": "PR-AUC (At-Risk)"}


@register("normalized_metrics", ids="S6,S5", sql=with_(SCORES + "," + metrics_cte(), """
SELECT model, accuracy, precision, recall, at_risk_recall, f1_score, roc_auc, pr_auc_at_risk AS "pr_auc_(at_risk)"
FROM model_metrics"""))
def q_normalized_metrics(spark, sf_dir):
    from cohort_engine.sources import typed
    mm = bi.model_metrics_table(spark, sf_dir)
    text = typed.as_text(mm.select(*[F.col(k).alias(v) for k, v in METRIC_HEADERS.items()]))
    text = typed.normalize_columns(text)
    return typed.apply_types(text, typed.infer_types(text))


# --------------------------------------------------------------------------
# Line-item scale bindings (the bench set): the same operators on lineitem.
# --------------------------------------------------------------------------

_CLAIMS_SCORES = """
claims AS (
  SELECT l_orderkey * 8 + l_linenumber AS patient_id, CAST(l_returnflag = 'R' AS INTEGER) AS y,
         floor((0.5::DOUBLE * l_discount * 10.0::DOUBLE + 0.5::DOUBLE * l_quantity / 50.0::DOUBLE) * 10000.0::DOUBLE
               + 0.5::DOUBLE) / 10000.0::DOUBLE AS p
  FROM lineitem
),
scored AS (SELECT 'claims' AS model, patient_id, y, p, CAST(p >= 0.5 AS INTEGER) AS y_hat FROM claims)"""


@register("claims_roc_auc", ids="K4", round6=("roc_auc",), sql=with_(_CLAIMS_SCORES + "," + metrics_cte(),
          "SELECT model, roc_auc FROM auc"))
def q_claims_roc_auc(spark, sf_dir):
    return metrics.roc_auc(bindings.claims_scores(spark, sf_dir))


@register("claims_pr_auc", ids="K5", round6=("pr_auc_at_risk",), sql=with_(_CLAIMS_SCORES + "," + metrics_cte(),
          "SELECT model, pr_auc_at_risk FROM ap"))
def q_claims_pr_auc(spark, sf_dir):
    return metrics.average_precision(bindings.claims_scores(spark, sf_dir), positive=0)


_CLAIM_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("claims_welch_t", ids="ST1", round6=("mean1", "var1", "mean2", "var2", "t", "df"), sql=with_("""
long AS (""" + "\nUNION ALL\n".join(
    f"SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, '{c}' AS measure, CAST({c} AS DOUBLE) AS x FROM lineitem"
    for c in _CLAIM_MEASURES) + """),
m AS (
  SELECT measure,
    count(x) FILTER (WHERE label = 1) AS n1, avg(x) FILTER (WHERE label = 1) AS mean1,
    var_samp(x) FILTER (WHERE label = 1) AS var1,
    count(x) FILTER (WHERE label = 0) AS n2, avg(x) FILTER (WHERE label = 0) AS mean2,
    var_samp(x) FILTER (WHERE label = 0) AS var2
  FROM long WHERE x IS NOT NULL GROUP BY measure
)""", """
SELECT measure, n1, mean1, var1, n2, mean2, var2,
       (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t,
       ((var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2)) /
       ((var1 / n1) * (var1 / n1) / (n1 - 1) + (var2 / n2) * (var2 / n2) / (n2 - 1)) AS df
FROM m"""))
def q_claims_welch_t(spark, sf_dir):
    return stats.welch_t(bindings.claims_wide(spark, sf_dir), _CLAIM_MEASURES, "label", first=1, second=0)


_CLAIM_COLS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus")
_CLAIM_TYPES = ("bigint", "int", "double", "double", "double", "double", "string", "string")


@register("claims_profile", ids="A2", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct, "
    f"{i} AS ordinal FROM lineitem" for i, (c, t) in enumerate(zip(_CLAIM_COLS, _CLAIM_TYPES))))
def q_claims_profile(spark, sf_dir):
    return profile.profile_columns(bindings.table(spark, sf_dir, "lineitem", list(_CLAIM_COLS)), scan=True)


@register("claims_split", ids="R1", sql="""
WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS k, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem),
ranked AS (SELECT k, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(k AS VARCHAR)), k) AS rk
           FROM c),
cc AS (SELECT label, count(*) AS n FROM c GROUP BY label),
tot AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_train FROM cc),
fl AS (SELECT label, n, n_train, floor(n_train * n / total) AS fl,
              n_train * n / total - floor(n_train * n / total) AS frac FROM cc, tot),
al AS (SELECT label, n - (fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, CAST(label AS VARCHAR))
                                    <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS test_size FROM fl)
SELECT label AS split_label, CASE WHEN r.rk <= al.test_size THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       CAST(sum(k) AS BIGINT) AS key_sum
FROM ranked r JOIN al USING (label) GROUP BY 1, 2""")
def q_claims_split(spark, sf_dir):
    c = bindings.claims_wide(spark, sf_dir).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "label")
    s = sampling.stratified_split(c, "label", "k", 0.2, 42)
    return s.groupBy(F.col("label").alias("split_label"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("key_sum"))


# --------------------------------------------------------------------------
# Remaining profile items
# --------------------------------------------------------------------------

@register("shape", ids="A1", sql=with_(COHORT, "SELECT count(*) AS rows, 12 AS columns FROM cohort"))
def q_shape(spark, sf_dir):
    return profile.shape(bindings.cohort(spark, sf_dir))


@register("group_means", ids="A11", round6=("mean_refill_ratio",), sql=with_(FEATURES, """
SELECT adherent, avg(refill_ratio) AS mean_refill_ratio FROM features GROUP BY adherent"""))
def q_group_means(spark, sf_dir):
    return reports.group_means(featured(spark, sf_dir), "refill_ratio", "adherent")


# --------------------------------------------------------------------------
# The same operators on other bindings: documents (imbalanced label) and
# events (a second guarded ratio).
# --------------------------------------------------------------------------

_DOC_SCORES = """
scored AS (
  SELECT 'doc_length' AS model, d.doc_id AS patient_id, l.quality AS y,
         floor(least(CAST(d.n_chars AS DOUBLE) / 5000.0::DOUBLE, 1.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE)
           / 10000.0::DOUBLE AS p,
         CAST(floor(least(CAST(d.n_chars AS DOUBLE) / 5000.0::DOUBLE, 1.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE)
           / 10000.0::DOUBLE >= 0.5 AS INTEGER) AS y_hat
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


@register("doc_quality_metrics", ids="K11", sql=with_(_DOC_SCORES + "," + metrics_cte(), "SELECT * FROM model_metrics"))
def q_doc_quality_metrics(spark, sf_dir):
    return metrics.model_metrics(bindings.doc_scores(spark, sf_dir))


@register("doc_oversample_report", ids="R2,R5", sql=with_(_DOC_SCORES, """
, cc AS (SELECT y, count(*) AS n FROM scored GROUP BY y)
SELECT 'before' AS stage, y AS quality, n FROM cc
UNION ALL SELECT 'after', y, (SELECT max(n) FROM cc) FROM cc""".replace("\n, cc AS", ", cc AS", 1)))
def q_doc_oversample_report(spark, sf_dir):
    d = bindings.doc_quality(spark, sf_dir).select("doc_id", "quality")
    return sampling.resample_report(d, sampling.random_oversample(d, "quality", "doc_id", 42), "quality")


@register("events_ratio", ids="F1,F4,A7", round6=("rate",), sql="""
WITH u AS (
  SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS n_view,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_purchase
  FROM events GROUP BY user_id
), r AS (
  SELECT user_id, CASE WHEN CAST(n_view AS DOUBLE) > 0 THEN CAST(n_purchase AS DOUBLE) / CAST(n_view AS DOUBLE)
                       ELSE 0.0 END AS r0 FROM u
), b AS (
  SELECT user_id, CASE WHEN r0 < 0 THEN 0.0 WHEN r0 > 1 THEN 1.0 ELSE r0 END AS conversion FROM r
)
SELECT CASE WHEN conversion <= 0.25 THEN 0 WHEN conversion <= 0.75 THEN 1 WHEN conversion IS NOT NULL THEN 2 END
         AS conversion_band,
       avg(conversion) AS rate, count(*) AS n
FROM b GROUP BY 1""")
def q_events_ratio(spark, sf_dir):
    u = bindings.user_events(spark, sf_dir)
    conv = scalar.guarded_ratio("n_purchase", "n_view", 0.0, 1.0)
    b = u.select(conv.alias("conversion"))
    b = b.withColumn("conversion_band", scalar.bucketize("conversion", [0.25, 0.75]))
    return b.groupBy("conversion_band").agg(F.avg("conversion").alias("rate"), F.count(F.lit(1)).alias("n"))



@register("box_stats_by_age_label", ids="A13", round6=("q1", "median", "q3", "whisker_low", "whisker_high"),
          sql=with_(RFEAT, """
, q AS (SELECT age_group, adherence_label, count(*) AS n, quantile_cont(burden_r, 0.25) AS q1,
              quantile_cont(burden_r, 0.5) AS median, quantile_cont(burden_r, 0.75) AS q3
       FROM rfeat WHERE burden_r IS NOT NULL GROUP BY age_group, adherence_label)
SELECT q.age_group, q.adherence_label, n, q1, median, q3,
       min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
       max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
       CAST(sum(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
         AS outliers
FROM (SELECT age_group, adherence_label, burden_r AS x FROM rfeat WHERE burden_r IS NOT NULL) f
JOIN q ON f.age_group = q.age_group AND f.adherence_label = q.adherence_label
GROUP BY q.age_group, q.adherence_label, n, q1, median, q3""".replace("\n, q AS", ", q AS", 1)))
def q_box_stats_by_age_label(spark, sf_dir):
    """Two-key box statistics (the statistics script's burden-by-age-and-label
    chart), R burden form; exact quartiles computed without per-group maps."""
    return profile.box_stats(r_features(spark, sf_dir), "burden_r", ["age_group", "adherence_label"])



@register("claims_box_stats", ids="A13", round6=("q1", "median", "q3", "whisker_low", "whisker_high"), sql="""
WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag)
SELECT q.l_returnflag, n, q1, median, q3,
       min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
       max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
       CAST(sum(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT)
         AS outliers
FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL) f
JOIN q ON f.l_returnflag = q.l_returnflag
GROUP BY q.l_returnflag, n, q1, median, q3""")
def q_claims_box_stats(spark, sf_dir):
    """Per return-flag box statistics of line prices: a skewed grouping (one
    flag holds about half the rows) with exact quartiles computed without a
    per-group value map in one task."""
    li = bindings.table(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice"])
    return profile.box_stats(li, "l_extendedprice", "l_returnflag")



@register("model_bubbles", ids="B10,A18", sql=with_(SCORES + "," + metrics_cte(),
          "SELECT model, recall, precision, f1_score AS bubble_size FROM model_metrics"))
def q_model_bubbles(spark, sf_dir):
    """Precision-recall comparison points per model, sized by F1."""
    return bi.model_metrics_table(spark, sf_dir).select("model", "recall", "precision",
                                                         F.col("f1_score").alias("bubble_size"))



@register("rate_by_age_band", ids="A8,F4", round6=("rate",), sql=with_(COHORT, """
SELECT CASE WHEN age <= 0 THEN NULL WHEN age <= 35 THEN 'Young (18-35)' WHEN age <= 64 THEN 'Adult (36-64)'
            WHEN age <= 120 THEN 'Elderly (65+)' END AS age_band,
       avg(CAST(adherent AS DOUBLE)) AS rate, count(*) AS n
FROM cohort GROUP BY 1 HAVING age_band IS NOT NULL"""))
def q_rate_by_age_band(spark, sf_dir):
    """Dashboard form: bounded right-closed age bands, values outside dropped."""
    band = scalar.bucketize("age", scalar.AGE_BOUNDS, lowest=scalar.AGE_BAND_RANGE[0],
                            highest=scalar.AGE_BAND_RANGE[1], labels=scalar.AGE_BAND_LABELS)
    return reports.rate_by(bindings.cohort(spark, sf_dir).withColumn("age_band", band), "adherent", "age_band")
