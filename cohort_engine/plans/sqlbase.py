"""Oracle SQL building blocks (DuckDB dialect) over the driver views.

These restate the bindings independently in SQL; they are used only by the
correctness oracle, never by the Spark plans.
"""

from __future__ import annotations


def clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END"


COHORT = """
per_cust AS (
  SELECT o_custkey, count(*) AS n_orders,
         sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_filled,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
  FROM orders GROUP BY o_custkey
),
cohort AS (
  SELECT c_custkey AS patient_id,
         CAST(18 + c_custkey % 68 AS INTEGER) AS age,
         CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         r_name AS insurance_type,
         CAST(CASE WHEN c_custkey % 25 = 3 THEN NULL ELSE c_acctbal END AS DOUBLE) AS annual_contribution,
         CAST(CASE WHEN c_custkey % 25 = 11 THEN NULL
              ELSE CAST(cents AS DOUBLE) / (CAST(n_orders AS DOUBLE) * 5000.0::DOUBLE) END AS DOUBLE) AS claim_amount,
         CAST(n_orders AS BIGINT) AS expected_refills,
         CAST(n_filled AS BIGINT) AS refills_received,
         CAST(30 * (1 + c_custkey % 3) AS INTEGER) AS days_supply,
         CASE WHEN c_custkey % 25 = 19 THEN NULL ELSE c_mktsegment END AS chronic_condition,
         CAST(1 + c_custkey % 7 AS INTEGER) AS num_medications,
         CAST(CASE WHEN n_filled * 3 + c_custkey % 5 > n_orders + 2 THEN 1 ELSE 0 END AS INTEGER) AS adherent
  FROM customer
  JOIN per_cust ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

FEATURES = COHORT + """,
cohort_r AS (
  SELECT *,
    CASE WHEN CAST(expected_refills AS DOUBLE) > 0
         THEN CAST(refills_received AS DOUBLE) / CAST(expected_refills AS DOUBLE) ELSE 0.0 END AS rr0,
    CASE WHEN annual_contribution > 0 THEN claim_amount / annual_contribution ELSE 0.0 END AS fb0
  FROM cohort
),
features AS (
  SELECT * EXCLUDE (rr0, fb0),
    CAST(""" + clip_sql("rr0", "0.0", "1.0") + """ AS DOUBLE) AS refill_ratio,
    CAST(""" + clip_sql("fb0", "0.0", "5.0") + """ AS DOUBLE) AS financial_burden,
    CASE WHEN age <= 35 THEN 0 WHEN age <= 64 THEN 1 WHEN age IS NOT NULL THEN 2 END AS age_group,
    CASE WHEN num_medications <= 2 THEN 0 WHEN num_medications <= 5 THEN 1
         WHEN num_medications IS NOT NULL THEN 2 END AS medication_complexity,
    CASE WHEN days_supply <= 0 THEN NULL WHEN days_supply <= 30 THEN 0 WHEN days_supply <= 60 THEN 1
         WHEN days_supply <= 365 THEN 2 END AS supply_category,
    CASE WHEN expected_refills - refills_received < 0 THEN 0
         ELSE expected_refills - refills_received END AS refill_gap
  FROM cohort_r
)"""


def round4_sql(x: str) -> str:
    return f"(floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)"


SCORES = FEATURES + """,
scores AS (
  SELECT 'ratio_score' AS model, patient_id, adherent AS y,
         """ + round4_sql("0.7::DOUBLE * refill_ratio + 0.3::DOUBLE * (patient_id % 100) / 99.0::DOUBLE") + """ AS p
  FROM features
  UNION ALL
  SELECT 'burden_score' AS model, patient_id, adherent AS y,
         """ + round4_sql("0.6::DOUBLE * (1.0::DOUBLE - coalesce(financial_burden, 0.0::DOUBLE) / 5.0::DOUBLE)"
                          " + 0.4::DOUBLE * ((patient_id * 7) % 100) / 99.0::DOUBLE") + """ AS p
  FROM features
),
scored AS (
  SELECT model, patient_id, y, p, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS y_hat FROM scores
)"""


def with_(cte: str, body: str) -> str:
    return "WITH " + cte.strip() + "\n" + body.strip()


def median_sql(col: str, src: str = "cohort") -> str:
    return f"(SELECT median({col}) FROM {src})"


def mode_sql(col: str, src: str = "cohort") -> str:
    return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


OUTLIER_COLS = ("age", "annual_contribution", "claim_amount", "expected_refills",
                "refills_received", "num_medications")
INSURANCE_LEVELS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CONDITION_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

_cap_cols = ",\n    ".join(
    f"CAST(CASE WHEN {c} < (SELECT lo_{c} FROM fences) THEN (SELECT lo_{c} FROM fences) "
    f"WHEN {c} > (SELECT hi_{c} FROM fences) THEN (SELECT hi_{c} FROM fences) ELSE CAST({c} AS DOUBLE) END "
    f"AS DOUBLE) AS {c}" for c in OUTLIER_COLS)
_fence_cols = ",\n    ".join(
    f"q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) AS lo_{c}, q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1]) AS hi_{c}"
    for c in OUTLIER_COLS)
_q_cols = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.75]) AS q_{c}" for c in OUTLIER_COLS)
_onehot = ",\n    ".join(
    [f'CAST(coalesce(insurance_type = \'{v}\', false) AS INTEGER) AS "insurance_type_{v}"'
     for v in INSURANCE_LEVELS[1:]] +
    [f'CAST(coalesce(chronic_condition = \'{v}\', false) AS INTEGER) AS "chronic_condition_{v}"'
     for v in CONDITION_LEVELS[1:]])

CLEANED = FEATURES + f""",
imputed AS (
  SELECT patient_id,
    coalesce(age, CAST({median_sql('age')} AS INTEGER)) AS age,
    coalesce(gender, {mode_sql('gender')}) AS gender,
    coalesce(insurance_type, {mode_sql('insurance_type')}) AS insurance_type,
    coalesce(annual_contribution, {median_sql('annual_contribution')}) AS annual_contribution,
    coalesce(claim_amount, {median_sql('claim_amount')}) AS claim_amount,
    expected_refills, refills_received, days_supply,
    coalesce(chronic_condition, {mode_sql('chronic_condition')}) AS chronic_condition,
    num_medications, adherent
  FROM cohort
),
fences_q AS (SELECT {_q_cols} FROM imputed),
fences AS (SELECT {_fence_cols} FROM fences_q),
capped AS (
  SELECT patient_id, gender, insurance_type, chronic_condition, days_supply, adherent,
    {_cap_cols}
  FROM imputed
),
cleaned AS (
  SELECT patient_id, age, annual_contribution, claim_amount, expected_refills, refills_received,
    days_supply, num_medications, adherent,
    CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender_encoded,
    {_onehot}
  FROM capped
),
feature_matrix AS (
  SELECT c.*, f.refill_ratio, f.financial_burden, f.age_group, f.medication_complexity,
         f.supply_category, f.refill_gap
  FROM cleaned c LEFT JOIN features f ON c.patient_id = f.patient_id
)"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


CONFUSION = """
conf AS (
  SELECT model,
    CAST(sum(CASE WHEN y = 0 AND y_hat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 0 AND y_hat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 1 AND y_hat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN y = 1 AND y_hat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM scored GROUP BY model
),
cm AS (
  SELECT model, """ + _div("tp + tn", "tp + tn + fp + fn") + """ AS accuracy,
    """ + _div("tp", "tp + fp") + """ AS precision,
    """ + _div("tp", "tp + fn") + """ AS recall,
    """ + _div("tn", "tn + fp") + """ AS at_risk_recall
  FROM conf
),
cm2 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END
    AS f1_score FROM cm
),
auc_d AS (
  SELECT model, p AS s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
  FROM scored GROUP BY model, p
),
auc_c AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY s
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM auc_d
),
auc AS (
  SELECT model, sum(pos * (below + neg * 0.5)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
  FROM auc_c GROUP BY model
),
ap_d AS (
  SELECT model, 1.0::DOUBLE - p AS s, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN y = 0 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM scored GROUP BY model, 1.0::DOUBLE - p
),
ap_c AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM ap_d
  WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ap AS (
  SELECT model, coalesce(sum(pos * (CAST(cp AS DOUBLE) / CAST(cp + cn AS DOUBLE))) / nullif(CAST(sum(pos) AS DOUBLE), 0), 0.0)
    AS pr_auc_at_risk
  FROM ap_c GROUP BY model
),
model_metrics AS (
  SELECT cm2.model, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall,
         round(at_risk_recall, 4) AS at_risk_recall, round(f1_score, 4) AS f1_score, round(roc_auc, 4) AS roc_auc,
         round(pr_auc_at_risk, 4) AS pr_auc_at_risk
  FROM cm2 JOIN auc ON cm2.model = auc.model JOIN ap ON cm2.model = ap.model
)"""

BI = SCORES + "," + CONFUSION + """,
final_predictions AS (
  SELECT patient_id, y AS actual_adherence, y_hat AS predicted_adherence,
         floor(p * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS adherence_probability,
         CAST(y = y_hat AS INTEGER) AS correct_prediction,
         CASE WHEN y = 1 THEN 'Adherent' WHEN y = 0 THEN 'Non-Adherent' END AS adherence_label,
         CASE WHEN y_hat = 1 THEN 'Adherent' WHEN y_hat = 0 THEN 'Non-Adherent' END AS prediction_label,
         CASE WHEN floor(p * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE > 0.75
                OR floor(p * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE < 0.25 THEN 'High'
              WHEN floor(p * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE > 0.60
                OR floor(p * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE < 0.40 THEN 'Medium'
              ELSE 'Low' END AS confidence
  FROM scored WHERE model = 'ratio_score'
),
tableau_output AS (
  SELECT patient_id, ['Young (18–35)', 'Adult (36–64)', 'Elderly (65+)'][age_group + 1] AS age_group_label,
         insurance_type, adherent
  FROM features
)"""


# R-script feature forms: burden null when contribution is null or <= 0, no clip.
RFEAT = FEATURES + """,
rfeat AS (
  SELECT *, CASE WHEN annual_contribution IS NOT NULL AND annual_contribution > 0
                 THEN claim_amount / annual_contribution END AS burden_r,
         CASE WHEN adherent = 1 THEN 'Adherent' ELSE 'Non-Adherent' END AS adherence_label
  FROM features
)"""
