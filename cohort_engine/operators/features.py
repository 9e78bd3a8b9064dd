"""Feature derivation (F1-F9, F12) and feature assembly (F8).

Derivation is a projection (no shuffle).  The range-validity switch F7
needs one fused aggregate over all checked columns; its result (a flag and
two edges per column) is a fitted parameter collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.functions.scalar import (
    AGE_BOUNDS,
    MED_BOUNDS,
    SUPPLY_BOUNDS,
    SUPPLY_RANGE,
    bucketize,
    guarded_ratio,
    nonneg_gap,
)
from cohort_engine.operators.quantiles import exact_quantiles

FEATURE_COLS = ["refill_ratio", "financial_burden", "age_group", "medication_complexity",
                "supply_category", "refill_gap"]

# Valid ranges that select fixed buckets over quantile buckets.
VALID_RANGES = {
    "age": (0, 120),
    "num_medications": (1, 20),
    "days_supply": (1, 365),
}


def refill_ratio(received="refills_received", expected="expected_refills"):
    return guarded_ratio(received, expected, 0.0, 1.0, "zero")


def financial_burden(claim="claim_amount", contribution="annual_contribution", policy="zero", cap=5.0):
    return guarded_ratio(claim, contribution, 0.0 if cap is not None else None, cap, policy)


def age_group(age="age"):
    return bucketize(age, AGE_BOUNDS)


def medication_complexity(n="num_medications"):
    return bucketize(n, MED_BOUNDS)


def supply_category(days="days_supply"):
    return bucketize(days, SUPPLY_BOUNDS, lowest=SUPPLY_RANGE[0], highest=SUPPLY_RANGE[1])


def refill_gap(expected="expected_refills", received="refills_received"):
    return nonneg_gap(expected, received)


@dataclass(frozen=True)
class BucketRule:
    """Fitted F7 decision for one column: fixed buckets, or 3-quantile edges."""
    column: str
    fixed: bool
    edges: tuple  # (min, e1, e2, max) when not fixed


def fit_bucket_rules(df: DataFrame, ranges: dict | None = None, q: int = 3) -> dict[str, BucketRule]:
    """Per column, is *every* value inside its valid range (null counts as
    outside), plus the quantile edges used otherwise."""
    ranges = ranges or VALID_RANGES
    cols = [c for c in ranges if c in df.columns]
    if not cols:
        return {}
    probs = [i / q for i in range(q + 1)]
    aggs = []
    for c in cols:
        lo, hi = ranges[c]
        aggs.append(F.min(F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("int")).alias(f"{c}__ok"))
    row = df.agg(*aggs).first()
    edges_of = exact_quantiles(df, cols, probs)
    rules = {}
    for c in cols:
        ok = row[f"{c}__ok"]
        edges = tuple(x for x in edges_of[c] if x is not None)
        rules[c] = BucketRule(c, bool(ok == 1), edges)
    return rules


def quantile_bucket(col: str, edges) -> F.Column:
    """Right-closed quantile buckets with the lowest edge included; duplicate
    edges are an error, as in the reference."""
    if len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges must be unique for {col}: {list(edges)}")
    return bucketize(col, list(edges[1:-1]), lowest=edges[0], highest=edges[-1], include_lowest=True)


def derive_features(df: DataFrame, rules: dict[str, BucketRule] | None = None) -> DataFrame:
    """Add the six derived features.  ``rules`` from ``fit_bucket_rules``
    (None = fixed buckets, i.e. the values are known to be in range)."""
    rules = rules or {}

    def bucket(col, fixed_expr):
        r = rules.get(col)
        if r is None or r.fixed:
            return fixed_expr
        return quantile_bucket(col, r.edges)

    return df.withColumns({
        "refill_ratio": refill_ratio(),
        "financial_burden": financial_burden(),
        "age_group": bucket("age", age_group()),
        "medication_complexity": bucket("num_medications", medication_complexity()),
        "supply_category": bucket("days_supply", supply_category()),
        "refill_gap": refill_gap(),
    })


def feature_matrix(raw: DataFrame, cleaned: DataFrame, key: str = "patient_id",
                   check_ranges: bool = True, keep_key: bool = True, rules: dict | None = None) -> DataFrame:
    """F8: features from *raw* values, left-joined to the cleaned rows by key.

    Both sides are keyed, so the join is a 1:1 sort-merge (or broadcast when
    AQE sees a small side); row order is never relied on.
    """
    if rules is None and check_ranges:
        rules = fit_bucket_rules(raw)
    feats = derive_features(raw, rules).select(key, *FEATURE_COLS)
    out = cleaned.drop(*[c for c in FEATURE_COLS if c in cleaned.columns]).join(feats, key, "left")
    return out if keep_key else out.drop(key)


def indicators(df: DataFrame) -> DataFrame:
    """indicator columns used by the inferential GLM."""
    return df.withColumns({
        "gender_male": (F.col("gender") == "Male").cast("int"),
        "elderly": (F.col("age") >= 65).cast("int"),
        "long_supply": (F.col("days_supply") == 90).cast("int"),
        "high_med": (F.col("num_medications") >= 5).cast("int"),
    })


# Factor names, value labels and verdict texts of the scoring page.
FACTOR_NAMES = ("Refill Ratio", "Financial Burden", "Age Group", "Medication Complexity",
                "Supply Category", "Refill Gap")
AGE_SHORT = ("Young", "Adult", "Elderly")
COMPLEXITY_SHORT = ("Low", "Medium", "High")
SUPPLY_SHORT = ("Short(30d)", "Medium(60d)", "Long(90d)")


def _pick(code, labels):
    return F.element_at(F.array(*[F.lit(v) for v in labels]), F.col(code).cast("int") + 1)


def factor_rules(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """rule-based factor verdicts, unpivoted to (key, factor, value, impact).

    Numbers are rounded half-up before formatting so Spark and SQL engines
    print the same text."""
    def r2(c):
        return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.round(F.col(c), 2)))
    ratio, burden = F.col("refill_ratio"), F.col("financial_burden")
    ag, mc, sc, gap = (F.col(c) for c in ("age_group", "medication_complexity", "supply_category",
                                           "refill_gap"))
    rows = [
        (r2("refill_ratio"), F.when(ratio > 0.75, "High ↑").otherwise("Risk ↓")),
        (r2("financial_burden"), F.when(burden > 0.6, "Risk ↑").otherwise("Low ↓")),
        (_pick("age_group", AGE_SHORT), F.when(ag == 1, "Moderate").otherwise("At Risk")),
        (_pick("medication_complexity", COMPLEXITY_SHORT),
         F.when(mc == 0, "Low").when(mc == 1, "Medium").otherwise("High Risk ↑")),
        (_pick("supply_category", SUPPLY_SHORT), F.when(sc == 2, "Positive ↑").otherwise("Neutral")),
        (gap.cast("string"), F.when(gap == 0, "Good ✓").otherwise(F.format_string("Gap of %d ↓", gap))),
    ]
    structs = [F.struct(F.lit(i).alias("factor_rank"), F.lit(name).alias("factor"), v.alias("value"),
                        imp.alias("impact"))
               for i, (name, (v, imp)) in enumerate(zip(FACTOR_NAMES, rows), start=1)]
    return (df.select(key, F.explode(F.array(*structs)).alias("f"))
            .select(key, "f.factor_rank", "f.factor", "f.value", "f.impact"))


def _tokens(name: str) -> list[str]:
    import re
    return [t for t in re.split(r"[^0-9a-z]+", name.lower()) if t]


def model_matrix(df: DataFrame, target: str, key: str | None = None, drop_tokens=("id",),
                 superseded=("expected_refills", "refills_received"), fill=0,
                 substring: bool = False) -> DataFrame:
    """Feature matrix for fitting.

    Drops the target (carried as ``label``), columns whose lower-case name
    contains a drop token (whole tokens by default; ``substring=True``
    reproduces plain substring matching, which also drops e.g. 'medicaid'),
    raw columns superseded by derived ones, and fills remaining nulls with
    ``fill``.  The key is carried through for joins, never used as a feature.
    """
    def dropped(c):
        lc = c.lower()
        return any((t in lc) if substring else (t in _tokens(c)) for t in drop_tokens)
    feats = [c for c in df.columns if c not in (target, key) and not dropped(c) and c not in superseded]
    out = df.select(*([key] if key else []), F.col(target).cast("int").alias("label"), *feats)
    return out.fillna(fill, subset=feats)
