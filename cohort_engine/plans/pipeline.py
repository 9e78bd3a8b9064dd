"""The batch pipeline stages as lazy plans over the cohort binding:
impute -> (dedup) -> cap -> encode, then features from raw values joined by
key.  Fitted parameters (medians, modes, fences, levels) are computed on all
rows here, as the reference does (Q3); ``fit_on`` lets callers fit on a
train split instead.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.operators import clean
from cohort_engine.operators import features as feat
from cohort_engine.session import cut_lineage

LABEL_COLS = ("gender",)
ONEHOT_COLS = ("insurance_type", "chronic_condition")


@dataclass(frozen=True)
class CleaningParams:
    rules: dict
    impute: clean.ImputeParams
    fences: clean.Fences
    encoder: clean.Encoder


def fit_cleaning(raw: DataFrame, key: str = "patient_id", target: str = "adherent",
                 max_levels: int = clean.MAX_LEVELS) -> CleaningParams:
    """All fitted parameters of the cleaning + feature stages: (1) on the raw
    rows — bucket-range checks, quantile edges and medians (one selection for
    all columns), modes and a level-count bound per categorical; (2) on the
    imputed rows — IQR quartiles and the sorted level sets (built only after
    the bound in (1) holds)."""
    num = clean.numeric_columns(raw, (key, target))
    cat = clean.categorical_columns(raw, (key, target))
    enc_cols = [c for c in (*LABEL_COLS, *ONEHOT_COLS) if c in raw.columns]
    ranges = {c: r for c, r in feat.VALID_RANGES.items() if c in raw.columns}
    probs = [i / 3 for i in range(4)]
    a1 = []
    for c, (lo, hi) in ranges.items():
        a1.append(F.min(F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("int")).alias(f"ok__{c}"))
    a1 += [F.approx_count_distinct(c).alias(f"d__{c}") for c in enc_cols]
    r1 = raw.agg(*a1).first() if a1 else {}
    q = clean.quantiles(raw, list(dict.fromkeys([*ranges, *num])), [*probs, 0.5])
    rules = {c: feat.BucketRule(c, r1[f"ok__{c}"] == 1, tuple(x for x in q[c][:4] if x is not None)) for c in ranges}
    imp = clean.ImputeParams({c: q[c][4] for c in num}, clean.modes(raw, cat))
    big = [c for c in enc_cols if r1[f"d__{c}"] > max_levels]
    if big:
        raise ValueError(f"too many levels to encode: {big}")
    x = clean.impute(raw, imp)
    fcols = [c for c in clean.OUTLIER_COLS if c in raw.columns]
    fences = clean.fit_fences(x, fcols)
    a2 = [F.array_sort(F.collect_set(c)).alias(f"l__{c}") for c in enc_cols]
    r2 = x.agg(*a2).first() if a2 else {}
    enc = clean.Encoder({c: list(r2[f"l__{c}"]) for c in LABEL_COLS if c in enc_cols},
                        {c: list(r2[f"l__{c}"]) for c in ONEHOT_COLS if c in enc_cols})
    return CleaningParams(rules, imp, fences, enc)


def apply_cleaning(raw: DataFrame, p: CleaningParams) -> DataFrame:
    """impute -> cap -> encode with fitted parameters (projections only)."""
    return clean.encode(clean.cap(clean.impute(raw, p.impute), p.fences), p.encoder)


def clean_cohort(raw: DataFrame, key: str = "patient_id", target: str = "adherent",
                 fit_on: DataFrame | None = None, dedup_rows: bool = False) -> DataFrame:
    """Cleaned rows; parameters fitted on ``fit_on`` (default: all rows)."""
    p = fit_cleaning(fit_on if fit_on is not None else raw, key, target)
    x = clean.dedup(raw) if dedup_rows else raw
    return apply_cleaning(x, p)


def prepared(raw: DataFrame, p: CleaningParams) -> DataFrame:
    """F8 of one table: a row's cleaned columns, then the features of its raw
    values.  Projections only, so a row needs no key, no join, and the same
    function serves a stream."""
    out = apply_cleaning(feat.derive_features(raw, p.rules), p)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in feat.FEATURE_COLS], *feat.FEATURE_COLS)


def feature_table(raw: DataFrame, key: str = "patient_id", materialize: bool = True) -> DataFrame:
    """F8: the cleaned rows with features derived from raw values.

    The raw table feeds five parameter fits and the result, so it is
    written once to the shared checkpoint folder (one pass over the source
    tables instead of one per fit)."""
    if materialize:
        raw = cut_lineage(raw)
    return prepared(raw, fit_cleaning(raw, key))


def model_input(raw: DataFrame, key: str = "patient_id", target: str = "adherent") -> DataFrame:
    return feat.model_matrix(feature_table(raw, key), target, key)


def save_cleaning(spark: SparkSession, p: CleaningParams, path: str) -> None:
    """The fitted parameters as one line of JSON, next to the models."""
    line = json.dumps(asdict(p))
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_cleaning(spark: SparkSession, path: str) -> CleaningParams:
    d = json.loads(spark.read.text(path).first()["value"])
    rules = {c: feat.BucketRule(r["column"], r["fixed"], tuple(r["edges"])) for c, r in d["rules"].items()}
    return CleaningParams(rules, clean.ImputeParams(**d["impute"]), clean.Fences(**d["fences"]), clean.Encoder(**d["encoder"]))
