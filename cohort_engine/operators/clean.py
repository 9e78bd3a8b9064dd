"""Cleaning as fit -> transform pairs.

Every ``fit_*`` reads all requested columns together and returns a small frozen
parameter object (a few numbers per column) — the only data
that ever reaches the driver.  Every ``transform`` is a projection.

Quantiles are exact (``quantiles``: radix selection, aggregates of fixed size);
``method='approx'`` asks for ``percentile_approx`` (rank error 1/accuracy).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cohort_engine.functions.scalar import clip
from cohort_engine.operators.quantiles import exact_quantiles


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns by schema."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """String columns by schema."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact") -> dict[str, list]:
    """{column: [quantile per prob]}, None where a column has no value."""
    if method == "approx":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), arr, 100_000).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    return exact_quantiles(df, cols, probs)


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value of each text column, ties to the smallest (None for
    an all-null column).  Values are counted by (column, value), partly before
    the shuffle, so no column's values meet in one task."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("s"))
    n = pairs.select("s.c", "s.v").filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v")).collect()
    return {c: None for c in cols} | {r["c"]: r["v"] for r in best}


# ---------------------------------------------------------------- C1-C3

@dataclass(frozen=True)
class ImputeParams:
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)


def fit_impute(df: DataFrame, num_cols: Sequence[str] | None = None, cat_cols: Sequence[str] | None = None,
               exclude: Sequence[str] = (), method: str = "exact") -> ImputeParams:
    """Medians of numeric columns and modes (ties -> smallest value) of
    categorical columns."""
    num_cols = list(num_cols) if num_cols is not None else numeric_columns(df, exclude)
    cat_cols = list(cat_cols) if cat_cols is not None else categorical_columns(df, exclude)
    med = {c: q[0] for c, q in quantiles(df, num_cols, [0.5], method).items()} if num_cols else {}
    return ImputeParams(med, modes(df, cat_cols))


def impute(df: DataFrame, params: ImputeParams) -> DataFrame:
    """Fill nulls with the fitted values (cast to the column type)."""
    types = dict(df.dtypes)
    repl = {}
    for c, v in {**params.medians, **params.modes}.items():
        if c in types and v is not None:
            repl[c] = F.coalesce(F.col(c), F.lit(v).cast(types[c]))
    return df.withColumns(repl) if repl else df


def null_total(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total remaining nulls over all columns, one pass."""
    cols = list(cols) if cols is not None else df.columns
    total = sum((F.count(F.lit(1)) - F.count(F.col(c)) for c in cols), F.lit(0))
    return df.agg(total.cast("bigint").alias("null_total"))


# ---------------------------------------------------------------- C4

def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Full-row (or subset) de-duplication: one shuffle on the row hash."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def dedup_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows before, after and removed in ONE pass: group by the row (or
    subset), count copies, then sum — a hot duplicate group is pre-merged by
    the map-side partial aggregate."""
    keys = list(subset) if subset else df.columns
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))
    return per.agg(F.sum("__copies").cast("bigint").alias("rows_before"),
                   F.count(F.lit(1)).alias("rows_after")) \
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))


# ---------------------------------------------------------------- C5-C7

@dataclass(frozen=True)
class Fences:
    q1: dict
    q3: dict
    lower: dict
    upper: dict


# The six columns the pipeline caps.
OUTLIER_COLS = ("age", "annual_contribution", "claim_amount", "expected_refills",
                "refills_received", "num_medications")


def fences_frame(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """C5 as a table (column, q1, q3, lower, upper)."""
    cols = [c for c in cols if c in df.columns]
    long = df.sparkSession.createDataFrame(list(quantiles(df, cols, (0.25, 0.75), method).items()), "column string, q array<double>")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return long.select("column", q1.alias("q1"), q3.alias("q3"),
                       (q1 - F.lit(k) * (q3 - q1)).alias("lower"),
                       (q3 + F.lit(k) * (q3 - q1)).alias("upper"))


def fit_fences(df: DataFrame, cols: Sequence[str] = OUTLIER_COLS, k: float = 1.5,
               method: str = "exact") -> Fences:
    """IQR fences Q1 - k*IQR, Q3 + k*IQR with linear-interpolated quartiles;
    absent columns are skipped."""
    rows = fences_frame(df, cols, k, method).collect()
    return Fences({r["column"]: r["q1"] for r in rows}, {r["column"]: r["q3"] for r in rows},
                  {r["column"]: r["lower"] for r in rows}, {r["column"]: r["upper"] for r in rows})


def outlier_counts(df: DataFrame, f: Fences) -> DataFrame:
    """Values outside the fences per column, one pass, long form."""
    cols = list(f.lower)
    row = df.agg(*[F.sum(F.when((F.col(c) < F.lit(f.lower[c])) | (F.col(c) > F.lit(f.upper[c])), 1)
                         .otherwise(0)).cast("bigint").alias(c) for c in cols])
    return row.unpivot([], cols, "column", "outliers")


def cap(df: DataFrame, f: Fences) -> DataFrame:
    """Winsorise at the fences; nulls stay null, row count kept.  The
    column keeps a double type (pandas clip with float fences)."""
    return df.withColumns({c: clip(F.col(c).cast("double"), f.lower[c], f.upper[c]) for c in f.lower})


# ---------------------------------------------------------------- C8-C9

MAX_LEVELS = 10_000


@dataclass(frozen=True)
class Encoder:
    label_levels: dict  # column -> sorted levels (code = position)
    onehot_levels: dict  # column -> sorted levels; the first is dropped


def fit_encoder(df: DataFrame, label_cols: Sequence[str] = (), onehot_cols: Sequence[str] = (),
                max_levels: int = MAX_LEVELS) -> Encoder:
    """Sorted distinct levels per column, one aggregate.  The level set is a
    fitted parameter; its size is checked against ``max_levels`` (collect_set
    is bounded by that check because a high-cardinality column is rejected,
    via an approximate distinct count, before the sets are built)."""
    cols = list(dict.fromkeys(list(label_cols) + list(onehot_cols)))
    if not cols:
        return Encoder({}, {})
    approx = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    big = [c for c in cols if approx[c] > max_levels]
    if big:
        raise ValueError(f"too many levels to encode: {big}")
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first()
    return Encoder({c: list(row[c]) for c in label_cols}, {c: list(row[c]) for c in onehot_cols})


def encode(df: DataFrame, enc: Encoder, drop: Sequence[str] = (), suffix: str = "_encoded") -> DataFrame:
    """C8 label codes (0..k-1 in sorted order) and C9 one-hot columns named
    ``col_value``, first level dropped, null -> all zeros; then drop the
    text columns (and any extra ``drop`` columns, absent ones ignored)."""
    new = {}
    for c, levels in enc.label_levels.items():
        new[f"{c}{suffix}"] = (F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c)) - 1).cast("int")
    for c, levels in enc.onehot_levels.items():
        for v in levels[1:]:
            new[f"{c}_{v}"] = F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int")
    out = df.withColumns(new) if new else df
    to_drop = list(dict.fromkeys(list(enc.label_levels) + list(enc.onehot_levels) + list(drop)))
    return out.drop(*to_drop)


# ---------------------------------------------------------------- C10 + P5

@dataclass(frozen=True)
class Scaler:
    mean: dict
    sd: dict


def scale_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """P5: numeric columns with more than two distinct values.  Exact: min,
    max and a count of values strictly between them (no distinct sets)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    mm = df.agg(*[F.min(c).alias(f"lo__{c}") for c in cols], *[F.max(c).alias(f"hi__{c}") for c in cols]).first()
    inner = df.agg(*[F.count(F.when((F.col(c) > F.lit(mm[f"lo__{c}"])) & (F.col(c) < F.lit(mm[f"hi__{c}"])),
                                    F.col(c))).alias(c) for c in cols
                     if mm[f"lo__{c}"] is not None]).first()
    return [c for c in cols if mm[f"lo__{c}"] is not None and inner[c] > 0]


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Mean and population sd (sd = 0 -> 1) of each column, one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m__{c}") for c in cols], *[F.stddev_pop(c).alias(f"s__{c}") for c in cols]).first()
    sd = {}
    for c in cols:
        s = row[f"s__{c}"]
        sd[c] = 1.0 if s is None or s == 0 else s
    return Scaler({c: row[f"m__{c}"] for c in cols}, sd)


def scale(df: DataFrame, s: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(s.mean[c])) / F.lit(s.sd[c]) for c in s.mean})
