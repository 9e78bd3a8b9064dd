"""Grouped reports, shares, browser filters and KPI rows (A6-A11, A15-A20,
W5-W6, P10, P13, P16).

Every report is one aggregation (map-side partial, then a shuffle on the
group key).  Shares are computed from the aggregated rows; no window ever
runs over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def rate_by(df: DataFrame, target: str, by, se: bool = False, drop_null_group: bool = True,
            pct: bool = False, digits: int | None = None) -> DataFrame:
    """Rate (mean of a 0/1 target) and count per group; optional standard
    error sd/sqrt(n); the null group is dropped (pandas) or kept (R)."""
    by = _list(by)
    src = df.dropna(subset=by) if drop_null_group else df
    rate = F.avg(F.col(target).cast("double"))
    if pct:
        rate = rate * F.lit(100.0)
    if digits is not None:
        rate = F.round(rate, digits)
    aggs = [rate.alias("rate"), F.count(F.lit(1)).alias("n")]
    if se:
        aggs.append((F.stddev_samp(F.col(target).cast("double")) / F.sqrt(F.count(F.col(target))))
                    .alias("se"))
    return src.groupBy(*by).agg(*aggs)


def summary_by(df: DataFrame, by, means: dict[str, int]) -> DataFrame:
    """A10: n plus rounded means per group (nulls skipped by ``avg``)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.round(F.avg(c), d).alias(f"mean_{c}") for c, d in means.items()]
    return df.groupBy(*_list(by)).agg(*aggs)


def group_means(df: DataFrame, value: str, by) -> DataFrame:
    """Mean of a value per group."""
    return df.groupBy(*_list(by)).agg(F.avg(value).alias(f"mean_{value}"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """A5 on a label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def share_within(df: DataFrame, group, by) -> DataFrame:
    """N per (group, by) and n / sum(n) within the group.  The window
    runs over the aggregated rows only (groups x levels)."""
    group, by = _list(group), _list(by)
    counts = df.groupBy(*group, *by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(w))


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Count and share of total per class (window over k class rows)."""
    counts = class_counts(df, label)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cohort_kpis(df: DataFrame, target: str) -> DataFrame:
    """Total, positives, negatives and overall rate in one pass."""
    y = F.col(target)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("positives"),
                  F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("negatives"),
                  F.avg(y.cast("double")).alias("rate"))


def best_by(df: DataFrame, item: str, metric: str, order: str | None = None) -> DataFrame:
    """Max of a metric and the item holding it; ties go to the smallest
    ``order`` value (the first item), or to the smallest item name."""
    tb = F.col(order) if order else F.col(item)
    return df.agg(F.max(metric).alias(f"best_{metric}"),
                  F.min_by(F.col(item), F.struct((-F.col(metric)).alias("m"), tb.alias("t")))
                  .alias(f"best_{item}"))


def metrics_long(df: DataFrame, id_col: str, value_cols: Sequence[str], var_name: str = "metric",
                 value_name: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot([id_col], list(value_cols), var_name, value_name)


def browse(scores: DataFrame, labels: Sequence[str] = (), bands: Sequence[str] = (),
           correct: str | None = None, label_col: str = "prediction_label",
           band_col: str = "confidence", correct_col: str = "correct_prediction") -> DataFrame:
    """P10: predictions browser; an empty selection means no filter."""
    out = scores
    if labels:
        out = out.filter(F.col(label_col).isin(list(labels)))
    if bands:
        out = out.filter(F.col(band_col).isin(list(bands)))
    if correct == "correct":
        out = out.filter(F.col(correct_col) == 1)
    elif correct == "wrong":
        out = out.filter(F.col(correct_col) == 0)
    return out


def browse_kpis(df: DataFrame, correct_col: str = "correct_prediction",
                prob_col: str = "adherence_probability") -> DataFrame:
    """Rows, accuracy, mean probability and correct count of a filtered view."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.avg(F.col(correct_col).cast("double")).alias("accuracy"),
                  F.avg(prob_col).alias("mean_probability"),
                  F.sum(F.col(correct_col)).cast("bigint").alias("correct"))


def report_kpis(df: DataFrame, actual_col: str = "actual_adherence",
                correct_col: str = "correct_prediction") -> DataFrame:
    """KPI row with the max(1, n) guard."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"),
                  (F.lit(100.0) * F.coalesce(F.sum(actual_col), F.lit(0)) / F.greatest(n, F.lit(1)))
                  .alias("adherence_rate"),
                  (F.lit(100.0) * F.coalesce(F.sum(correct_col), F.lit(0)) / F.greatest(n, F.lit(1)))
                  .alias("accuracy"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column (filter choices)."""
    return df.select(col).distinct()


def head_n(df: DataFrame, n: int, key) -> DataFrame:
    """First n rows by key (key order replaces file order)."""
    return df.orderBy(*_list(key)).limit(n)


def feature_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Means of derived features, one job, long form."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "feature", "mean")


def pretty(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns for display (absent names are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
