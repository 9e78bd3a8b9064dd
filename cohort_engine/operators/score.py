"""Prediction export and record scoring.

The export picks the named model when present, else the first model name
(one-row aggregate joined back on the model key), and adds the display
columns the BI layer reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.functions.scalar import ADHERENCE_LABELS, confidence_band, round_half_up


def pick_model(scores: DataFrame, name: str, model_col: str = "model", models: Sequence[str] | None = None) -> DataFrame:
    """Rows of the named model, or of the first model when it is absent.
    With the short list of ``models`` known, the choice needs no data and the
    filter is an ordinary one; else the names come from one aggregate."""
    if models is not None:
        return scores.filter(F.col(model_col) == (name if name in models else min(models)))
    chosen = scores.agg(F.coalesce(F.max(F.when(F.col(model_col) == F.lit(name), F.col(model_col))),
                                   F.min(model_col)).alias("__chosen"))
    return scores.join(F.broadcast(chosen), scores[model_col] == chosen["__chosen"]).drop("__chosen")


def predictions_export(scores: DataFrame, model: str = "ratio_score", key: str = "patient_id",
                       extra: Sequence[str] = (), models: Sequence[str] | None = None) -> DataFrame:
    """Actual, predicted, probability (4 dp), correct flag, labels
    and confidence band (computed on the rounded probability)."""
    s = pick_model(scores, model, models=models)
    p4 = round_half_up(F.col("p"), 4)
    label = lambda c: F.when(F.col(c) == 1, F.lit(ADHERENCE_LABELS[1])).when(
        F.col(c) == 0, F.lit(ADHERENCE_LABELS[0]))
    return s.select(
        key, *extra,
        F.col("y").alias("actual_adherence"), F.col("y_hat").alias("predicted_adherence"),
        p4.alias("adherence_probability"),
        (F.col("y") == F.col("y_hat")).cast("int").alias("correct_prediction"),
        label("y").alias("adherence_label"), label("y_hat").alias("prediction_label"),
        confidence_band(p4).alias("confidence"))


def align(df: DataFrame, columns: Sequence[str], default=0) -> DataFrame:
    """Align records to a stored column list; missing columns get the
    default (dynamic one-hot width)."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(default).alias(c) for c in columns])
