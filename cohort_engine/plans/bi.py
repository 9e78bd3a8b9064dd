"""BI layer: the three report tables and the dashboard panels as DataFrame
plans over them.

Tables:
  final_predictions  predictions export of the chosen model
  model_metrics      one metric row per model
  tableau_output     cohort with the age-group label

Each panel function reads its own table only; ordered panels keep their order
in the returned DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.functions.scalar import AGE_LABELS
from cohort_engine.operators import features as feat
from cohort_engine.operators import metrics, score
from cohort_engine.sources import bindings

EXPORT_MODEL = "ratio_score"


def tableau_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feat.derive_features(bindings.cohort(spark, sf_dir))
    label = F.element_at(F.array(*[F.lit(v) for v in AGE_LABELS]), F.col("age_group") + 1)
    return f.select("patient_id", label.alias("age_group_label"), "insurance_type", "adherent")


def final_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.predictions_export(bindings.score_table(spark, sf_dir), EXPORT_MODEL, models=bindings.SCORE_MODELS)


def model_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.model_metrics(bindings.score_table(spark, sf_dir))


# -- panels ------------------------------------------------------------------

def _percent(c) -> F.Column:
    return F.round(F.lit(100.0) * F.mean(c), 2)


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: number of scored patients (only the score table's keys are read)."""
    return final_predictions(spark, sf_dir).agg(F.count("*").alias("value"))


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: percent adherent among scored patients."""
    return final_predictions(spark, sf_dir).agg(_percent("actual_adherence").alias("value"))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of correct predictions."""
    return final_predictions(spark, sf_dir).agg(_percent("correct_prediction").alias("value"))


def best_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest ROC-AUC of all models."""
    return model_metrics_table(spark, sf_dir).agg(F.round(F.max("roc_auc"), 4).alias("value"))


def _rates(spark: SparkSession, sf_dir: str, by: str, name: str) -> DataFrame:
    """Percent adherent by group, highest first."""
    grouped = tableau_output(spark, sf_dir).groupBy(F.col(by).alias(name))
    return grouped.agg(_percent("adherent").alias("adherence_rate")).sort(F.desc("adherence_rate"))


def rate_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "age_group_label", "group_name")


def rate_by_insurance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "insurance_type", "insurance_type")


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by confidence band, High, Medium, then the rest."""
    place = F.coalesce(F.array_position(F.array(F.lit("High"), F.lit("Medium")), F.col("confidence")), F.lit(0))
    counts = final_predictions(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("patients"))
    return counts.sort(F.when(place == 0, 3).otherwise(place))


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model, best ROC-AUC first."""
    shown = model_metrics_table(spark, sf_dir).withColumn("accuracy_pct", F.round(F.col("accuracy") * 100, 2))
    return shown.select("model", "accuracy_pct", "precision", "recall", "f1_score", "roc_auc").sort(F.desc("roc_auc"))


PANELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bi_total": total, "bi_rate": rate, "bi_accuracy": accuracy, "bi_best_auc": best_auc, "bi_rate_by_age": rate_by_age,
    "bi_rate_by_insurance": rate_by_insurance, "confidence_distribution": confidence, "bi_metrics_table": metrics_table,
}
