"""Record scoring for batch or Structured Streaming.

``score_profiles`` is stateless (projections + one model transform), so the
same function serves a batch DataFrame and a ``readStream`` source: no
watermark, window or state is involved.  ``start_scoring_stream`` wires it to
a file source and a parquet sink with a checkpoint location, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohort_engine.functions.scalar import ADHERENCE_LABELS, guarded_ratio, risk_band
from cohort_engine.operators import features as feat
from cohort_engine.operators.score import align
from cohort_engine.plans import pipeline

CATEGORICALS = ("gender", "insurance_type", "chronic_condition")


def model_columns(model: PipelineModel) -> list[str]:
    """Raw input columns the pipeline expects (scaled names map back)."""
    return [c[:-3] if c.endswith("__z") else c for c in model.stages[1].getInputCols()]


def profile_matrix(profiles: DataFrame, columns: list[str], key: str = "patient_id") -> DataFrame:
    """Derive the model's columns from raw profiles with the pipeline's own
    feature functions; dummies ``col_level`` and the gender code are rebuilt
    from the column names; anything absent defaults to 0 (P12)."""
    f = feat.derive_features(profiles).withColumns({
        # the scoring page guards denominators with max(den, 1)
        "refill_ratio": guarded_ratio("refills_received", "expected_refills", None, 1.0, "floor1"),
        "financial_burden": guarded_ratio("claim_amount", "annual_contribution", None, 5.0, "floor1"),
    })
    extra = {}
    for c in columns:
        if c == "gender_encoded" and "gender" in f.columns:
            extra[c] = (F.col("gender") == F.lit("Male")).cast("int")
            continue
        for cat in CATEGORICALS:
            if c.startswith(cat + "_") and cat in f.columns and c not in f.columns:
                extra[c] = F.coalesce(F.col(cat) == F.lit(c[len(cat) + 1:]), F.lit(False)).cast("int")
    f = f.withColumns(extra) if extra else f
    return align(f, [key, *columns]).fillna(0, subset=list(columns))


def _scored(x: DataFrame, model: PipelineModel, key: str, threshold: float) -> DataFrame:
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(x).select(
        key, p.alias("probability"), (p >= F.lit(threshold)).cast("int").alias("prediction"),
        F.when(p >= F.lit(threshold), F.lit(ADHERENCE_LABELS[1])).otherwise(F.lit(ADHERENCE_LABELS[0]))
        .alias("prediction_label"),
        (F.lit(1.0) - p).alias("risk"), risk_band(p).alias("band"))


def score_profiles(profiles: DataFrame, model: PipelineModel, key: str = "patient_id",
                   threshold: float = 0.5) -> DataFrame:
    """M8: probability, decision, risk and display band per profile, as the
    scoring page builds its columns (no imputation, no capping)."""
    return _scored(profile_matrix(profiles, model_columns(model), key), model, key, threshold)


def score_records(records: DataFrame, model: PipelineModel, cleaning: pipeline.CleaningParams, key: str = "patient_id",
                  threshold: float = 0.5) -> DataFrame:
    """M8 for records of the training table's form: imputed, capped and encoded
    with the fitted parameters, then scored; a record gets the probability that
    the batch pipeline gives it.  Batch or stream; unknown levels are all zeros
    (null for a label code, filled with 0), missing columns of the model 0."""
    columns = model_columns(model)
    x = align(pipeline.prepared(records, cleaning), [key, *columns]).fillna(0, subset=columns)
    return _scored(x, model, key, threshold)


def start_scoring_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType,
                         sink_dir: str, checkpoint: str, key: str = "patient_id", available_now: bool = True,
                         cleaning: pipeline.CleaningParams | None = None):
    """Stream new files through the scorer into a parquet sink: profiles, or
    with ``cleaning`` records of the training table's form."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    scored = score_profiles(src, model, key) if cleaning is None else score_records(src, model, cleaning, key)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
