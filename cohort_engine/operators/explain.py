"""Local ablation explanations.

Every record is scored as it is and once per feature with that feature at the
population median.  All 1 + F probabilities stand in the record's own row and
its top-n features by |delta| are sorted there, so nothing is exploded before
the result and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.operators.quantiles import exact_quantiles

# Verdict texts and feature display names of the explanation view.
DIRECTION = ("Supports adherence", "Raises risk")
FEATURE_LABELS = {
    "refill_ratio": "Refill ratio",
    "refill_gap": "Refill gap (missed refills)",
    "financial_burden": "Financial burden",
    "claim_amount": "Claim amount",
    "annual_contribution": "Annual contribution",
    "age": "Age",
    "age_group": "Age group",
    "num_medications": "Number of medications",
    "medication_complexity": "Medication complexity",
    "supply_category": "Days-supply category",
    "days_supply": "Days supply",
    "gender_encoded": "Gender",
}


def feature_label(col):
    """Display name of a feature column (the name itself when unmapped)."""
    out = F.col(col)
    for k, v in reversed(list(FEATURE_LABELS.items())):
        out = F.when(F.col(col) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def baseline_medians(df: DataFrame, features: Sequence[str]) -> dict:
    """Exact population medians of the features (fitted parameter)."""
    return {c: q[0] for c, q in exact_quantiles(df, features, [0.5]).items()}


def medians_frame(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(baseline_medians(df, features).items()), "feature string, median double")


def local_drivers(df: DataFrame, scorer: Callable[[DataFrame, dict], DataFrame], key: str,
                  features: Sequence[str], medians: dict, top_n: int = 6, min_abs: float = 1e-4) -> DataFrame:
    """Per record, the top-n features by |p(x) - p(x with feature :=
    median)|, skipping |delta| < ``min_abs``; positive delta supports the
    positive class.  A feature that is at its median already is skipped.
    ``scorer`` adds a probability ``p`` and an array ``p_at`` of the
    probabilities with each feature, in turn, at its median."""
    feats = list(features)
    x = df.select(key, *[F.col(c).cast("double").alias(c) for c in feats])
    scored = scorer(x, {c: medians[c] for c in feats})

    names, at = F.array(*[F.lit(c) for c in feats]), F.array(*[F.lit(medians[c]).cast("double") for c in feats])
    same = F.array(*[F.col(c).eqNullSafe(F.lit(medians[c]).cast("double")) for c in feats])

    def driver(p, i):
        delta = F.col("p") - p
        # |delta| rounded to 12 dp: mathematically equal deltas tie (then by
        # feature name) whatever the last bits of exp() are.
        return F.struct((-F.round(F.abs(delta), 12)).alias("order"), names[i].alias("feature"), at[i].alias("median"),
                        delta.alias("delta"), same[i].alias("same"))

    # one row per record all along: its drivers are sorted inside the row; the
    # scores are read once, as an array, so that no model call is repeated
    found = F.filter(F.transform("p_at", driver), lambda d: ~d["same"] & (F.abs(d["delta"]) >= F.lit(min_abs)))
    top = scored.select(key, F.col("p").alias("base_p"), F.slice(F.array_sort(found), 1, top_n).alias("found"))
    return (top.select(key, "base_p", F.posexplode("found").alias("at", "d"))
            .select(key, (F.col("at") + 1).alias("rank"), "d.feature", feature_label("d.feature").alias("label"),
                    "d.median", "base_p", "d.delta",
                    F.when(F.col("d.delta") > 0, F.lit(DIRECTION[0])).otherwise(F.lit(DIRECTION[1]))
                    .alias("direction")))


def linear_scorer(weights: dict, bias: float) -> Callable[[DataFrame, dict], DataFrame]:
    """Closed-form logistic score p = 1 / (1 + exp(-(b + sum w_f x_f)))."""
    def p(medians: dict):
        z = F.lit(float(bias))
        for c, w in weights.items():
            z = z + F.lit(float(w)) * (F.lit(medians[c]) if c in medians else F.col(c))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    return lambda d, medians: d.withColumns({"p": p({}), "p_at": F.array(*[p({c: m}) for c, m in medians.items()])})


def model_scorer(model: PipelineModel) -> Callable[[DataFrame, dict], DataFrame]:
    """Scores of a fitted pipeline (scaler, assembler, estimator): the record
    is scaled once, then each feature's scaled median takes its place in a
    vector of its own, so a row stays a row."""
    scaler, assembler, estimator = model.stages
    names = assembler.getInputCols()

    def probability(d: DataFrame, inputs: list, out: str) -> DataFrame:
        vec = out + "_vec"
        d = VectorAssembler(inputCols=inputs, outputCol=vec, handleInvalid="keep").transform(d)
        est = estimator.copy({estimator.featuresCol: vec, estimator.probabilityCol: out,
                              estimator.rawPredictionCol: "", estimator.predictionCol: ""})
        return est.transform(d).drop(vec)

    def run(d: DataFrame, medians: dict) -> DataFrame:
        # one row of constants: the medians as the scaler gives them
        one = d.sparkSession.range(1).select(*[F.lit(m).cast("double").alias(c) for c, m in medians.items()])
        scaled = scaler.transform(one).select(*names).first()
        out = probability(scaler.transform(d), names, "__p")
        for c in medians:
            n = c if c in names else c + "__z"
            out = out.withColumn("__median", F.lit(scaled[n]).cast("double"))
            out = probability(out, ["__median" if x == n else x for x in names], "__p_" + c).drop("__median")
        at = lambda c: vector_to_array(F.col(c))[1]
        return out.select(*d.columns, at("__p").alias("p"), F.array(*[at("__p_" + c) for c in medians]).alias("p_at"))

    return run
