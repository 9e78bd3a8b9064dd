"""Model fitting, scoring and persistence with MLlib (M1-M7, M9, S7, S8, ST6, ST7).

A fitted model is ONE ``PipelineModel``: the population-sd scaler (a
``SQLTransformer`` whose statement carries the fitted means/sds), the
feature assembler (column names and order) and the estimator — so scoring
can never pair a model with the wrong scaler or column list.
"""

from __future__ import annotations

import logging
import math
import os
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.operators import cart, clean, irls
from cohort_engine.session import cut_lineage

log = logging.getLogger(__name__)

# The estimator settings of the four reference models.
LOGISTIC_C = 0.5

# Execution settings only: rows of a training partition.
TASK_ROWS, MOST_TASK_ROWS = 25_000, 250_000
FEW_PARTS = 4                   # so many are left as they come


def _logistic(n_train: int):
    # sklearn's L2 penalty 1/(2C)||w||^2 on the summed loss equals MLlib's
    # regParam/2 ||w||^2 on the mean loss with regParam = 1/(C n).
    return LogisticRegression(maxIter=1000, regParam=1.0 / (LOGISTIC_C * max(n_train, 1)),
                              elasticNetParam=0.0, standardization=False)


# Execution settings only (not model settings): more tree nodes per data pass
# and cached node ids, i.e. fewer passes over the training data per level.
_TREE_EXEC = {"maxMemoryInMB": 1024, "cacheNodeIds": True}

EXACT_TREE = "Decision Tree"
# The reference's least sizes of a node to split (15 and 20 rows) follow from the
# least sizes of the leaves: two of 8 make 16, two of 10 make 20.
MODEL_SPECS = {
    "Logistic Regression": _logistic,
    EXACT_TREE: None,                               # operators.cart
    "Random Forest": lambda n: RandomForestClassifier(numTrees=200, maxDepth=8, minInstancesPerNode=8,
                                                      featureSubsetStrategy="sqrt", seed=42, **_TREE_EXEC),
    "Gradient Boosting": lambda n: GBTClassifier(maxIter=150, stepSize=0.08, maxDepth=4, subsamplingRate=0.8,
                                                 minInstancesPerNode=10, seed=42, **_TREE_EXEC),
}


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scaler_stage(train: DataFrame, features: Sequence[str], scale: bool = True) -> tuple[SQLTransformer, list[str]]:
    """C10 + P5 as a pipeline stage: columns with > 2 distinct values are
    standardised with train mean / population sd; the rest pass through."""
    cols = clean.scale_columns(train, list(features)) if scale else []
    s = clean.fit_scaler(train, cols) if cols else clean.Scaler({}, {})
    out_names, exprs = [], []
    for c in features:
        if c in s.mean:
            z = f"{c}__z"
            exprs.append(f"(CAST({_q(c)} AS DOUBLE) - CAST('{s.mean[c]!r}' AS DOUBLE)) / "
                         f"CAST('{s.sd[c]!r}' AS DOUBLE) AS {_q(z)}")
            out_names.append(z)
        else:
            out_names.append(c)
    stmt = "SELECT *" + "".join(", " + e for e in exprs) + " FROM __THIS__"
    return SQLTransformer(statement=stmt), out_names


def dealt(rows: DataFrame) -> DataFrame:
    """Training rows, written once.  The planner packs them by bytes, half a
    million rows to a few tasks or a thousand to many; boosting runs a job per
    tree level, so here a partition has ``TASK_ROWS`` of them, on every core if
    there are enough, and never more than ``MOST_TASK_ROWS``."""
    rows = cut_lineage(rows)
    n, have = rows.count(), rows.rdd.getNumPartitions()
    parts = max(min(math.ceil(n / TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), math.ceil(n / MOST_TASK_ROWS), 1)
    if parts <= have <= max(parts, FEW_PARTS):
        return rows
    return cut_lineage(rows.repartition(parts))


@dataclass(frozen=True)
class Ready:
    """Training rows as MLlib's estimators take them: scaler and assembler, and
    what they make of the rows, written once for all estimators and iterations."""
    stages: tuple
    rows: DataFrame
    n: int


def ready(train: DataFrame, features: Sequence[str], label: str = "label", scale: bool = True) -> Ready:
    sql, names = scaler_stage(train, features, scale)
    asm = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    rows = cut_lineage(asm.transform(sql.transform(train)).select(label, "features"))
    return Ready((sql, asm), rows, rows.count())


def fit_model(train: DataFrame, features: Sequence[str], name: str, label: str = "label",
              scale: bool = True, made: Ready | None = None) -> PipelineModel:
    """Fit one named model spec as a PipelineModel (scaler + assembler + estimator);
    the exact tree compares the columns as they are, without a scaler.
    ``made``: ``ready`` of the same arguments, for several models."""
    if name == EXACT_TREE:
        return cart.pipeline_model(cart.fit(train, label, features, max_depth=6, min_split=20, min_leaf=10))
    made = made or ready(train, features, label, scale)
    est = MODEL_SPECS[name](made.n).setLabelCol(label).setFeaturesCol("features")
    return PipelineModel([*made.stages, est.fit(made.rows)])


def score(model: PipelineModel, df: DataFrame, key: str, label: str = "label", name: str = "model",
          threshold: float = 0.5) -> DataFrame:
    """M6: probability of class 1 and the hard prediction, one transform."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    return out.select(F.lit(name).alias("model"), key, F.col(label).cast("int").alias("y"), p.alias("p"),
                      (p >= F.lit(threshold)).cast("int").alias("y_hat"))


def score_all(models: dict[str, PipelineModel], df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """M7: long score table (model, key, y, p, y_hat) for all models."""
    parts = [score(m, df, key, label, nm) for nm, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(spark, model: PipelineModel, top: int | None = 15) -> DataFrame:
    """M9: importances of a tree model by feature name, descending, ranked.
    The importance vector is a fitted parameter (one number per feature)."""
    est = model.stages[-1]
    names = [n[:-3] if n.endswith("__z") else n for n in model.stages[1].getInputCols()]
    imp = est.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda r: (-r[1], r[0]))
    if top:
        rows = rows[:top]
    return spark.createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    """One PipelineModel directory per model name."""
    for nm, m in models.items():
        m.write().overwrite().save(os.path.join(path, nm.replace(" ", "_")))


def load_models(path: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    """Load every model that exists; warn and skip missing or broken ones."""
    out = {}
    for nm in names:
        p = os.path.join(path, nm.replace(" ", "_"))
        try:
            out[nm] = PipelineModel.load(p)
        except Exception as e:  # noqa: BLE001 - a bad model must not stop the others
            log.warning("could not load model %s from %s: %s", nm, p, e)
    return out


def glm_summary(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """ST6: inferential binomial GLM (logit): coefficient, SE, z, p per term
    plus deviance and AIC, from Newton steps (``irls``); rows with a null in
    any column are left out."""
    m = irls.fit(df, label, features)
    se = np.sqrt(np.clip(np.diag(m.inverse), 0.0, None))
    rows = []
    for t, c, e in zip(m.terms, m.beta.tolist(), se.tolist()):
        z = c / e if e else None
        p = None if z is None else math.erfc(abs(z) / math.sqrt(2))
        rows.append((t, c, e, z, p, m.deviance, m.null_deviance, m.deviance + 2 * len(m.terms)))
    return df.sparkSession.createDataFrame(
        rows, "term string, coefficient double, std_error double, z double, p_value double, "
              "deviance double, null_deviance double, aic double")


def odds_ratios(summary: DataFrame, digits: int = 4) -> DataFrame:
    """ST7: exp(coefficient), rounded."""
    return summary.select("term", F.round("coefficient", digits).alias("coefficient"),
                          F.round(F.exp("coefficient"), digits).alias("odds_ratio"))
