"""Train/test setup for the model queries.

model input (cleaned + features), checkpointed into the shared checkpoint
folder (the one materialisation point of the batch pipeline, so a lost
executor recomputes from it, not from the raw scan) -> exact stratified split
(comparisons with one cut per class) -> oversampled train -> fitted PipelineModels.  Fitted models are kept
per (data dir, model) within the process so several queries reuse a fit.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_engine.operators import metrics, models, sampling
from cohort_engine.plans import pipeline
from cohort_engine.session import cut_lineage
from cohort_engine.sources import bindings

KEY, LABEL = "patient_id", "label"
FITS = 8                        # model fits that run at a time
_SPLITS: dict = {}
_TRAIN: dict = {}
_FITTED: dict = {}


def _app(spark: SparkSession) -> str:
    """Cache scope: one Spark application (a restarted session never sees
    DataFrames or models of a stopped one)."""
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (_app(spark), sf_dir)
    if k not in _SPLITS:
        mi = pipeline.model_input(bindings.cohort(spark, sf_dir), KEY, "adherent")
        _SPLITS[k] = sampling.stratified_split(cut_lineage(mi), LABEL, KEY, 0.2, 42)
    return _SPLITS[k]


def cleaning(spark: SparkSession, sf_dir: str) -> pipeline.CleaningParams:
    """The fitted parameters behind ``split_table``."""
    return pipeline.fit_cleaning(cut_lineage(bindings.cohort(spark, sf_dir)), KEY, "adherent")


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (KEY, LABEL, "split", "draw")]


def train_test(spark: SparkSession, sf_dir: str, oversample: bool = True):
    s = split_table(spark, sf_dir)
    train = s.filter(F.col("split") == "train").drop("split")
    test = s.filter(F.col("split") == "test").drop("split")
    if oversample:
        train = train_rows(spark, sf_dir, train)
    return train, test


def train_rows(spark: SparkSession, sf_dir: str, train: DataFrame) -> DataFrame:
    """The oversampled training side, written once for all models."""
    k = (_app(spark), sf_dir)
    if k not in _TRAIN:
        _TRAIN[k] = models.dealt(sampling.random_oversample(train, LABEL, KEY, 42).drop("draw"))
    return _TRAIN[k]


def fit_all(spark: SparkSession, sf_dir: str, names) -> dict:
    """The named models, those not fitted yet next to each other: most jobs of
    a fit are short, and Spark schedules them together."""
    key = lambda name: (_app(spark), sf_dir, name)
    todo = [n for n in names if key(n) not in _FITTED]
    if todo:
        train, _ = train_test(spark, sf_dir)
        feats = feature_names(train)
        made = models.ready(train, feats, LABEL) if any(n != models.EXACT_TREE for n in todo) else None
        fits = _side_by_side(spark, [lambda n=n: models.fit_model(train, feats, n, LABEL, made=made) for n in todo])
        _FITTED.update({key(n): m for n, m in zip(todo, fits, strict=True)})
    return {n: _FITTED[key(n)] for n in names}


def _side_by_side(spark: SparkSession, calls: list) -> list:
    """Results of the calls, ``FITS`` of which run at a time."""
    carry = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, min(FITS, len(calls)))) as pool:
        return [f.result() for f in [pool.submit(carry(c)) for c in calls]]


def fitted(spark: SparkSession, sf_dir: str, name: str):
    return fit_all(spark, sf_dir, [name])[name]


def test_scores(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    _, test = train_test(spark, sf_dir)
    return models.score_all(fit_all(spark, sf_dir, names), test, KEY, LABEL)


def folds(train: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """The training rows with their fold, written once."""
    return cut_lineage(sampling.stratified_folds(train, LABEL, KEY, k, seed))


def cross_validate(train: DataFrame, names, k: int = 5, seed: int = 42) -> DataFrame:
    """M5: per model the mean and population sd of the held-out ROC-AUC over
    ``k`` folds.  Every fold's training rows are oversampled by themselves, so
    no copy of a held-out row is trained on; the fits of all folds run next to
    each other and Spark schedules their jobs."""
    marked = folds(train, k, seed)
    feats = feature_names(train)
    spark, names = train.sparkSession, list(names)

    def rows(fold: int) -> tuple:
        own = marked.filter(F.col("fold") != fold).drop("fold")
        own = models.dealt(sampling.random_oversample(own, LABEL, KEY, seed).drop("draw"))
        return own, models.ready(own, feats, LABEL) if set(names) != {models.EXACT_TREE} else None

    sides = _side_by_side(spark, [lambda f=f: rows(f) for f in range(k)])
    # the longest fits first: the last of ``MODEL_SPECS``
    order = sorted(names, key=list(models.MODEL_SPECS).index, reverse=True)
    asked = [(name, f) for name in order for f in range(k)]
    fits = dict(zip(asked, _side_by_side(spark, [
        lambda n=n, f=f: models.fit_model(sides[f][0], feats, n, LABEL, made=sides[f][1]) for n, f in asked]), strict=True))
    parts = [models.score_all({n: fits[n, f] for n in names}, marked.filter(F.col("fold") == f).drop("fold"), KEY, LABEL)
             .withColumn("fold", F.lit(f)) for f in range(k)]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    auc = metrics.roc_auc(scores, ["model", "fold"])
    return auc.groupBy("model").agg(F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_sd"),
                                    F.count(F.lit(1)).alias("folds"))


def publish_split(spark: SparkSession, sf_dir: str, path: str, which: str = "test") -> None:
    """Write one side of the keyed split as a parquet table (key, label
    and model columns), so downstream reports read exactly the held-out rows."""
    s = split_table(spark, sf_dir)
    s.filter(F.col("split") == which).drop("split").write.mode("overwrite").parquet(path)
