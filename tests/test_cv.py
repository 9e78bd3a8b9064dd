"""Cross-validation of all four models."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohort_engine.operators import models, sampling
from cohort_engine.plans import modeling

from places import SF001


def test_cv_has_a_row_per_model_within_bounds(spark):
    rows = {r["model"]: r for r in E.queries()["cv_auc"](spark, SF001).collect()}
    assert set(rows) == set(models.MODEL_SPECS)
    for r in rows.values():
        assert r["folds"] == 5 and 0.5 < r["cv_auc_mean"] <= 1 and 0 <= r["cv_auc_sd"] < 0.3


def test_oversampling_stays_inside_the_fold(spark):
    train, _ = modeling.train_test(spark, SF001, oversample=False)
    marked = modeling.folds(train, 5)
    assert marked.count() == train.count() and marked.select(modeling.KEY).distinct().count() == train.count()
    own = sampling.random_oversample(marked.filter("fold <> 2"), modeling.LABEL, modeling.KEY, 42)
    assert own.filter("fold = 2").count() == 0
    n = [r["n"] for r in own.groupBy(modeling.LABEL).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 2 and n[0] == n[1]
