"""Training rows: dealt by their number, written once, models fitted together."""
from cohort_engine.operators import models
from cohort_engine.plans import modeling

from places import SF001


def test_partitions_follow_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    n = models.TASK_ROWS * 3 + 1
    one = models.dealt(spark.range(n).coalesce(1))
    assert one.rdd.getNumPartitions() == max(min(4, cores), 1) and one.count() == n
    sizes = one.rdd.glom().map(len).collect()
    assert max(sizes) - min(sizes) <= 2 * len(sizes)
    many = models.dealt(spark.range(0, 600, 1, 40))
    assert many.rdd.getNumPartitions() <= models.FEW_PARTS and many.agg({"id": "sum"}).first()[0] == 599 * 300
    assert models.dealt(spark.range(0)).count() == 0


def test_training_rows_are_made_once(spark):
    one, two = (modeling.train_test(spark, SF001)[0] for _ in range(2))
    assert one is two


def test_models_of_one_call_equal_single_fits(spark):
    train, test = modeling.train_test(spark, SF001)
    feats = modeling.feature_names(train)
    both = modeling.fit_all(spark, SF001, ["Logistic Regression", "Decision Tree"])
    for name, model in both.items():
        alone = models.fit_model(train, feats, name, modeling.LABEL)
        p = [{r[modeling.KEY]: r["p"] for r in models.score(m, test, modeling.KEY).collect()} for m in (model, alone)]
        assert p[0].keys() == p[1].keys() and all(abs(p[0][k] - p[1][k]) < 1e-9 for k in p[0])
