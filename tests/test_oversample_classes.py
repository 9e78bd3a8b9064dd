from cohort_engine.operators import sampling


def counts(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_every_class_reaches_parity_and_null_labels_stay(spark):
    labels = [0] * 40 + [1] * 25 + [2] * 9 + [None] * 3
    df = spark.createDataFrame(list(enumerate(labels)), "k int, y int")
    out = sampling.random_oversample(df, "y", "k", 42)
    assert counts(out) == {0: 40, 1: 40, 2: 40, None: 3}
    assert {tuple(r) for r in out.select("k", "y").collect()} <= set(enumerate(labels))
    only = df.filter("y IS NULL OR y = 1")
    assert counts(sampling.random_oversample(only, "y", "k", 42)) == {1: 25, None: 3}
