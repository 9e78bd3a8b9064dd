"""The join behind the oversampler: what grows with the rows is not broadcast."""
from pyspark.sql import functions as F

from cohort_engine.operators import sampling


def _rows(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("y"), F.rand(1).alias("x"))


def _broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line]


def test_many_draws_are_dealt_by_rank(spark, monkeypatch):
    df = _rows(spark, 900)
    small = {tuple(r) for r in sampling.random_oversample(df, "y", "id").collect()}
    monkeypatch.setattr(sampling, "SENT_DRAWS", 10, raising=False)
    out = sampling.random_oversample(df, "y", "id")
    assert not any("__rk" in line for line in _broadcasts(out))
    assert {tuple(r) for r in out.collect()} == small
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 600, 1: 600}


def test_ranked_rows_are_not_the_side_that_is_sent(spark):
    lines = _broadcasts(sampling.rank_within(_rows(spark, 900), "y", "id"))
    assert lines and all("BuildRight" in line for line in lines)
