"""Physical-plan properties: pushdown/pruning, no single-partition global
windows in ranking metrics, fused aggregates."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohort_engine.operators import metrics
from cohort_engine.sources import bindings

from places import SF01


def plan(df):
    """The plan that ran, exchanges included."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pruning(spark):
    p = bindings.cohort(spark, SF01)._jdf.queryExecution().sparkPlan().toString()
    # only the four customer columns are read
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double,c_mktsegment:string>" in p


def test_ranking_metrics_do_not_use_single_partition(spark):
    s = bindings.claims_scores(spark, SF01)
    for df in (metrics.roc_auc(s), metrics.average_precision(s), metrics.roc_points(s)):
        assert "SinglePartition" not in plan(df)
    whole = s.withColumn("r", F.row_number().over(Window.orderBy("p"))).filter("r % 20000 = 1")
    assert "SinglePartition" in plan(whole)     # the check can fail


def test_panels_read_the_cohort_once(spark):
    from cohort_engine.plans import bi
    # customer, orders, nation, region: once each
    assert plan(bi.total(spark, SF01)).split("== Initial Plan ==")[0].count("FileScan parquet") <= 4


def test_filter_pushed_to_scan(spark):
    from cohort_engine.sources.tables import table
    df = table(spark, SF01, "lineitem", ["l_orderkey", "l_returnflag"]).filter(F.col("l_returnflag") == "R")
    txt = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in txt
