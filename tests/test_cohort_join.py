"""The join behind the cohort."""
from cohort_engine.sources import bindings

from places import SF001


def test_customers_do_not_pass_the_driver(spark):
    plan = bindings.cohort(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    assert not any("BroadcastHashJoin" in line and "c_custkey" in line for line in plan.splitlines())
