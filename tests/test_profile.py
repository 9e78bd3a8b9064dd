"""Exact distinct counts without copies of the rows."""
from cohort_engine.operators import profile


def test_counts_and_plan(spark):
    rows = [(1, 0.0, "a", b"x"), (1, -0.0, None, b"x"), (2, float("nan"), "a ", None), (None, float("nan"), "A", b""), (None, None, "", b"")]
    df = spark.createDataFrame(rows, "k int, `x y` double, s string, b binary")
    for scan in (False, True):
        out = profile.distinct_counts(df, scan=scan)
        got = {r["column"]: (r["rows"], r["non_null"], r["n_distinct"]) for r in out.collect()}
        assert got == {"k": (5, 3, 2), "x y": (5, 4, 2), "s": (5, 4, 4), "b": (5, 4, 2)}
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    old = df.selectExpr("count(distinct k)", "count(distinct s)")
    assert "Expand" in old._jdf.queryExecution().executedPlan().toString()      # the check can fail


def test_defined_cases(spark):
    df = spark.createDataFrame([], "k int, s string")
    assert [(r["column"], r["rows"], r["n_distinct"]) for r in profile.distinct_counts(df).collect()] == [("k", 0, 0), ("s", 0, 0)]
    assert profile.distinct_counts(df, []).count() == 0
    p = profile.profile_columns(df).collect()
    assert [(r["dtype"], r["nulls"], r["null_pct"]) for r in p] == [("int", 0, None), ("string", 0, None)]
    full = spark.range(10).selectExpr("id", "id % 3 AS m")
    exact, near = (sorted(map(tuple, profile.profile_columns(full, distinct=d).collect())) for d in ("exact", "approx"))
    assert exact == near
