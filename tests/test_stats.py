"""Statistical tests against direct numpy computation and published tails."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort_engine.functions import distributions as d
from cohort_engine.operators import stats


def test_tail_values():
    assert d.t_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-7)
    assert d.chi2_upper([3.841459], [1])[0] == pytest.approx(0.05, abs=1e-6)
    assert d.f_upper([4.102821], [2], [10])[0] == pytest.approx(0.05, abs=1e-6)
    assert d.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)
    assert d.tukey_upper([3.577935], [3], [20])[0] == pytest.approx(0.05, abs=1e-5)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 400)
    x = rng.normal(0, 1, 400) + 0.3 * g
    lab = (rng.random(400) < 0.4).astype(int)
    rows = [(int(a), float(b), int(c), ["u", "v", "w", "z"][i % 4]) for i, (a, b, c) in enumerate(zip(g, x, lab))]
    return spark.createDataFrame(rows, "g int, x double, lab int, cat string"), g, x, lab


def test_welch(data):
    df, g, x, lab = data
    r = stats.welch_t(df, ["x"], "lab", pvalues=True).first()
    a, b = x[lab == 1], x[lab == 0]
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert r["t"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert r["df"] == pytest.approx((va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1)))
    assert 0 <= r["p_value"] <= 1


def test_anova(data):
    df, g, x, lab = data
    r = stats.anova_oneway(df, "x", "g", pvalues=True).first()
    grand = x.mean()
    ssb = sum((g == k).sum() * (x[g == k].mean() - grand) ** 2 for k in range(3))
    ssw = sum(((x[g == k] - x[g == k].mean()) ** 2).sum() for k in range(3))
    assert r["ss_between"] == pytest.approx(ssb)
    assert r["f"] == pytest.approx((ssb / 2) / (ssw / (len(x) - 3)))


def test_chi2(data):
    df, g, x, lab = data
    r = stats.chi2_independence(df, "cat", "lab").first()
    cat = np.array(["u", "v", "w", "z"] * 100)
    obs = np.array([[((cat == c) & (lab == v)).sum() for v in (0, 1)] for c in "uvwz"], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    assert r["chi2"] == pytest.approx(((obs - exp) ** 2 / exp).sum())
    assert r["df"] == 3


def test_tukey_pairs(data):
    df, g, x, lab = data
    rows = {r["comparison"]: r for r in stats.tukey_pairs(df, "x", "g", levels=[0, 1, 2], pvalues=True).collect()}
    assert set(rows) == {"1-0", "2-0", "2-1"}
    assert rows["2-0"]["diff"] == pytest.approx(x[g == 2].mean() - x[g == 0].mean())


def test_corr_pairwise_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 2.0), (4.0, 7.9, 2.5)],
                               "a double, b double, c double")
    m = {(r["var1"], r["var2"]): r["r"] for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "c")] == pytest.approx(np.corrcoef([2, 3, 4], [1, 2, 2.5])[0, 1])
    assert m[("a", "a")] == 1.0 and m[("b", "a")] == m[("a", "b")]


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 12)) @ rng.normal(size=(12, 12)) + 1e6 * np.arange(12)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 11] = 0.1
    x[:, 10] = np.nan
    cols = [f"x.{i}" for i in range(12)]
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    df = spark.createDataFrame(pdf).toDF(*cols).repartition(7)
    df = df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c.replace(".", "_")) for c in cols])
    got = {(r["var1"], r["var2"]): r["r"] for r in stats.corr_matrix(df, df.columns).collect()}
    assert len(got) == 144
    for i in range(12):
        for j in range(12):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[f"x_{i}", f"x_{j}"]
            if 10 in (i, j) or 11 in (i, j):
                assert r is None
            elif i == j:
                assert r == 1.0
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    some = df.columns[:4]
    whole = x[:, :4][~np.isnan(x[:, :4]).any(1)]
    got = {(r["var1"], r["var2"]): r["r"] for r in stats.corr_matrix(df, some, nulls="listwise").collect()}
    assert got["x_0", "x_3"] == pytest.approx(np.corrcoef(whole[:, 0], whole[:, 3])[0, 1], abs=1e-9)
    assert all(r["r"] is None for r in stats.corr_matrix(df.limit(0), some).collect())
