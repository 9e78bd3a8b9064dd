"""Newton steps against a plain numpy fit."""
import math

import numpy as np
import pytest

from cohort_engine.operators import irls, models


def plain(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    info = (x * (p * (1 - p))[:, None]).T @ x
    return b, np.sqrt(np.diag(np.linalg.inv(info))), -2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def frame(spark, x, y, extra=()):
    rows = [(int(b), *map(float, a)) for a, b in zip(x, y)] + list(extra)
    return spark.createDataFrame(rows, "y int, a double, b double, c double")


def test_summary_equals_a_numpy_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 3)) * [1, 4, 0.1] + [0, 5, 1]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 5) / 5)))).astype(float)
    df = frame(spark, x, y, [(1, None, 2.0, 3.0), (None, 1.0, 2.0, 3.0)])
    got = models.glm_summary(df, "y", ["a", "b", "c"]).collect()
    b, se, dev = plain(x, y)
    assert [r["term"] for r in got] == ["(Intercept)", "a", "b", "c"]
    assert np.allclose([r["coefficient"] for r in got], b, rtol=1e-8, atol=1e-8)
    assert np.allclose([r["std_error"] for r in got], se, rtol=1e-8)
    share = y.mean()
    assert got[0]["deviance"] == pytest.approx(dev, rel=1e-10) and got[0]["aic"] == pytest.approx(dev + 8, rel=1e-10)
    assert got[0]["null_deviance"] == pytest.approx(-2 * 600 * (share * math.log(share) + (1 - share) * math.log(1 - share)), rel=1e-10)
    assert got[1]["p_value"] == pytest.approx(math.erfc(abs(b[1] / se[1]) / 2**0.5), rel=1e-6)
    odds = models.odds_ratios(models.glm_summary(df, "y", ["a", "b", "c"])).collect()
    assert odds[1]["odds_ratio"] == pytest.approx(math.exp(b[1]), abs=1e-4)


def test_totals_meet_at_the_optimum(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((300, 3)), rng.integers(0, 2, 300)
    df = frame(spark, x, y)
    got = {r["term"]: r["total"] for r in irls.fitted_totals(df, "y", ["a", "b", "c"], irls.fit(df, "y", ["a", "b", "c"])).collect()}
    assert got["(Intercept)"] == pytest.approx(y.sum(), abs=1e-9) and got["b"] == pytest.approx((x[:, 1] * y).sum(), abs=1e-9)


def test_collinear_separated_and_empty(spark):
    x = np.array([[i, 2 * i, 1.0] for i in range(40)], float)
    y = np.array([i % 3 == 0 for i in range(40)], float)
    f = irls.fit(frame(spark, x, y), "y", ["a", "b", "c"])
    alone = irls.fit(frame(spark, x, y), "y", ["a"])
    assert np.isfinite(f.beta).all() and f.deviance == pytest.approx(alone.deviance, rel=1e-9)
    assert f.beta[1] + 2 * f.beta[2] == pytest.approx(alone.beta[1], rel=1e-6)
    apart = irls.fit(frame(spark, x, (np.arange(40) > 20).astype(float)), "y", ["a"])
    assert np.isfinite(apart.beta).all() and apart.deviance < 1e-3
    with pytest.raises(ValueError):
        irls.fit(frame(spark, x, y).limit(0), "y", ["a"])
