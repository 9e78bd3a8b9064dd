"""The tree against a plain numpy CART."""
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from cohort_engine.operators import cart, models


def plain(x, y, depth, min_split, min_leaf, node=1, out=None):
    """node -> (feature, threshold), all thresholds tried one by one."""
    out = {} if out is None else out
    n = len(y)
    if depth == 0 or n < min_split or y.min() == y.max():
        return out
    best = None
    for f in range(x.shape[1]):
        vals = np.unique(x[:, f])
        for a, b in zip(vals, vals[1:]):
            left = x[:, f] <= a
            sides = [y[left], y[~left]]
            if min(map(len, sides)) < min_leaf:
                continue
            purity = sum((float(s.sum()) ** 2 + float(len(s) - s.sum()) ** 2) / len(s) for s in sides)
            if best is None or purity > best[0]:
                best = (purity, f, a / 2 + b / 2, left)
    if best:
        out[node] = best[1:3]
        plain(x[best[3]], y[best[3]], depth - 1, min_split, min_leaf, 2 * node, out)
        plain(x[~best[3]], y[~best[3]], depth - 1, min_split, min_leaf, 2 * node + 1, out)
    return out


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))],
                                 "id long, y int, " + ", ".join(f"`c {j}` double" for j in range(x.shape[1])))


@pytest.mark.parametrize("seed, min_split, min_leaf", [(1, 2, 1), (2, 20, 10), (3, 90, 10)])
def test_equals_a_plain_tree(spark, seed, min_split, min_leaf):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.standard_normal(400), rng.integers(0, 4, 400), rng.integers(0, 2, 400), np.ones(400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1] + 1))).astype(int)
    names = [f"c {j}" for j in range(4)]
    df = frame(spark, x, y)
    tree = cart.fit(df, "y", names, 4, min_split, min_leaf)
    want = plain(x, y, 4, min_split, min_leaf)
    assert {k: (s.feature, s.threshold) for k, s in tree.splits.items()} == want
    assert all(tree.counts[k][0] >= min_split for k in tree.splits)
    assert sum(tree.importances().values()) == pytest.approx(1.0) and tree.importances()["c 3"] == 0.0
    got = cart.pipeline_model(tree).transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()
    for r in got:
        k = 1
        while k in want:
            k = 2 * k + int(x[r["id"], want[k][0]] > want[k][1])
        assert r["p"] == tree.probability(k)


def test_nulls_pure_and_empty(spark):
    rows = [(0, i % 2, float(i % 2), 1.0) for i in range(30)] + [(1, None, 0.0, 1.0), (1, 1, None, 1.0), (1, 1, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    tree = cart.fit(df, "y", ["a", "b"])
    assert tree.splits == {1: cart.Split(0, 0.5)} and tree.counts == {1: (30, 15), 2: (15, 0), 3: (15, 15)}
    p = cart.pipeline_model(tree).transform(df.filter("id = 1")).select("a", vector_to_array("probability")[1].alias("p")).collect()
    assert all(r["p"] == (0.0 if r["a"] == 0.0 else 1.0) for r in p)
    assert cart.fit(df.filter("y = 1"), "y", ["a", "b"]).splits == {} and cart.fit(df, "y", []).splits == {}
    assert cart.fit(df.filter("id = 0"), "y", ["b"]).splits == {}
    with pytest.raises(ValueError):
        cart.fit(df.limit(0), "y", ["a"])


def test_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(y, v) for y, v in [(0, -inf), (1, 1.0), (0, inf)] for _ in range(5)], "y int, a double")
    tree = cart.fit(df, "y", ["a"], 3, 2, 1)
    assert sorted(s.threshold for s in tree.splits.values()) == [-inf, 1.0] and all(tree.probability(k) in (0.0, 1.0) for k in tree.counts if k not in tree.splits)


def test_saved_and_loaded(spark, tmpdir_path):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((200, 2)), rng.integers(0, 2, 200)
    df = frame(spark, x, y)
    m = models.fit_model(df, ["c 0", "c 1"], "Decision Tree", "y")
    models.save_models({"Decision Tree": m}, tmpdir_path)
    again = models.load_models(tmpdir_path, ["Decision Tree"])["Decision Tree"]
    a, b = (sorted(map(tuple, models.score(k, df, "id", "y").collect())) for k in (m, again))
    assert a == b
