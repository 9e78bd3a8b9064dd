import numpy as np
import pytest

from cohort_engine.llm import topk


def brute(cands, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in cands if ci != qi and len(c) == len(q))
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.BLOCK_ROWS, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BLOCKS_PER_SHARD", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]     # many ties
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "e") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.exact_topk(df, df.filter("vec_id % 5 = 0"), 5).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    asked = list({i: v for i, v in whole if i % 5 == 0}.items())
    assert got == brute(whole, asked, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.5, -1.0]), (None, [1.0, 1.0]), (50, []), (51, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 5, 256 * 128 - 512 * 256), (50, 1, 51, 0)]
    assert topk.exact_topk(df.limit(0), df).count() == 0 and topk.exact_topk(df, df.limit(0)).count() == 0
    big = topk.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**40, 0.0]]))
    assert big.tolist() == [[2**60 + 1, 2**63 - 1]]
