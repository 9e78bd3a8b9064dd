import numpy as np
import pytest

from cohort_engine.llm import near_vectors as V


def brute(rows, least=0.95):
    """{row number: (id, links, component, kept)}"""
    def fit(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    own = [i for i, (k, v) in enumerate(rows) if fit(k, v)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in own}
    unit = {i: u / np.sqrt(u @ u) for i, u in unit.items()}
    near = {i: [j for j in own if j != i and len(unit[i]) == len(unit[j])
                and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= least)] for i in own}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(rows[j][0] for j in seen) if i in near else k
        out.append((k, len(near.get(i, [])), root, k == root))
    return sorted(out, key=repr)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, 1, "x", 2.0) for k, v in rows], "vec_id long, embedding array<double>, node int, vec string, n_links double")
    return sorted((tuple(r) for r in V.near_vectors(spark, df, **kw).collect()), key=repr)


def family(rng, dim, sizes, noise):
    out = []
    for n in sizes:
        base = rng.standard_normal(dim)
        out += [base + noise * rng.standard_normal(dim) for _ in range(n)]
    return out


@pytest.mark.parametrize("block", [V.BLOCK_NODES, 5])
def test_matches_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    vecs = family(rng, 24, [1] * 60 + [2] * 10 + [40], 0.08) + family(rng, 24, [30], 0.16)
    rows = [(1000 - i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(2000 + i, rows[3][1]) for i in range(50)] + [(2000, rows[3][1]), (5, [2 * x for x in rows[3][1]])]
    assert result(spark, rows, block=block) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (None, [1.0, 0.0]), (9, [1e300, 1e299]), (10, [1e-300, 1e-301]), (11, [-0.0, 3.0]), (12, [0.0, 3.0]), (1, [1.0, 0.0])]
    got = result(spark, rows)
    want = [(k, n, r, True if k is None else kept) for k, n, r, kept in brute(rows)]
    assert got == sorted(want, key=repr)
    assert result(spark, []) == []


def test_recall_at_the_threshold(spark):
    """Pairs just above the least cosine, of 4000 vectors, against all pairs."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((2000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    mate = 0.951 * base + np.sqrt(1 - 0.951**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, mate]))]
    got = result(spark, rows)
    linked = sum(r[1] for r in got) / 2
    unit = np.array([v for _, v in rows])
    true = ((unit @ unit.T >= 0.95).sum() - 4000) / 2
    assert 0.98 * true <= linked <= true


def test_tables_follow_the_nodes():
    bits, tables = V.shape(1 << 20)
    p = 1 - np.arccos(0.95) / np.pi
    assert bits == 24 and 1 - (1 - p**bits) ** tables >= 0.995
    assert V.shape(1 << 30)[1] > tables
