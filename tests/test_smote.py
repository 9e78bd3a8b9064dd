"""Nearest neighbours inside a class and synthetic rows, against plain loops."""
import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cohort_engine.operators import smote

F3 = ["a", "b", "c"]


def rows(seed, n=240):
    rng = random.Random(seed)
    out = [(i, rng.choice([0, 0, 0, 1, 2, None]), float(rng.randrange(8)), rng.random(), rng.choice([None, 1.0, 2.0, 3.5]) if rng.random() < 0.2 else 1.0)
           for i in range(n)]
    return out + [(None, 1, 1.0, 0.5, 1.0), (900, 1, float("nan"), 0.5, 1.0), (901, 1, float("inf"), 0.5, 1.0), (902, 7, 1.0, 1.0, 1.0)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, y int, a double, b double, c double")


def brute(data, k):
    fit = [r for r in data if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[2:])]
    out = {}
    for r in fit:
        near = sorted((((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2) + (r[4] - s[4]) ** 2, s[0]) for s in fit if s[1] == r[1] and s[0] != r[0])
        out[r[0]] = near[:k]
    return fit, out


@pytest.mark.parametrize("block", [smote.BLOCK_ROWS, 7])
def test_neighbours(spark, block):
    data = rows(3)
    got = {}
    for r in smote.smote_knn(frame(spark, data), "y", "id", F3, 5, block_rows=block).collect():
        got.setdefault(r["key"], {})[r["rank"]] = (r["distance2"], r["neighbour"])
    want = {i: {n + 1: x for n, x in enumerate(near)} for i, near in brute(data, 5)[1].items() if near}
    assert got == want


def test_far_blocks_do_not_meet(spark):
    """Blocks out of reach along the widest feature are left out, rows are not."""
    data = [(i, 1, float(i * 10), 0.1 * (i % 3), 1.0) for i in range(200)]
    knn = smote.smote_knn(frame(spark, data), "y", "id", F3, 2, block_rows=10)
    got = {(r["key"], r["rank"]): r["neighbour"] for r in knn.collect()}
    want = {(i, n + 1): x[1] for i, near in brute(data, 2)[1].items() for n, x in enumerate(near)}
    assert got == want
    ends = [(i, float(i * 100), float(i * 100 + 90)) for i in range(20)]
    number, lo, hi = (np.array(c) for c in zip(*ends))
    one = pa.RecordBatch.from_pydict({"cls": ["1"], "block": [5], "lo": [500.0], "hi": [590.0], "reach": [20.1], "bound": [b""], "ids": [b""], "data": [b""]})
    met = [n for b in smote._targets(SimpleNamespace(value={"1": (number, lo, hi)}))([one]) for n in b.column(1).to_pylist()]
    assert met == [4, 5, 6]


def test_synthetic_rows(spark):
    data = rows(5)
    df = frame(spark, data)
    out = smote.smote_oversample(df, "y", "id", F3, 5)
    made = [r for r in out.collect() if r["draw"] is not None]
    fit, near = brute(data, 5)
    by = {r[0]: r for r in fit}
    sizes = {}
    for r in data:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    most = max(v for c, v in sizes.items() if c is not None)
    for c in (0, 1, 2, 7):
        assert sum(r["y"] == c for r in made) == most - sizes[c]
    for r in made:
        x, y = by[r["base"]], by[r["neighbour"]]
        assert 0 <= r["u"] < 1 and r["id"] is None and x[1] == y[1] == r["y"]
        assert r["neighbour"] in [n for _, n in near[r["base"]]] or r["y"] == 7
        assert [r[f] for f in F3] == [p + r["u"] * (q - p) for p, q in zip(x[2:], y[2:])]
    again = smote.smote_oversample(df.repartition(5), "y", "id", F3, 5).filter("draw is not null")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, made), key=repr)
    assert out.filter("draw is null").count() == len(data)


def test_degenerate(spark):
    empty = frame(spark, rows(1)).limit(0)
    assert smote.smote_knn(empty, "y", "id", F3).count() == 0 and smote.smote_oversample(empty, "y", "id", F3).count() == 0
    same = [(i, i % 2, 1.0, 1.0, 1.0) for i in range(9)] + [(20, 0, None, 1.0, 1.0), (21, 0, 1.0, None, 1.0), (22, 5, None, 1.0, 1.0)]
    out = smote.smote_oversample(frame(spark, same), "y", "id", F3)
    count = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert count == {0: 7, 1: 7, 5: 1}          # a class without a usable row stays


def test_blocks_are_compared_in_bounded_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(2000, 5)), rng.normal(size=(2000, 5))
    qi, ci = np.arange(2000), np.arange(2000) + 1000        # half of the ids on both sides
    tracemalloc.start()
    i, other, d = smote.nearest(q, qi, c, ci, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * 1024 * 1024                          # a whole product of 2000 x 2000 doubles has 32 MB
    assert np.array_equal(i, np.repeat(np.arange(2000), 5))
    for row in (0, 255, 256, 1500, 1999):
        gap = ((q[row] - c) ** 2).sum(axis=1)
        gap[ci == qi[row]] = np.inf
        best = np.argsort(gap, kind="stable")[:5]
        assert other[i == row].tolist() == ci[best].tolist() and np.allclose(d[i == row], gap[best])


def test_a_task_compares_few_blocks(spark, monkeypatch):
    """However many blocks there are, the rows a task hands to Python are few."""
    import numpy as np

    monkeypatch.setattr(smote, "SENT_ROWS", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(n, 1, *map(float, v)) for n, v in enumerate(x)], "id long, y int, a double, b double, c double")
    few = {(r["key"], r["rank"]): (r["neighbour"], r["distance2"]) for r in smote.smote_knn(df, "y", "id", F3, 3, block_rows=10).collect()}
    assert len(few) == 1200
    for row in (0, 17, 399):
        gap = ((x[row] - x) ** 2).sum(axis=1)
        gap[row] = np.inf
        assert [few[row, r][0] for r in (1, 2, 3)] == np.argsort(gap, kind="stable")[:3].tolist()
    plan = smote.smote_knn(df, "y", "id", F3, 3, block_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "share" in plan and "BroadcastHashJoin" not in plan


def test_blocks_meet_only_what_is_near():
    """Rows spread over two wide features: blocks along the curve reach a few others, not a whole strip."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(0, 1000, (12_800, 2)), rng.uniform(0, 5, (12_800, 1))], axis=1)
    batch = pa.RecordBatch.from_pydict({"cls": ["1"] * len(x), "key": np.arange(len(x)), "x": x.tolist()})
    (placed,) = smote._placed([0, 1], [500.0, 500.0], 290.0)([batch])
    order = np.argsort(placed.column("place").to_numpy(), kind="stable")
    blocks = [order[at:at + 128] for at in range(0, len(order), 128)]
    lo, hi = (np.stack([f(x[b], axis=0) for b in blocks]) for f in (np.min, np.max))
    bound = [smote.kth_distances(x[b], b, 5) for b in blocks]
    shares = smote._shares(lo, hi, np.sqrt([w.max() for w in bound]))
    table = SimpleNamespace(value={"1": (np.arange(100), lo, hi, shares)})
    sent = []
    for n, b in enumerate(blocks):
        one = pa.RecordBatch.from_pydict({"cls": ["1"], "block": [n], "lo": [lo[n].tolist()], "hi": [hi[n].tolist()], "reach": [float(np.sqrt(bound[n].max()))],
                                          "bound": [bound[n].tobytes()], "ids": [b.tobytes()], "data": [x[b].tobytes()]})
        sent += [len(np.frombuffer(r, np.int64)) for out in smote._targets(table)([one]) for r in out.column("q_ids").to_pylist()]
    assert len(sent) < 100 * 12 and sum(sent) < 3 * len(x)          # strips of one feature: 100 blocks ask far more
    for n in (0, 40, 99):           # the bound is the k-th distance inside of the block
        gap = ((x[blocks[n]][:, None] - x[blocks[n]][None]) ** 2).sum(axis=2)
        assert np.allclose(bound[n], np.sort(gap, axis=1)[:, 5])


def test_the_curve_steps_to_a_neighbour():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    place = smote.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()
