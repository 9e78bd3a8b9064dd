"""Metric goldens (FIXTURES 6), brute-force ranking checks and properties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_engine.operators import metrics, rankcum

# Confusion counts recovered from the published metric table,
# and the published 4-dp metrics (accuracy, precision, recall, at-risk recall, F1).
GOLDEN = {
    "Logistic Regression": ((158, 64, 59, 119), (0.6925, 0.6503, 0.6685, 0.7117, 0.6593)),
    "Decision Tree": ((147, 75, 58, 120), (0.6675, 0.6154, 0.6742, 0.6622, 0.6434)),
    "Random Forest": ((167, 55, 66, 112), (0.6975, 0.6707, 0.6292, 0.7523, 0.6493)),
    "Gradient Boosting": ((163, 59, 69, 109), (0.68, 0.6488, 0.6124, 0.7342, 0.6301)),
}


def expand(spark):
    rows = []
    for m, ((tn, fp, fn, tp), _) in GOLDEN.items():
        rows += [(m, 0, 0)] * tn + [(m, 0, 1)] * fp + [(m, 1, 0)] * fn + [(m, 1, 1)] * tp
    return spark.createDataFrame(rows, "model string, y int, y_hat int")


def test_confusion_goldens(spark):
    out = {r["model"]: r for r in metrics.class_metrics(expand(spark)).collect()}
    for m, (_, want) in GOLDEN.items():
        got = tuple(round(out[m][c], 4) for c in ("accuracy", "precision", "recall", "at_risk_recall", "f1_score"))
        assert got == want, m


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def brute_ap(y, s):
    # step-wise AP over distinct thresholds, descending
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    thr = np.unique(s)[::-1]
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in thr:
        m = s >= t
        tp, fp = y[m].sum(), (1 - y[m]).sum()
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def rand_scores(spark):
    rng = np.random.default_rng(7)
    n = 3000
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)  # many ties
    rows = [("m", i, int(a), float(b), int(b >= 0.5)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, patient_id long, y int, p double, y_hat int"), y, p


@pytest.fixture()
def partitions(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("partitions", [1, 7, 40], indirect=True)
def test_auc_matches_brute_force(rand_scores, partitions):
    df, y, p = rand_scores
    got = metrics.roc_auc(df).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(y, p), abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 16], indirect=True)
def test_ap_matches_brute_force(rand_scores, partitions):
    df, y, p = rand_scores
    got = metrics.average_precision(df, positive=0).first()["pr_auc_at_risk"]
    assert got == pytest.approx(brute_ap((y == 0).astype(int), 1 - p), abs=1e-12)


def test_auc_symmetry_and_partition_invariance(rand_scores):
    df, y, p = rand_scores
    a = metrics.roc_auc(df).first()["roc_auc"]
    flipped = df.withColumn("p", F.lit(1.0) - F.col("p"))
    assert metrics.roc_auc(flipped).first()["roc_auc"] == pytest.approx(1 - a, abs=1e-12)
    assert metrics.roc_auc(df.repartition(13)).first()["roc_auc"] == pytest.approx(a, abs=1e-12)


def test_roc_points_brute_force(rand_scores):
    df, y, p = rand_scores
    pts = metrics.roc_points(df).collect()
    thr = np.unique(p)[::-1]
    fps = np.array([((p >= t) & (y == 0)).sum() for t in thr])
    tps = np.array([((p >= t) & (y == 1)).sum() for t in thr])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = {(float(t), f / fps[-1], tt / tps[-1]) for t, f, tt in zip(thr[keep], fps[keep], tps[keep])}
    want.add((None, 0.0, 0.0))
    got = {(r["threshold"], r["fpr"], r["tpr"]) for r in pts}
    assert {(a, round(b, 12), round(c, 12)) for a, b, c in got} == \
           {(a, round(b, 12), round(c, 12)) for a, b, c in want}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 5, 30])
def test_running_sums_in_any_cut(spark, parts, descending):
    """Groups (null too) and scores cut into partitions and small batches."""
    rng = np.random.default_rng(parts)
    rows = [(g, float(s), int(c), float(c) / 4) for g in ("a", "b", None, "zz") for s, c in
            zip(rng.permutation(200)[:(150 if g == "b" else 9)], rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "g string, s double, c long, w double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    out = rankcum.cumulative(df, ["g"], "s", ["c", "w"], descending, with_next=True, partitions=parts).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for g in ("a", "b", None, "zz"):
        own = sorted([r for r in rows if r[0] == g], key=lambda r: r[1], reverse=descending)
        for i, r in enumerate(own):
            nxt = own[i + 1][2:] if i + 1 < len(own) else (None, None)
            want.append((*r, sum(x[2] for x in own[:i + 1]), sum(x[3] for x in own[:i + 1]), *nxt))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_class_report_supports(spark):
    rep = metrics.class_report(expand(spark)).filter("model = 'Random Forest'").collect()
    sup = {r["class"]: r["support"] for r in rep}
    assert sup == {"0": 222, "1": 178, "macro avg": 400, "weighted avg": 400}
