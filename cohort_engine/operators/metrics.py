"""Classification metrics on a long score table.

Input columns: group key(s) (``model``), label ``y`` in {0, 1}, hard
prediction ``y_hat`` and probability of class 1 ``p``.  Everything is an
aggregate grouped by model; ranking metrics first collapse to distinct
scores (a hot score value becomes one row) and then use the bucketed
cumulative sums of ``rankcum`` instead of a global ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.operators import rankcum


def _l(x):
    return [x] if isinstance(x, str) else list(x)


def confusion(scores: DataFrame, by="model", y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """K6: TN, FP, FN, TP per group in one conditional aggregate."""
    yy, pp = F.col(y), F.col(y_hat)

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return scores.groupBy(*_l(by)).agg(
        n((yy == 0) & (pp == 0)).alias("tn"), n((yy == 0) & (pp == 1)).alias("fp"),
        n((yy == 1) & (pp == 0)).alias("fn"), n((yy == 1) & (pp == 1)).alias("tp"))


def _div(a, b):
    """Zero-division -> 0, as with zero_division=0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_metrics(scores: DataFrame, by="model", y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """K1-K3: accuracy, precision, recall, at-risk recall (class 0), F1."""
    c = confusion(scores, by, y, y_hat)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    return c.select(*_l(by),
                    _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _div(tn, tn + fp).alias("at_risk_recall"),
                    F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
                    .alias("f1_score"))


def _distinct_scores(scores, by, y, score_expr, positive):
    pos = (F.col(y) == F.lit(positive)).cast("bigint")
    return (scores.select(*_l(by), score_expr.alias("s"), pos.alias("__pos"))
            .groupBy(*_l(by), "s")
            .agg(F.sum("__pos").alias("pos"), F.sum(F.lit(1) - F.col("__pos")).alias("neg")))


def roc_auc(scores: DataFrame, by="model", y: str = "y", p: str = "p") -> DataFrame:
    """K4: ROC-AUC with ties counted half: sum over distinct scores of
    pos * (negatives below + neg/2), divided by P*N."""
    d = _distinct_scores(scores, by, y, F.col(p).cast("double"), 1)
    cum = rankcum.cumulative(d, _l(by), "s", ["neg"], descending=False)
    below = F.col("cum_neg") - F.col("neg")
    # null for a group with one class only
    return cum.groupBy(*_l(by)).agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") * F.lit(0.5))),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def average_precision(scores: DataFrame, by="model", y: str = "y", p: str = "p", positive: int = 0) -> DataFrame:
    """K5: step-wise average precision sum(dR * P) for ``positive`` class.
    For class 0 the score is 1 - p (as the reference flips scores)."""
    s = (F.lit(1.0) - F.col(p).cast("double")) if positive == 0 else F.col(p).cast("double")
    d = _distinct_scores(scores, by, y, s, positive)
    cum = rankcum.cumulative(d, _l(by), "s", ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    name = "pr_auc_at_risk" if positive == 0 else "average_precision"
    return cum.groupBy(*_l(by)).agg(
        F.coalesce(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos").cast("double")), F.lit(0.0))
        .alias(name))


def roc_points(scores: DataFrame, by="model", y: str = "y", p: str = "p", drop_intermediate: bool = True) -> DataFrame:
    """K8: ROC curve (threshold, fpr, tpr) per group, descending thresholds,
    starting at (0, 0) with a null threshold.  ``drop_intermediate`` drops
    points where neither count changes its step (collinear points)."""
    d = _distinct_scores(scores, by, y, F.col(p).cast("double"), 1)
    cum = rankcum.cumulative(d, _l(by), "s", ["pos", "neg"], descending=True,
                             with_next=True)
    tot = d.groupBy(*_l(by)).agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"),
                                 F.max("s").alias("__top"))
    j = cum.join(tot, _l(by))
    pts = j
    if drop_intermediate:
        first = F.col("s") == F.col("__top")
        last = F.col("next_pos").isNull()
        changes = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        pts = j.filter(first | last | changes)
    fpr = F.coalesce(F.try_divide(F.col("cum_neg").cast("double"), F.col("__N").cast("double")), F.lit(0.0))
    tpr = F.coalesce(F.try_divide(F.col("cum_pos").cast("double"), F.col("__P").cast("double")), F.lit(0.0))
    curve = pts.select(*_l(by), F.col("s").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = tot.select(*_l(by), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def pr_points(scores: DataFrame, by="model", y: str = "y", p: str = "p", positive: int = 0) -> DataFrame:
    """K9: precision-recall curve for ``positive`` (class 0 uses score 1 - p):
    one point per distinct threshold plus the closing point (recall 0,
    precision 1, null threshold)."""
    s = (F.lit(1.0) - F.col(p).cast("double")) if positive == 0 else F.col(p).cast("double")
    d = _distinct_scores(scores, by, y, s, positive)
    cum = rankcum.cumulative(d, _l(by), "s", ["pos", "neg"], descending=True)
    tot = d.groupBy(*_l(by)).agg(F.sum("pos").alias("__P"))
    j = cum.join(tot, _l(by))
    prec = F.coalesce(F.try_divide(F.col("cum_pos").cast("double"),
                                   (F.col("cum_pos") + F.col("cum_neg")).cast("double")), F.lit(0.0))
    rec = F.when(F.col("__P") == 0, F.lit(1.0)).otherwise(F.col("cum_pos") / F.col("__P").cast("double"))
    curve = j.select(*_l(by), F.col("s").alias("threshold"), prec.alias("precision"), rec.alias("recall"))
    close = tot.select(*_l(by), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                       F.lit(0.0).alias("recall"))
    return curve.unionByName(close)


def prevalence(scores: DataFrame, by="model", y: str = "y", positive: int = 0) -> DataFrame:
    """No-skill PR baseline = share of the positive class."""
    return scores.groupBy(*_l(by)).agg(F.avg((F.col(y) == F.lit(positive)).cast("double")).alias("baseline"))


def class_report(scores: DataFrame, by="model", y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """K7: per class precision/recall/F1/support plus macro and weighted
    averages (rows labelled '0', '1', 'macro avg', 'weighted avg')."""
    c = confusion(scores, by, y, y_hat)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))

    def f1(pr, rc):
        return F.when(pr + rc > 0, F.lit(2.0) * pr * rc / (pr + rc)).otherwise(F.lit(0.0))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    s1, s0 = (tp + fn), (tn + fp)
    base = c.select(*_l(by), p0.alias("p0"), r0.alias("r0"), f1(p0, r0).alias("f0"), s0.alias("s0"),
                    p1.alias("p1"), r1.alias("r1"), f1(p1, r1).alias("f1"), s1.alias("s1"))
    n = F.col("s0") + F.col("s1")

    def w(a, b):
        return (F.col(a) * F.col("s0") + F.col(b) * F.col("s1")) / n.cast("double")
    rows = F.array(
        F.struct(F.lit("0").alias("class"), F.col("p0").alias("precision"), F.col("r0").alias("recall"),
                 F.col("f0").alias("f1_score"), F.col("s0").alias("support")),
        F.struct(F.lit("1").alias("class"), F.col("p1").alias("precision"), F.col("r1").alias("recall"),
                 F.col("f1").alias("f1_score"), F.col("s1").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 ((F.col("r0") + F.col("r1")) / 2).alias("recall"),
                 ((F.col("f0") + F.col("f1")) / 2).alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), w("p0", "p1").alias("precision"),
                 w("r0", "r1").alias("recall"), w("f0", "f1").alias("f1_score"), n.alias("support")))
    return base.select(*_l(by), F.explode(rows).alias("r")).select(*_l(by), "r.*")


def model_metrics(scores: DataFrame, by="model", y: str = "y", y_hat: str = "y_hat", p: str = "p",
                  digits: int | None = 4,
                  materialize: bool = True) -> DataFrame:
    """One row per model: accuracy, precision, recall, at-risk recall,
    F1, ROC-AUC and PR-AUC (at-risk), rounded to ``digits``.  The three
    aggregates (and two edge fits) share the score table, written once to
    the shared checkpoint folder ("score once")."""
    if materialize:
        from cohort_engine.session import cut_lineage
        scores = cut_lineage(scores.select(*_l(by), y, y_hat, p))
    cm = class_metrics(scores, by, y, y_hat)
    auc = roc_auc(scores, by, y, p)
    ap = average_precision(scores, by, y, p, 0)
    out = cm.join(auc, _l(by)).join(ap, _l(by))
    if digits is not None:
        out = out.select(*_l(by), *[F.round(F.col(c), digits).alias(c) for c in out.columns if c not in _l(by)])
    return out
