"""Statistical tests and association measures (ST1-ST12).

All tests reduce the data with ONE grouped aggregate of moments (n, mean,
sample variance, or cell counts); the test statistics are projections of
those few rows, and p-values come from vectorised ``pandas_udf`` tails run on
the reduced rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_engine.functions import distributions as dist

ROUNDING = 1e-14                # spread that double arithmetic alone leaves in a constant


def _measures_long(df: DataFrame, value_cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in value_cols]
    return df.select(*keep, F.explode(F.array(*structs)).alias("m")).select(*keep, "m.measure", "m.x")


def welch_t(df: DataFrame, value_cols: Sequence[str], group: str, first=1, second=0,
            pvalues: bool = False, alpha: float = 0.05) -> DataFrame:
    """ST1: Welch two-sample t for many measures at once (unequal variances).

    t = (mean_first - mean_second) / sqrt(v1/n1 + v2/n2), Welch-Satterthwaite
    df.  Nulls of each measure are skipped (t.test on the filtered vectors).
    """
    long = _measures_long(df, value_cols, [group]).filter(F.col("x").isNotNull())
    g = F.col(group)
    a, b = g == F.lit(first), g == F.lit(second)
    m = long.groupBy("measure").agg(
        F.count(F.when(a, F.col("x"))).alias("n1"), F.avg(F.when(a, F.col("x"))).alias("mean1"),
        F.var_samp(F.when(a, F.col("x"))).alias("var1"),
        F.count(F.when(b, F.col("x"))).alias("n2"), F.avg(F.when(b, F.col("x"))).alias("mean2"),
        F.var_samp(F.when(b, F.col("x"))).alias("var2"))
    # null where a group has fewer than two values or nothing varies
    q = F.try_divide
    se1, se2 = q(F.col("var1"), F.col("n1")), q(F.col("var2"), F.col("n2"))
    out = m.select("measure", "n1", "mean1", "var1", "n2", "mean2", "var2",
                   q(F.col("mean1") - F.col("mean2"), F.sqrt(se1 + se2)).alias("t"),
                   q((se1 + se2) * (se1 + se2),
                     q(se1 * se1, F.col("n1") - 1) + q(se2 * se2, F.col("n2") - 1)).alias("df"))
    if pvalues:
        out = out.withColumn("p_value", dist.t_pvalue("t", "df")) \
                 .withColumn("significant", F.col("p_value") < F.lit(alpha))
    return out


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean, sample variance per group (nulls of value/group skipped)."""
    src = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return src.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"),
                                  F.var_samp(F.col(value).cast("double")).alias("var"))


def anova_oneway(df: DataFrame, value: str, group: str, pvalues: bool = False) -> DataFrame:
    """ST2: one-way ANOVA from group moments: SS between/within, df, MS, F.

    Group moments are one grouped aggregate; the grand mean is a fitted
    parameter (one number); the sums of squares are a second aggregate over
    the k moment rows — nothing is gathered into a list."""
    gm = group_moments(df, value, group)
    g = gm.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand")).first()["grand"]
    out = gm.agg(F.sum(F.col("n") * (F.col("mean") - F.lit(g)) ** 2).alias("ss_between"),
                 F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ss_within"),
                 (F.count(F.lit(1)) - 1).cast("bigint").alias("df_between"),
                 (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("df_within"))
    # null for one group, or one value per group
    out = out.withColumns({"ms_between": F.try_divide("ss_between", "df_between"),
                           "ms_within": F.try_divide("ss_within", "df_within")})
    out = out.withColumn("f", F.try_divide("ms_between", "ms_within"))
    if pvalues:
        out = out.withColumn("p_value", dist.f_pvalue("f", "df_between", "df_within"))
    return out


def tukey_pairs(df: DataFrame, value: str, group: str, levels: Sequence | None = None,
                pvalues: bool = False, confidence: float = 0.95) -> DataFrame:
    """ST3: Tukey-Kramer pairwise differences (later level minus earlier),
    standard error sqrt(MSW/2 (1/ni + 1/nj)) and q = |diff| / se; with
    ``pvalues`` also the adjusted p and the confidence limits.  Pairs (the
    feature itself) come from a self-join of the group-moment table."""
    gm = group_moments(df, value, group)
    if levels is not None:
        order = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(group))
    else:
        order = F.dense_rank().over(Window.orderBy(group))
    gm = gm.select(order.cast("long").alias("o"), F.col(group).cast("string").alias("level"), "n", "mean", "var")
    whole = gm.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
                   F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw")).first()
    k, free = whole["k"], (whole["N"] or 0) - whole["k"]
    msw = F.lit(whole["ssw"] / free if free else None).cast("double")
    a, b = gm.alias("a"), gm.alias("b")
    pairs = a.join(b, F.col("a.o") < F.col("b.o"))
    diff = F.col("b.mean") - F.col("a.mean")
    se = F.sqrt(msw / 2 * (F.lit(1.0) / F.col("a.n") + F.lit(1.0) / F.col("b.n")))
    out = pairs.select(F.concat_ws("-", F.col("b.level"), F.col("a.level")).alias("comparison"),
                       diff.alias("diff"), se.alias("se"), F.try_divide(F.abs(diff), se).alias("q"),
                       F.lit(k).cast("bigint").alias("k"), F.lit(free).cast("bigint").alias("df"))
    if pvalues:
        reach = F.col("se") * F.lit(dist.tukey_quantile(confidence, k, free) if k > 1 and free > 0 else None).cast("double")
        out = out.withColumn("p_adj", dist.tukey_pvalue("q", "k", "df")).withColumns(
            {"lower": F.col("diff") - reach, "upper": F.col("diff") + reach})
    return out


def contingency(df: DataFrame, a: str, b: str, b_levels: Sequence) -> DataFrame:
    """ST5: a x b count table, one column per level of b (fixed level list,
    so no extra job to discover levels); null a/b rows dropped like table()."""
    src = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return src.groupBy(a).pivot(b, list(b_levels)).agg(F.count(F.lit(1))).fillna(0)


def chi2_independence(df: DataFrame, a: str, b: str, pvalues: bool = False, alpha: float = 0.05) -> DataFrame:
    """ST4: Pearson chi-square of independence (no continuity correction),
    via chi2 = sum O^2 / E - N over observed cells; df = (r-1)(c-1)."""
    src = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = src.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    j = cells.join(ra, a).join(cb, b)
    out = j.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("__s"),
                F.sum("o").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    out = out.select((F.col("__s") * F.col("n") - F.col("n")).alias("chi2"),
                     ((F.col("r") - 1) * (F.col("c") - 1)).cast("bigint").alias("df"),
                     F.col("n").cast("bigint").alias("n"))
    if pvalues:
        out = out.withColumn("p_value", dist.chi2_pvalue("chi2", "df")) \
                 .withColumn("significant", F.col("p_value") < F.lit(alpha))
    return out


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per pair of columns (i <= j) and per partition: rows that have both
    (n), the two means, co-moment and second moments over those rows.

    A block of rows is taken at once: values and their masks go through matrix
    products, so the work is a few products however many pairs there are.
    Blocks are shifted by their own column means and merged by the deltas of
    the pairs' means, which keeps large offsets from eating the digits.
    """
    k = len(cols)
    upper = np.triu_indices(k)

    def block(x):
        have = ~np.isnan(x)
        m = have.astype(float)
        shift = np.divide(np.where(have, x, 0.0).sum(0), m.sum(0), out=np.zeros(k), where=m.any(0))
        v = np.where(have, x - shift, 0.0)
        n = m.T @ m
        safe = np.maximum(n, 1.0)
        mean = v.T @ m / safe                            # [i, j]: mean of i over the rows that have i and j
        raw = (v * v).T @ m
        square = raw - n * mean * mean
        square = np.where(square > ROUNDING * raw, square, 0.0)
        both = v.T @ v - n * mean * mean.T
        return n, np.where(n > 0, mean + shift[:, None], 0.0), square, both

    def merged(a, b):
        n = a[0] + b[0]
        part = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
        delta = b[1] - a[1]
        return (n, a[1] + delta * part, a[2] + b[2] + delta * delta * a[0] * part,
                a[3] + b[3] + delta * delta.T * a[0] * part)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                part = block(x)
                total = part if total is None else merged(total, part)
        if total is not None:
            n, mean, square, both = total
            flat = [n[upper], mean[upper], mean.T[upper], square[upper], square.T[upper], both[upper]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *[pa.array(a, pa.float64()) for a in flat]],
                names=["i", "j", "n", "mi", "mj", "ii", "jj", "ij"])

    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return src.mapInArrow(run, "i int, j int, n double, mi double, mj double, ii double, jj double, ij double")


def corr_matrix(df: DataFrame, cols: Sequence[str], nulls: str = "pairwise") -> DataFrame:
    """ST8/ST9: Pearson correlation of every ordered pair (var1, var2, r).
    ``pairwise``: each pair skips rows null in either; ``listwise``: complete
    cases over all columns first.  r is null where a side does not vary over
    the pair's rows (a deviation within ``ROUNDING`` of the mean is none), and
    without rows; NaN counts as null.  The rows are read once; a row per pair and partition is shuffled."""
    cols = list(cols)
    parts = co_moments(df.dropna(subset=cols) if nulls == "listwise" else df, cols)
    # partitions are merged around the mean of their means
    here = Window.partitionBy("i", "j")
    near = parts.filter("n > 0").withColumns({"di": F.col("mi") - F.avg("mi").over(here), "dj": F.col("mj") - F.avg("mj").over(here)})
    n, si, sj = F.sum("n"), F.sum(F.col("n") * F.col("di")), F.sum(F.col("n") * F.col("dj"))

    def whole(moment, a, b, sa, sb):
        return F.sum(moment) + F.sum(F.col("n") * F.col(a) * F.col(b)) - sa * sb / n

    pairs = near.groupBy("i", "j").agg(whole("ii", "di", "di", si, si).alias("ii"), whole("jj", "dj", "dj", sj, sj).alias("jj"),
                                       whole("ij", "di", "dj", si, sj).alias("ij"), n.alias("n"),
                                       F.avg("mi").alias("mi"), F.avg("mj").alias("mj"))
    level = lambda c: F.sqrt(F.col("n")) * F.col(c) * F.lit(ROUNDING)
    varies = (F.sqrt("ii") > F.abs(level("mi"))) & (F.sqrt("jj") > F.abs(level("mj")))
    r = F.when(varies, F.when(F.col("i") == F.col("j"), 1.0)
               .otherwise(F.col("ij") / F.sqrt(F.col("ii")) / F.sqrt(F.col("jj"))))
    names = F.array(*[F.lit(c) for c in cols])
    every = (df.sparkSession.range(len(cols) ** 2, numPartitions=1)
             .select((F.col("id") / len(cols)).cast("int").alias("a"), (F.col("id") % len(cols)).cast("int").alias("b")))
    keyed = every.select("a", "b", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return (keyed.join(pairs.select("i", "j", r.alias("r")), ["i", "j"], "left")
            .select(names[F.col("a")].alias("var1"), names[F.col("b")].alias("var2"), "r"))


def corr_target(df: DataFrame, target: str, cols: Sequence[str], nulls: str = "listwise") -> DataFrame:
    """ST10: correlation of each column with the target, with its sign."""
    m = corr_matrix(df, [target, *cols], nulls).filter(F.col("var2") == target)
    return m.select(F.col("var1").alias("variable"), "r",
                    F.when(F.col("r") > 0, F.lit("+")).otherwise(F.lit("-")).alias("direction"))


def group_linear_fit(df: DataFrame, y: str, x: str, by: str, at: float | None = None) -> DataFrame:
    """ST11: per-group least squares line with residual standard error and
    the standard error of the fitted mean at ``at`` (default x mean)."""
    src = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    g = src.groupBy(by).agg(F.regr_count(yy, xx).alias("n"), F.regr_slope(yy, xx).alias("slope"),
                            F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"),
                            F.regr_sxx(yy, xx).alias("sxx"), F.regr_syy(yy, xx).alias("syy"),
                            F.regr_sxy(yy, xx).alias("sxy"), F.regr_avgx(yy, xx).alias("x_mean"))
    # null for two points or fewer, or a constant x
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    s = F.sqrt(F.when(F.col("slope").isNotNull(), F.try_divide(rest, F.when(F.col("n") > 2, F.col("n") - 2))))
    x0 = F.col("x_mean") if at is None else F.lit(float(at))
    se = s * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide((x0 - F.col("x_mean")) ** 2, F.col("sxx")))
    return g.select(by, F.col("n").cast("bigint").alias("n"), "slope", "intercept", "r2", "sxx", "x_mean",
                    s.alias("resid_se"), se.alias("se_fit"))
