"""Profiling.

Profiles are fused aggregates over all columns, unpivoted to long form; exact
distinct counts group each column on its own.  Histograms need the value range first (one tiny aggregate, collected
as a parameter), then one grouped count.  Box statistics compute per-group
quartiles, then join the k-row quartile table back (checked broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.operators import clean
from cohort_engine.operators.clean import numeric_columns
from cohort_engine.operators.quantiles import grouped_quantiles
from cohort_engine.session import staged


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def shape(df: DataFrame) -> DataFrame:
    """A1: rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, scan: bool = False) -> DataFrame:
    """Rows, non-null and distinct values of every column: (ordinal, column,
    rows, non_null, n_distinct), exact.

    Each column is grouped on its own (map-side combine, hash partitions of
    distinct values), so no row is copied once per column.  The columns are read
    from a columnar table, each once: ``scan=True`` says that ``df`` is a plain
    read of one, otherwise ``df`` is written first.  NaN is one value, -0.0 is
    0.0; no columns give an empty table."""
    spark = df.sparkSession
    cols = list(cols) if cols is not None else df.columns
    if not cols:
        return spark.createDataFrame([], "ordinal int, column string, rows bigint, non_null bigint, n_distinct bigint")
    if not scan:
        df = staged(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    else:
        df = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = []
    for i, c in enumerate(cols):
        values = df.groupBy(f"c{i}").agg(F.count(F.lit(1)).alias("n"))
        known = F.col(f"c{i}").isNotNull()
        parts.append(values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
                                F.count(F.when(known, 1)).alias("n_distinct"))
                     .select(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), "rows", "non_null", "n_distinct"))
    return reduce(DataFrame.unionAll, parts)


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, distinct: str = "exact", scan: bool = False) -> DataFrame:
    """A2: per column dtype, non-null, null, null %, distinct.

    ``distinct='approx'`` uses HyperLogLog++ in one aggregate (bounded memory);
    the exact form is ``distinct_counts``, which explains ``scan``.
    """
    cols = list(cols) if cols is not None else df.columns
    types = dict(df.dtypes)
    if distinct == "exact":
        long = distinct_counts(df, cols, scan)
    else:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(cols):
            aggs += [F.count(F.col(c)).alias(f"nn{i}"), F.approx_count_distinct(F.col(c)).alias(f"nd{i}")]
        structs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"nn{i}").alias("non_null"),
                            F.col(f"nd{i}").alias("n_distinct")) for i, c in enumerate(cols)]
        long = df.agg(*aggs).select("rows", F.explode(F.array(*structs)).alias("s")).select("rows", "s.*")
    nulls = F.col("rows") - F.col("non_null")
    dtype = F.element_at(F.array(*[F.lit(types[c]) for c in cols]), F.col("ordinal") + 1) if cols else F.lit("")
    return long.select(
        "column", dtype.alias("dtype"), F.col("non_null").cast("bigint").alias("non_null"), nulls.cast("bigint").alias("nulls"),
        F.round(F.try_divide(nulls * F.lit(100.0), F.col("rows")), 2).alias("null_pct"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"), "ordinal")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: columns with any null, count and % (2 dp)."""
    cols = list(cols) if cols is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"nn{i}").alias("nn")) for i, c in enumerate(cols)]
    long = row.select("__n", F.explode(F.array(*structs)).alias("s"))
    out = long.select("s.column", (F.col("__n") - F.col("s.nn")).cast("bigint").alias("missing"),
                      F.round(F.try_divide((F.col("__n") - F.col("s.nn")) * F.lit(100.0), F.col("__n")), 2)
                      .alias("missing_pct"))
    return out.filter(F.col("missing") > 0)


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, digits: int | None = 2,
                    method: str = "exact") -> DataFrame:
    """A4: count, mean, sample sd, min, quartiles, max per numeric column
    (exact linear-interpolated quartiles; ``method='approx'`` for sketches)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    quartiles = clean.quantiles(df, cols, (0.25, 0.5, 0.75), method)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q = F.array(*[F.lit(v).cast("double") for v in quartiles[c]])
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("q"),
                             F.max(x).alias("max")).alias(f"s{i}"))
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s"))
    r = (lambda e: F.round(e, digits)) if digits is not None else (lambda e: e)
    return long.select("s.column", F.col("s.count").cast("bigint").alias("count"), r(F.col("s.mean")).alias("mean"),
                       r(F.col("s.std")).alias("std"), r(F.col("s.min")).alias("min"),
                       r(F.col("s.q")[0]).alias("p25"), r(F.col("s.q")[1]).alias("p50"),
                       r(F.col("s.q")[2]).alias("p75"), r(F.col("s.max")).alias("max"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A5."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None,
              range_mode: str = "shared") -> DataFrame:
    """Equal-width histogram with ``bins`` bins over [lo, hi] (last bin
    closed; lo = hi puts everything in bin 0).

    ``range_mode='shared'``: one range for all groups (two-number parameter);
    ``'per_group'``: each group its own range (null is a group).
    Output: (by, bin, lo_edge, hi_edge, n).
    """
    x = F.col(col).cast("double")
    src = df.filter(x.isNotNull())
    keys = [by] if by else []

    def bin_expr(lo, hi):
        width = (hi - lo) / F.lit(float(bins))
        raw = F.floor((x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * F.lit(float(bins)))
        b = F.when(hi > lo, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
        return b, width

    if range_mode == "shared" or not by:
        r = src.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if r["lo"] is None:
            return df.sparkSession.createDataFrame(
                [], ", ".join([f"{by} string"] if by else []) + (", " if by else "") +
                "bin int, lo_edge double, hi_edge double, n bigint")
        lo, hi = F.lit(r["lo"]), F.lit(r["hi"])
        b, width = bin_expr(lo, hi)
        counts = src.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select(*keys, "bin", (lo + F.col("bin") * width).alias("lo_edge"),
                             (lo + (F.col("bin") + 1) * width).alias("hi_edge"), "n")
    ranges = src.groupBy(by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    withr = (src.alias("s").join(ranges.alias("r"), F.col(f"s.{by}").eqNullSafe(F.col(f"r.{by}")))
             .select("s.*", "__lo", "__hi"))
    b, width = bin_expr(F.col("__lo"), F.col("__hi"))
    counts = withr.groupBy(by, b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(by, "bin", (F.col("__lo") + F.col("bin") * width).alias("lo_edge"),
                         (F.col("__lo") + (F.col("bin") + 1) * width).alias("hi_edge"), "n")


def box_stats(df: DataFrame, value: str, by, k: float = 1.5) -> DataFrame:
    """Per group quartiles, whiskers (extreme points inside the 1.5 IQR
    fences) and outlier count.  Quartiles per group by running counts over range partitions, then — after
    a join with the k-row quartile table — conditional min/max/count per group."""
    by = _list(by)
    x = F.col(value).cast("double")
    src = df.filter(x.isNotNull())
    q = grouped_quantiles(src, [value], (0.25, 0.5, 0.75), by).withColumnRenamed("q", "__q")
    q = q.select(*by, "n", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                 F.col("__q")[2].alias("q3"))
    lo = F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]     # null is a group
    j = (src.select(*by, x.alias("__x")).alias("s").join(q.alias("q"), same)
         .select(*[F.col(f"s.{c}") for c in by], "__x", "n", "q1", "median", "q3"))
    inside = (F.col("__x") >= lo) & (F.col("__x") <= hi)
    w = j.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("outliers"))
    return w
