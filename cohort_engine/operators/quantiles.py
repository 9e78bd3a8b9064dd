"""Exact quantiles without a value map in one task.

``exact_quantiles`` selects by radix: a double's bits, with the sign folded in,
sort like the double.  A pass counts, per column, the values by the first bits;
the digit that holds a wanted rank becomes the prefix of the next pass, and so
on over the 64 bits.  Each task returns counts of at most 2 ** 16 digits per
prefix, whatever the number of rows; no value is shuffled.  Passes end early for
a prefix with one distinct value, or with ``FINISH`` values or fewer, which are
then read and sorted.

``grouped_quantiles`` takes groups of any number and size: distinct (group,
value, count) rows get running counts by range partitions (``rankcum``), and
the rows that hold the wanted ranks are kept; the result stays a DataFrame.

Both interpolate like ``percentile``: h = (n - 1) p between ranks floor(h) and
ceil(h), with the same arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohort_engine.operators import rankcum

WIDTHS = (16, 12, 12, 12, 12)   # bits of each pass, 64 in all
FINISH = 4096                   # values of one prefix that are read and sorted

_DIGITS = "col int, prefix decimal(20,0), digit int, n long, lo decimal(20,0), hi decimal(20,0)"
_VALUES = "col int, bits decimal(20,0), n long"
_BITS = pa.decimal128(20, 0)


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """64 bits that sort like the doubles; one zero, one NaN (the largest)."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    b = v.view(np.uint64)
    top = np.uint64(1) << np.uint64(63)
    return np.where(b & top, ~b, b | top)


def from_bits(b: int) -> float:
    top = 1 << 63
    return float(np.array([b & ~top if b & top else ~b & (2**64 - 1)], np.uint64).view(np.float64)[0])


def _decimals(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.uint64()).cast(_BITS)


def _columns(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i, col in enumerate(batch.columns):
            v = np.asarray(col.drop_null(), np.float64)
            if len(v):
                yield i, ordered_bits(v)


def _inside(bits: np.ndarray, prefix: int, used: int) -> np.ndarray:
    return bits if not used else bits[bits >> np.uint64(64 - used) == np.uint64(prefix)]


def _digits(wanted: dict[int, list[int]], used: int, width: int):
    """Counts, smallest and largest value by the next ``width`` bits of every
    wanted prefix of ``used`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for i, bits in _columns(batches):
            for p in wanted.get(i, ()):
                own = _inside(bits, p, used)
                if not len(own):
                    continue
                if (i, p) not in held:
                    held[i, p] = [np.zeros(1 << width, np.int64), np.full(1 << width, 2**64 - 1, np.uint64), np.zeros(1 << width, np.uint64)]
                digit = (own >> np.uint64(64 - used - width) & np.uint64((1 << width) - 1)).astype(np.int64)
                n, lo, hi = held[i, p]
                n += np.bincount(digit, minlength=1 << width)
                np.minimum.at(lo, digit, own)
                np.maximum.at(hi, digit, own)
        for (i, p), (n, lo, hi) in held.items():
            d = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(d), i, np.int32)), _decimals(np.full(len(d), p, np.uint64)), pa.array(d.astype(np.int32)), pa.array(n[d]),
                 _decimals(lo[d]), _decimals(hi[d])], names=["col", "prefix", "digit", "n", "lo", "hi"])
    return run


def _values(wanted: dict[int, list[tuple[int, int]]]):
    """Distinct values with counts below the (prefix, bits used) asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, bits in _columns(batches):
            for p, used in wanted.get(i, ()):
                v, n = np.unique(_inside(bits, p, used), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), _decimals(v), pa.array(n.astype(np.int64))],
                                                 names=["col", "bits", "n"])
    return run


def _ranks(n: int, probs: Sequence[float]) -> set[int]:
    return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """{column: [quantile per prob]} (None for an all-null column).  Two to five
    aggregates of fixed size over the columns, read once and kept while the
    passes last."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = _select(data, len(cols), probs)
    finally:
        data.unpersist()
    out = {}
    for i, c in enumerate(cols):
        n, at = found[i]
        vals = []
        for p in probs if n else ():
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            vals.append(at[lo] if hi == lo else (hi - h) * at[lo] + (h - lo) * at[hi])
        out[c] = vals if n else [None] * len(probs)
    return out


def _select(data: DataFrame, cols: int, probs: Sequence[float]) -> list[tuple[int, dict[int, float]]]:
    """Per column the number of values and {rank: value} of the wanted ranks."""
    total = [0] * cols
    done: list[dict[int, float]] = [{} for _ in range(cols)]
    # open prefixes: (column, prefix) -> ranks inside it, as (rank, rank among the prefix's values)
    open_: dict[tuple[int, int], list[tuple[int, int]]] = {(i, 0): [] for i in range(cols)}
    last: dict[tuple[int, int, int], list[tuple[int, int]]] = {}          # (column, prefix, bits): few values, to be read
    used = 0
    for width in WIDTHS:
        if not open_:
            break
        wanted: dict[int, list[int]] = {}
        for i, p in open_:
            wanted.setdefault(i, []).append(p)
        got = (data.mapInArrow(_digits(wanted, used, width), _DIGITS).groupBy("col", "prefix", "digit")
               .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas())
        nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (i, p), own in got.sort_values("digit").groupby(["col", "prefix"]):
            i, p = int(i), int(p)
            n = own["n"].to_numpy()
            ends = np.cumsum(n)
            if not used:
                total[i] = int(ends[-1])
                open_[i, p] = [(r, r) for r in _ranks(total[i], probs)]
            for rank, inner in open_[i, p]:
                k = int(np.searchsorted(ends, inner, "right"))
                row, rest = own.iloc[k], inner - int(ends[k] - n[k])
                prefix = p << width | int(row["digit"])
                if row["lo"] == row["hi"]:
                    done[i][rank] = from_bits(int(row["lo"]))
                elif n[k] <= FINISH:
                    last.setdefault((i, prefix, used + width), []).append((rank, rest))
                else:
                    nxt.setdefault((i, prefix), []).append((rank, rest))
        open_, used = nxt, used + width
    if last:
        wanted_values: dict[int, list[tuple[int, int]]] = {}
        for i, p, bits in last:
            wanted_values.setdefault(i, []).append((p, bits))
        got = data.mapInArrow(_values(wanted_values), _VALUES).groupBy("col", "bits").agg(F.sum("n").alias("n")).toPandas()
        values = {int(i): [(int(b), int(n)) for b, n in zip(own["bits"], own["n"])] for i, own in got.groupby("col")}
        for (i, p, bits), ranks in last.items():
            own = sorted(x for x in values[i] if x[0] >> (64 - bits) == p)
            ends = np.cumsum([n for _, n in own])
            for rank, rest in ranks:
                done[i][rank] = from_bits(own[int(np.searchsorted(ends, rest, "right"))][0])
    return [(total[i], done[i]) for i in range(cols)]


def quantile_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``exact_quantiles`` as rows (column, q array)."""
    return df.sparkSession.createDataFrame(list(exact_quantiles(df, cols, probs).items()), "column string, q array<double>")


def grouped_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per non-empty (group, column): the ``by`` columns, col, n (values)
    and q (array, one quantile per prob).  A hot group is more distinct values
    over the range partitions; no group is gathered in one task."""
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    structs = [F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]
    long = (df.select(*by, F.explode(F.array(*structs)).alias("s")).select(*by, "s.col", "s.v")
            .filter(F.col("v").isNotNull()))
    distinct = long.groupBy(*by, "col", "v").agg(F.count(F.lit(1)).alias("cnt"))
    cum = rankcum.cumulative(distinct, [*by, "col"], "v", ["cnt"])
    totals = cum.groupBy(*by, "col").agg(F.max("cum_cnt").alias("n"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "col"]]
    hit = cum.alias("x").join(totals.alias("t"), same).select("x.*", "t.n")
    start, h = F.col("cum_cnt") - F.col("cnt"), [(F.col("n") - 1) * F.lit(p) for p in probs]
    at = lambda rank: F.max(F.when((start <= rank) & (rank < F.col("cum_cnt")), F.col("v")))
    picked = hit.groupBy(*by, "col", "n").agg(*[at(F.floor(x)).alias(f"__lo{i}") for i, x in enumerate(h)],
                                              *[at(F.ceil(x)).alias(f"__hi{i}") for i, x in enumerate(h)])
    value = [F.when(F.floor(x) == F.ceil(x), F.col(f"__lo{i}"))
             .otherwise((F.ceil(x) - x) * F.col(f"__lo{i}") + (x - F.floor(x)) * F.col(f"__hi{i}")) for i, x in enumerate(h)]
    return picked.select(*by, "col", "n", F.array(*value).alias("q"))
