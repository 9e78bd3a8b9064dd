"""Scalar column expressions (feature derivation, labels, parsing).

All of these are plain ``Column`` builders: they stay inside whole-stage
codegen and need no shuffle.  ANSI mode is on by default in Spark 4, so
every division is guarded inside ``when`` or written with ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo=None, hi=None) -> Column:
    """Null-preserving clip (``greatest``/``least`` would skip nulls)."""
    x = _c(x)
    out = x
    if lo is not None and hi is not None:
        return F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(x)
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(x)
    return out


def guarded_ratio(num, den, lo=None, hi=None, null_policy: str = "zero") -> Column:
    """Ratio with a guarded denominator.

    null_policy:
      * ``zero``: denominator <= 0 or null gives 0; null numerator gives null
        (the pipeline's ``np.where(den > 0, num / den, 0)``).
      * ``null``: denominator <= 0 or null gives null (the statistics script).
      * ``drop``: plain ratio, null when either side is null or den is 0;
        callers drop the nulls (the dashboard form).
      * ``floor1``: num / max(den, 1), capped above only (the scoring page).
    Then a null-preserving clip to [lo, hi].
    """
    num = _c(num).cast("double")
    den = _c(den).cast("double")
    if null_policy == "zero":
        r = F.when(den > 0, num / den).otherwise(F.lit(0.0))
    elif null_policy == "null":
        r = F.when(den.isNotNull() & (den > 0), num / den)
    elif null_policy == "floor1":
        # the scoring page: num / max(den, 1), only the upper cap applies
        r = num / F.when(den < 1, F.lit(1.0)).otherwise(den)
        return clip(r, None, hi)
    elif null_policy == "drop":
        # pandas division: x/0 is +inf, -x/0 is -inf, 0/0 NaN (-> null)
        big = F.lit(float("inf"))
        r = (F.when(den == 0, F.when(num > 0, big).when(num < 0, -big))
             .otherwise(num / F.when(den == 0, F.lit(1.0)).otherwise(den)))
    else:
        raise ValueError(f"unknown null_policy {null_policy!r}")
    return clip(r, lo, hi)


def nonneg_gap(a, b) -> Column:
    """max(a - b, 0), null stays null."""
    d = _c(a) - _c(b)
    return F.when(d < 0, F.lit(0)).otherwise(d)


def bucketize(x, bounds: Sequence[float], lowest=None, highest=None,
              include_lowest: bool = False, labels: Sequence | None = None) -> Column:
    """Right-closed buckets (lowest, b0], (b0, b1], ..., (b_k-1, highest].

    ``lowest``/``highest`` None means open-ended.  Values outside the range or
    null give null.  ``include_lowest`` closes the first bucket on the left
    (quantile buckets).  Labels default to 0..k.
    """
    x = _c(x)
    edges = list(bounds)
    n = len(edges) + 1
    labels = list(labels) if labels is not None else list(range(n))
    if len(labels) != n:
        raise ValueError("need one label per bucket")
    out = None
    if lowest is not None:
        below = (x < F.lit(lowest)) if include_lowest else (x <= F.lit(lowest))
        out = F.when(below, F.lit(None))
    for i, e in enumerate(edges):
        cond = x <= F.lit(e)
        out = F.when(cond, F.lit(labels[i])) if out is None else out.when(cond, F.lit(labels[i]))
    last = x <= F.lit(highest) if highest is not None else x.isNotNull()
    out = F.when(last, F.lit(labels[-1])) if out is None else out.when(last, F.lit(labels[-1]))
    return out


# Fixed values that must equal the reference (bucket edges, band cut-offs and
# label texts).
AGE_BOUNDS = (35, 64)
MED_BOUNDS = (2, 5)
SUPPLY_BOUNDS = (30, 60)
SUPPLY_RANGE = (0, 365)
AGE_LABELS = ("Young (18–35)", "Adult (36–64)", "Elderly (65+)")
# the dashboard's bounded age bands (0, 35], (35, 64], (64, 120]
AGE_BAND_RANGE = (0, 120)
AGE_BAND_LABELS = ("Young (18-35)", "Adult (36-64)", "Elderly (65+)")
MED_LABELS = ("Low (1–2)", "Medium (3–5)", "High (6+)")
ADHERENCE_LABELS = ("Non-Adherent", "Adherent")
CONFIDENCE_HIGH = (0.75, 0.25)
CONFIDENCE_MEDIUM = (0.60, 0.40)


def confidence_band(p) -> Column:
    """High if p > .75 or p < .25; Medium if p > .60 or p < .40; else Low."""
    p = _c(p)
    return (F.when((p > CONFIDENCE_HIGH[0]) | (p < CONFIDENCE_HIGH[1]), F.lit("High"))
            .when((p > CONFIDENCE_MEDIUM[0]) | (p < CONFIDENCE_MEDIUM[1]), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def risk_band(p, lo: float = 0.40, hi: float = 0.60, labels=("Low", "Moderate", "High")) -> Column:
    """Display band with two edges (the scoring page: 40 % / 60 %)."""
    p = _c(p)
    return F.when(p < lo, F.lit(labels[0])).when(p < hi, F.lit(labels[1])).otherwise(F.lit(labels[2]))


def code_label(x, mapping: dict) -> Column:
    """Small code -> label map as a CASE expression."""
    x = _c(x)
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out


def round_half_up(x, digits: int) -> Column:
    """Half-up rounding written as floor(x * 10^d + 0.5) / 10^d: plain IEEE
    operations, so Spark and SQL engines give the identical double."""
    m = float(10 ** digits)
    return F.floor(_c(x) * F.lit(m) + F.lit(0.5)) / F.lit(m)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


# A decimal number, or inf / nan; the cast alone would also take 1D and 5f.
NUMBER_PATTERN = r"(?i)^[+-]?([0-9]+\.?[0-9]*([e][+-]?[0-9]+)?|\.[0-9]+([e][+-]?[0-9]+)?|inf(inity)?|nan)$"


def safe_number(x, default=0, integer: bool = False) -> Column:
    """Text to number with a default: ``float(x.strip())`` or ``int(float(...))``.

    Non-numeric, blank, null and (for integers) non-finite text give the
    default.  Integer parsing truncates toward zero.
    """
    text = F.trim(_c(x))
    d = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    if integer:
        finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
        return F.when(finite, d.try_cast("bigint")).otherwise(F.lit(int(default)).cast("bigint"))
    return F.coalesce(d, F.lit(float(default)))


def pct_text(x, digits: int = 1) -> Column:
    """Percent text such as '56.9%'."""
    return F.format_string(f"%.{digits}f%%", _c(x) * F.lit(100.0))


def normalize_name(name: str) -> str:
    """Column-name normalisation for SQL sinks: strip, lower, '-'/' ' to '_'."""
    return name.strip().lower().replace("-", "_").replace(" ", "_")
