"""Tail probabilities for test statistics (ST12), numpy only.

Applied through ``pandas_udf`` to the already-reduced result rows (one row
per test), never to data rows.  Regularised incomplete beta / gamma use the
classic continued-fraction and series expansions; the studentized range
integrates the range distribution with Gauss-Legendre quadrature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300
_GL_X, _GL_W = np.polynomial.legendre.leggauss(96)


STEPS = 200_000                 # a series that needs more raises, it never ends early


def _stirling(x):
    """ln Gamma(x) - [(x - 1/2) ln x - x + ln(2 pi)/2], without cancellation."""
    x = np.asarray(x, float)
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    small = np.minimum(x, 20.0)
    exact = _lgamma(small) - ((small - 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi))
    return np.where(x > 20, series, exact)


def _log_gamma_step(a, b):
    """ln Gamma(a + b) - ln Gamma(a), for a of any size."""
    return (a - 0.5) * np.log1p(b / a) + b * np.log(a + b) - b + _stirling(a + b) - _stirling(a)


def _betacf(a, b, x):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, STEPS + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < _EPS):
            return h
    raise ArithmeticError("incomplete beta did not converge")


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def betainc(a, b, x, y=None):
    """Regularised incomplete beta I_x(a, b); ``y`` = 1 - x where the caller
    has it exactly (x next to 1)."""
    y = 1.0 - np.asarray(x, float) if y is None else y
    a, b, x, y = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x, y))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    out[ok & (x == 0)] = 0.0
    out[ok & (y == 0)] = 1.0
    mid = ok & (x > 0) & (y > 0)
    if mid.any():
        am, bm, xm, ym = a[mid], b[mid], x[mid], y[mid]
        big, low = np.maximum(am, bm), np.minimum(am, bm)
        log_x, log_y = np.where(xm < 0.5, np.log(xm), np.log1p(-ym)), np.where(ym < 0.5, np.log(ym), np.log1p(-xm))
        lbt = _log_gamma_step(big, low) - _lgamma(low) + am * log_x + bm * log_y
        bt = np.exp(lbt)
        direct = (ym > (bm + 1.0) / (am + bm + 2.0)) & (ym > 1e-6)     # else x has lost its digits
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        if (~direct).any():
            nd = ~direct
            res[nd] = 1.0 - bt[nd] * _betacf(bm[nd], am[nd], ym[nd]) / bm[nd]
        out[mid] = res
    return out


def gammaincc(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    pos = ok & (x > 0)
    ser = pos & (x < a + 1.0)
    cf = pos & ~ser
    wide = pos & (a > 1e4)
    if wide.any():
        out[wide] = _gamma_tail(a[wide], x[wide])
    ser, cf = ser & ~wide, cf & ~wide
    if ser.any():
        aa, xx = a[ser], x[ser]
        ap, s, dl = aa.copy(), 1.0 / aa, 1.0 / aa
        for _ in range(STEPS):
            ap = ap + 1.0
            dl = dl * xx / ap
            s = s + dl
            if np.all(np.abs(dl) < np.abs(s) * _EPS):
                break
        else:
            raise ArithmeticError("incomplete gamma did not converge")
        out[ser] = 1.0 - s * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    if cf.any():
        aa, xx = a[cf], x[cf]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, STEPS):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1.0) < _EPS):
                break
        else:
            raise ArithmeticError("incomplete gamma did not converge")
        out[cf] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def _gamma_tail(a, x):
    """Q(a, x) for large a: Gauss-Legendre panels of the density from x on,
    in units of its standard deviation, scaled by Stirling's series."""
    out = np.empty(a.shape)
    for i, (ai, xi) in enumerate(zip(a, x)):
        sd, upper = math.sqrt(ai), xi >= ai
        edges = xi + np.linspace(0, 12, 25) * sd * (1 if upper else -1)
        mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
        z = mid[:, None] + half[:, None] * _GL_X[None, :]
        d = np.maximum((z - ai) / ai, -1 + 1e-300)
        log_f = (ai - 1) * np.log1p(d) - ai * d - 0.5 * math.log(2 * math.pi * ai) - float(_stirling(ai))
        tail = abs(float(np.sum(half[:, None] * _GL_W[None, :] * np.exp(log_f))))
        out[i] = tail if upper else 1.0 - tail
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_upper(x, k):
    return gammaincc(np.asarray(k, float) / 2.0, np.asarray(x, float) / 2.0)


def normal_two_sided(z):
    z = np.abs(np.asarray(z, float))
    return gammaincc(0.5, z * z / 2.0)


def _phi(x):
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _Phi(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x) / math.sqrt(2.0))


def _range_cdf_inf(w, k):
    """P(range of k standard normals <= w), vectorised over w."""
    w = np.atleast_1d(np.asarray(w, float))
    lo, hi = -8.0, 8.0
    z = 0.5 * (hi - lo) * _GL_X + 0.5 * (hi + lo)
    wz = 0.5 * (hi - lo) * _GL_W
    inner = (_Phi(z[None, :] + w[:, None]) - _Phi(z[None, :])) ** (k - 1)
    return k * np.sum(wz[None, :] * _phi(z)[None, :] * inner, axis=1)


def tukey_upper(q, k, df):
    """Upper tail of the studentized range distribution P(Q > q; k, df)."""
    q, k, df = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(q, k, df))
    out = np.empty(q.shape)
    for i in range(q.size):
        nu, qi, ki = df.flat[i], q.flat[i], int(k.flat[i])
        if not np.isfinite(qi) or qi <= 0:
            out.flat[i] = 1.0 if qi <= 0 else np.nan
            continue
        # s = chi_nu / sqrt(nu); integrate P(range <= q s) * f(s) over s.
        lo, hi = max(1e-6, 1 - 8 / math.sqrt(2 * nu)), 1 + 8 / math.sqrt(2 * nu)
        s = 0.5 * (hi - lo) * _GL_X + 0.5 * (hi + lo)
        ws = 0.5 * (hi - lo) * _GL_W
        d = s - 1.0
        logf = (math.log(2) + 0.5 * math.log(nu / 2) - 0.5 * math.log(2 * math.pi) - float(_stirling(nu / 2))
                + (nu - 1) * np.log1p(d) - nu * (d + d * d / 2))
        cdf = np.sum(ws * np.exp(logf) * _range_cdf_inf(qi * s, ki))
        out.flat[i] = min(max(1.0 - cdf, 0.0), 1.0)
    return out


def tukey_quantile(p, k, df):
    """Quantile of the studentized range: P(Q <= q; k, df) = p, by bisection."""
    lo, hi = 0.0, 1.0
    while 1.0 - tukey_upper(hi, k, df)[0] < p:
        hi *= 2
    while hi - lo > 1e-10 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1.0 - tukey_upper(mid, k, df)[0] < p else (lo, mid)
    return (lo + hi) / 2


# ---- pandas_udf wrappers (Arrow batches of aggregated result rows) ----

@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x.to_numpy(float), k.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def tukey_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(tukey_upper(q.to_numpy(float), k.to_numpy(float), df.to_numpy(float)))
