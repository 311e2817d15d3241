"""The few functions Spark has no expression for: Unicode folding, distribution tails, structure hook."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from assayloom.functions.text import ColumnLike, col_, file_name_of, safe_letters


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition."""
    return text.fillna("").map(lambda t: unicodedata.normalize("NFKD", t))


def safe_name(text: ColumnLike, max_length: int = 60, first: int = 240) -> Column:
    """``safe_file_name`` of a text of any length.

    What the beginning of a text gives begins what the whole gives. Where it fills the name, the rest cannot change it; only other texts are folded
    to their end.
    """
    whole = F.coalesce(col_(text), F.lit(""))
    head = nfkd(F.substring(whole, 1, first))
    enough = (F.length(whole) <= first) | (F.length(safe_letters(head)) >= max_length)
    rest = nfkd(F.when(~enough, whole))
    return file_name_of(safe_letters(F.when(rest == "", head).otherwise(rest)), whole, max_length)


_canonicalizer: Callable[[Column], Column] | None = None


def set_canonicalizer(fn: Callable[[Column], Column] | None) -> None:
    """Install a column function (for example a pandas UDF) that canonicalises structure texts."""
    global _canonicalizer
    _canonicalizer = fn


def canonical_structure(c: Column) -> Column | None:
    return None if _canonicalizer is None else _canonicalizer(c)


# ---- tail probabilities; inputs are one value per feature, never per row -----------------------------------

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _fraction(step, shape, rounds: int = 600) -> np.ndarray:
    """Continued fraction by the modified Lentz recurrence; ``step(m)`` gives the numerator and denominator terms."""
    value = np.full(shape, _TINY)
    c, d = value.copy(), np.zeros(shape)
    for m in range(rounds):
        a, b = step(m)
        d = b + a * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        factor = c * d
        value = value * factor
        if m > 2 and np.nanmax(np.abs(factor - 1.0), initial=0.0) < 1e-16:
            break
    return value


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*[np.atleast_1d(np.asarray(v, dtype=float)) for v in (x, a, b)])
    flip = x > (a + 1.0) / (a + b + 2.0)
    xx, aa, bb = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (xx > 0) & (xx < 1)
    xs = np.where(inside, xx, 0.5)

    def step(m):
        if m == 0:
            return np.ones_like(xs), np.ones_like(xs)
        k = m // 2
        if m == 1:
            return -(aa + bb) * xs / (aa + 1.0), np.ones_like(xs)
        if m % 2 == 0:
            return k * (bb - k) * xs / ((aa + 2 * k - 1) * (aa + 2 * k)), np.ones_like(xs)
        return -(aa + k) * (aa + bb + k) * xs / ((aa + 2 * k) * (aa + 2 * k + 1)), np.ones_like(xs)

    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xs) + bb * np.log1p(-xs)) / aa
        out = np.where(inside, front * _fraction(step, xs.shape), (xx >= 1).astype(float))
    out = np.where(flip, 1.0 - out, out)
    return np.where(np.isnan(x), np.nan, out)


def gamma_sf(x, a) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    x, a = np.broadcast_arrays(*[np.atleast_1d(np.asarray(v, dtype=float)) for v in (x, a)])
    xs = np.where(x > 0, x, 1.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(xs) - xs - _lgamma(a))
        term = 1.0 / a
        total = term.copy()
        for k in range(1, 2000):
            term = term * xs / (a + k)
            total = total + term
            if np.nanmax(np.abs(term / total), initial=0.0) < 1e-17:
                break
        series = 1.0 - front * total

        def step(m):
            if m == 0:
                return np.ones_like(xs), xs + 1.0 - a
            return -m * (m - a), xs + 2 * m + 1.0 - a

        tail = front * _fraction(step, xs.shape)
    out = np.where(xs < a + 1.0, series, tail)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of ``beta_cdf`` by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if beta_cdf(mid, a, b)[0] < p else (lo, mid)
    return (lo + hi) / 2.0


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact tail of the rank-sum statistic for small groups without ties."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    for k in range(1, n1 + 1):                      # Gaussian binomial, factor by factor
        up = counts.copy()
        for s in range(n2 + k, counts.size):
            up[s] -= counts[s - n2 - k]
        for s in range(k, counts.size):
            up[s] += up[s - k]
        counts = up
    probs = counts / counts.sum()
    high = max(u, n1 * n2 - u)
    return float(min(1.0, 2.0 * probs[int(math.ceil(high - 1e-9)):].sum()))


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)) if len(t) else pd.Series(dtype=float)


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, d1, d2)) if len(f) else pd.Series(dtype=float)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_sf(np.asarray(x, dtype=float) / 2.0, np.asarray(df, dtype=float) / 2.0)) if len(x) else pd.Series(dtype=float)


@F.pandas_udf(DoubleType())
def p_norm_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0))) if len(z) else pd.Series(dtype=float)


@F.pandas_udf(DoubleType())
def p_rank_sum_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_exact(a, int(b), int(c)) if a == a else float("nan") for a, b, c in zip(u, n1, n2)], dtype=float)
