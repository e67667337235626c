"""Tail probabilities of the t, F, chi-square and normal distributions.

``norm_cdf`` and ``norm_ppf`` are column expressions for use on every row. The others are Arrow
functions meant for result rows, one per test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FAR = 1e6  # from here on the expansions in 1 / df are exact to double precision, and continued fractions are slow


def _each(f, x):
    x = np.asarray(x, float)
    return np.fromiter(map(f, x.ravel().tolist()), float, x.size).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


def beta_share(x, a, b):
    """Regularised incomplete beta function by its continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = np.clip(z, 1e-300, 1 - 1e-16)
    front = np.exp(p * np.log(inner) + q * np.log1p(-inner) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    tiny = 1e-300
    d = 1 - (p + q) * inner / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, h = np.ones_like(inner), d.copy()
    for m in range(1, 20_000):
        for num in (m * (q - m) * inner / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * inner / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    h = np.where(np.abs(d * c - 1) < 1e-9, h, np.nan)  # not converged: no number
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - value, value)


def gamma_tail(a, x):
    """Upper regularised incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    safe = np.maximum(x, 1e-300)
    scale = np.exp(a * np.log(safe) - safe - _lgamma(a))
    term = total = 1 / a
    for k in range(1, 20_000):
        term = term * safe / (a + k)
        total = total + term
        if np.all(np.abs(term) < np.abs(total) * 1e-16):
            break
    lower = scale * total
    b = safe + 1 - a
    c = np.full_like(safe, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for k in range(1, 20_000):
        num = -k * (k - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + num / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    h = np.where(np.abs(d * c - 1) < 1e-9, h, np.nan)  # not converged: no number
    lower = np.where(np.abs(term) < np.abs(total) * 1e-9, lower, np.nan)
    return np.where(x <= 0, 1.0, np.where(safe < a + 1, 1 - lower, scale * h))


def t_tail(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    d, square = np.clip(df, 1e-9, FAR), np.minimum(t * t, 1e300)
    half = 0.5 * beta_share(d / (d + square), d / 2, 0.5)
    out = np.where(t > 0, half, 1 - half)
    wide = np.where(np.isposinf(df), 1e300, np.where(df > FAR, df, FAR))
    spread = np.where(np.isposinf(df), square, (wide - 0.5) * np.log1p(square / wide))  # its root is normal up to terms in 1 / df²
    out = np.where(df > FAR, 0.5 * _erfc(np.sign(t) * np.sqrt(spread / 2)), out)
    out = np.where(np.isposinf(t), 0.0, np.where(np.isneginf(t), 1.0, out))
    return np.where(np.isnan(t) | ~(df > 0), np.nan, out)


def f_tail(f, d1, d2):
    """P(F > f)."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    a, b = np.clip(d1, 1e-9, None), np.clip(d2, 1e-9, None)
    g = np.clip(f, 0, 1e290)
    small_a, small_b = np.minimum(a, FAR), np.minimum(b, FAR)
    out = beta_share(small_b / (small_b + small_a * g), small_b / 2, small_a / 2)

    def wide(few, many, ratio):
        """Share above: (many + few / 2 - 1) / 2 · log(1 + few · ratio / many) is gamma of shape few / 2 up to terms in 1 / many²."""
        finite = np.where(np.isposinf(many), 1.0, many)
        scale = np.where(np.isposinf(many), few * ratio / 2, (finite + few / 2 - 1) / 2 * np.log1p(few * ratio / finite))
        return gamma_tail(few / 2, scale)

    out = np.where((b > FAR) & (a <= FAR), wide(small_a, b, g), out)
    out = np.where((a > FAR) & (b <= FAR), 1 - wide(small_b, a, 1 / np.maximum(g, 1e-290)), out)
    cube, va, vb = np.cbrt(g), 2 / (9 * a), 2 / (9 * b)  # both large: cube roots are normal up to terms in 1 / df
    out = np.where((a > FAR) & (b > FAR), 0.5 * _erfc(((1 - vb) * cube - (1 - va)) / np.sqrt(2 * (va + vb * cube * cube))), out)
    out = np.where(np.isposinf(f), 0.0, out)
    return np.where(np.isnan(f) | ~(d1 > 0) | ~(d2 > 0), np.nan, out)


def t_point(p, df):
    """t with P(T <= t) = p, by bisection on the tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(1100):
        low, high = t_tail(lo, df) < 1 - p, t_tail(hi, df) > 1 - p
        if not (low.any() or high.any()):
            break
        lo, hi = np.where(low, lo * 2, lo), np.where(high, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        up = t_tail(mid, df) > 1 - p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        if np.all(hi - lo <= 1e-15 * np.maximum(1, np.abs(mid))):
            break
    return np.where(df > 0, (lo + hi) / 2, np.nan)


def _values(s: pd.Series) -> np.ndarray:
    return s.astype(float).to_numpy()


def _series(a) -> pd.Series:
    a = np.asarray(a, float)
    return pd.Series(a).where(~np.isnan(a), None)


def t_sf(t: Column, df: Column) -> Column:
    @pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(t_tail(_values(a), _values(b)))
    return tail(t, df)


def t_ppf(p: Column, df: Column) -> Column:
    @pandas_udf("double")
    def point(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(t_point(_values(a), _values(b)))
    return point(p, df)


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    @pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _series(f_tail(_values(a), _values(b), _values(c)))
    return tail(f, d1, d2)


def chi2_sf(x: Column, df: Column) -> Column:
    @pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        x, d = _values(a), _values(b)
        return _series(np.where(np.isnan(x) | ~(d > 0), np.nan, gamma_tail(np.maximum(d, 1e-9) / 2, x / 2)))
    return tail(x, df)


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# Rational approximation of the normal tail below |z| = 7.07.
NORMAL_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
              221.213596169931, 220.206867912376]
NORMAL_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
              637.333633378831, 793.826512519948, 440.413735824752]


def norm_cdf(z: Column) -> Column:
    """Normal distribution function, double precision, as an expression."""
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    near = e * _poly(x, NORMAL_NUM) / _poly(x, NORMAL_DEN)
    far = x + F.lit(0.65)
    for k in (4, 3, 2, 1):
        far = x + F.lit(float(k)) / far
    tail = F.when(x < 7.07106781186547, near).otherwise(e / far / F.lit(2.506628274631))
    tail = F.when(x > 37, F.lit(0.0)).otherwise(tail)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


# Acklam's rational approximation of the normal quantile.
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
PPF_EDGE = 0.02425


def norm_ppf(p: Column) -> Column:
    """Normal quantile to about nine digits, as an expression; null outside (0, 1)."""
    low = F.least(p, F.lit(1.0) - p)
    q = F.sqrt(F.lit(-2.0) * F.log(F.when(low > 0, low)))
    tail = _poly(q, PPF_C) / _poly(q, PPF_D)
    c = p - 0.5
    r = c * c
    middle = _poly(r, PPF_A) * c / _poly(r, PPF_B)
    value = F.when(low >= PPF_EDGE, middle).otherwise(F.when(p < 0.5, tail).otherwise(-tail))
    return F.when((p > 0) & (p < 1), value)


def rank_sum_law(n1: int, n2: int) -> np.ndarray:
    """Probabilities of U = 0 … n1·n2 for two groups of distinct values: the largest value belongs to one group or the other."""
    row = [np.ones(1) for _ in range(n2 + 1)]  # no value in the first group
    for i in range(1, n1 + 1):
        new = [np.ones(1)]
        for j in range(1, n2 + 1):
            law = np.zeros(i * j + 1)
            law[j:] += i / (i + j) * row[j]
            law[: i * (j - 1) + 1] += j / (i + j) * new[j - 1]
            new.append(law)
        row = new
    return row[n2]


def signed_rank_law(n: int) -> np.ndarray:
    """Probabilities of the sum of the positive ranks, 0 … n(n + 1)/2, each of the ranks 1 … n being positive or not."""
    law = np.ones(1)
    for r in range(1, n + 1):
        law = 0.5 * (np.append(law, np.zeros(r)) + np.append(np.zeros(r), law))
    return law


def _tail_of(law: np.ndarray, stat: float, alternative: str) -> float:
    above, below = law[math.ceil(stat - 1e-9):].sum(), law[: math.floor(stat + 1e-9) + 1].sum()
    return float(min(1.0, {"greater": above, "less": below}.get(alternative, 2 * min(above, below))))


def ranksum_p(u: Column, n1: Column, n2: Column, alternative: Column) -> Column:
    """Exact p of the rank-sum statistic, null where the groups are too large for counting (n1·n2 above 250,000)."""
    @pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, how: pd.Series) -> pd.Series:
        laws, out = {}, []
        for s, m, n, h in zip(a, b.astype(int), c.astype(int), how):
            if m * n > 250_000 or m < 1 or n < 1:
                out.append(None)
                continue
            if (m, n) not in laws:
                laws[m, n] = rank_sum_law(min(m, n), max(m, n))
            out.append(_tail_of(laws[m, n], s, h))
        return pd.Series(out, dtype=float)
    return exact(u, n1, n2, alternative)


def signed_rank_p(plus: Column, n: Column, alternative: Column) -> Column:
    """Exact p of the sum of positive ranks, null above 1,000 differences."""
    @pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series, how: pd.Series) -> pd.Series:
        laws, out = {}, []
        for s, m, h in zip(a, b.fillna(0).astype(int), how):
            if m < 1 or m > 1000:
                out.append(None)
                continue
            if m not in laws:
                laws[m] = signed_rank_law(m)
            out.append(_tail_of(laws[m], s, h))
        return pd.Series(out, dtype=float)
    return exact(plus, n, alternative)
