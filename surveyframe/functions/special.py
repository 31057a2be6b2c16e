"""Special functions: log-gamma family as columns, distribution tails as Arrow functions.

Columns stay inside generated code and serve row-level likelihoods. Tails that need an
iteration (incomplete gamma and beta) run vectorised on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from surveyframe.functions.scalars import ColumnOrName, as_col

# --- columns ---------------------------------------------------------------------------


def _shifted(x: Column) -> Column:
    return x + F.lit(8.0)


def lgamma(x: ColumnOrName) -> Column:
    """ln Gamma(x) for x > 0: argument raised by eight, then Stirling's series."""
    x = as_col(x).cast("double")
    product = x
    for k in range(1, 8):
        product = product * (x + F.lit(float(k)))
    z = _shifted(x)
    r = 1.0 / z
    r2 = r * r
    series = r * (F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * F.lit(1 / 1680))))
    stirling = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series
    # For large x the product would overflow; there the plain series is exact enough.
    s = 1.0 / x
    s2 = s * s
    direct = (x - 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + s * (F.lit(1 / 12) - s2 * (F.lit(1 / 360) - s2 * F.lit(1 / 1260)))
    return F.when(x > 1e6, direct).otherwise(stirling - F.ln(product))


def digamma(x: ColumnOrName) -> Column:
    x = as_col(x).cast("double")
    lifted = F.lit(0.0)
    for k in range(8):
        lifted = lifted + 1.0 / (x + F.lit(float(k)))
    z = _shifted(x)
    r2 = 1.0 / (z * z)
    tail = r2 * (F.lit(1 / 12) - r2 * (F.lit(1 / 120) - r2 * (F.lit(1 / 252) - r2 * F.lit(1 / 240))))
    return F.ln(z) - 0.5 / z - tail - lifted


def trigamma(x: ColumnOrName) -> Column:
    x = as_col(x).cast("double")
    lifted = F.lit(0.0)
    for k in range(8):
        lifted = lifted + 1.0 / ((x + F.lit(float(k))) * (x + F.lit(float(k))))
    z = _shifted(x)
    r = 1.0 / z
    r2 = r * r
    return r + r2 / 2 + r * r2 * (F.lit(1 / 6) - r2 * (F.lit(1 / 30) - r2 * (F.lit(1 / 42) - r2 * F.lit(1 / 30)))) + lifted


# --- numpy kernels ---------------------------------------------------------------------

_np_lgamma = np.vectorize(math.lgamma, otypes=[float])
_np_erfc = np.vectorize(math.erfc, otypes=[float])
_ITERATIONS = 10_000
_TINY = 1e-300


def _gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[(x <= 0) & (a > 0)] = 1.0
    head = np.where((a > 0) & (x > 0), a * np.log(np.maximum(x, _TINY)) - x - _np_lgamma(np.where(a > 0, a, 1.0)), np.nan)
    low = (a > 0) & (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total, k = term.copy(), al.copy()
        for _ in range(_ITERATIONS):
            k += 1
            term = term * xl / k
            total += term
            if np.all(term < total * 1e-16):
                break
        out[low] = 1.0 - total * np.exp(head[low])
    high = (a > 0) & (x >= a + 1)
    if high.any():
        ah, xh = a[high], x[high]
        b = xh + 1 - ah
        c = np.full_like(b, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, _ITERATIONS):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = h * np.exp(head[high])
    return np.clip(out, 0, 1)


def _beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (v.copy() for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)))
    bad = ~((a > 0) & (b > 0) & (x >= 0) & (x <= 1))
    a[bad], b[bad], x[bad] = 1.0, 1.0, 0.5
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = (y > 0) & (y < 1)
    y = np.where(inner, y, 0.5)
    head = np.exp(_np_lgamma(p + q) - _np_lgamma(p) - _np_lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(p)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _ITERATIONS):
        last = None
        for num in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            last = d * c
            h = h * last
        if np.all(np.abs(last - 1) < 1e-15):
            break
    value = np.where(inner, head * h, np.where(flip, np.where(1 - x <= 0, 0.0, 1.0), np.where(x <= 0, 0.0, 1.0)))
    value = np.where(flip, 1 - value, value)
    value[bad] = np.nan
    return np.clip(value, 0, 1)


def _series(values: np.ndarray) -> pd.Series:
    return pd.Series(values).where(~np.isnan(values), None).astype("float64")


# --- Arrow functions -------------------------------------------------------------------
# Null arguments reach pandas as NaN and come back as null.


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return _series(_np_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return _series(0.5 * _np_erfc(-z.to_numpy(float) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.to_numpy(float), df.to_numpy(float)
    normal = _np_erfc(np.abs(t) / math.sqrt(2))
    finite = np.isfinite(df)
    d = np.where(finite, df, 1.0)
    return _series(np.where(finite, _beta_lower(d / 2, np.full_like(d, 0.5), d / (d + t * t)), np.where(np.isnan(df), np.nan, normal)))


@F.pandas_udf(DoubleType())
def _t_975(df: pd.Series) -> pd.Series:
    """97.5 % point by bisection of the beta tail: x = df / (df + t * t) has I_x(df / 2, 1 / 2) = 0.05."""
    n = df.to_numpy(float)
    usual = np.where(np.isfinite(n) & (n > 0), n, 1.0)
    low, high = np.zeros(len(n)), np.ones(len(n))
    for _ in range(60):
        x = (low + high) / 2
        less = _beta_lower(usual / 2, np.full(len(n), 0.5), x) < 0.05
        low, high = np.where(less, x, low), np.where(less, high, x)
    x = (low + high) / 2
    t = np.sqrt(usual * (1 - x) / x)
    return _series(np.where(np.isinf(n), 1.959963984540054, np.where(n > 0, t, np.nan)))


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(_gamma_upper(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(DoubleType())
def _f_tail(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    x, d1, d2 = x.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    return _series(_beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)))


def _poisson_lower(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    value = _gamma_upper(np.where(y < 0, 1.0, np.floor(y) + 1), mu)
    return np.where(y < 0, 0.0, value)


def _negative_binomial_lower(y: np.ndarray, mu: np.ndarray, size: np.ndarray) -> np.ndarray:
    value = _beta_lower(size, np.where(y < 0, 1.0, np.floor(y) + 1), size / (size + mu))
    return np.where(y < 0, 0.0, value)


@F.pandas_udf(DoubleType())
def _poisson_cdf(y: pd.Series, mu: pd.Series) -> pd.Series:
    return _series(_poisson_lower(y.to_numpy(float), mu.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _negative_binomial_cdf(y: pd.Series, mu: pd.Series, size: pd.Series) -> pd.Series:
    return _series(_negative_binomial_lower(y.to_numpy(float), mu.to_numpy(float), size.to_numpy(float)))


def _count_cdf(family: str, y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    if family == "poisson":
        return _poisson_lower(y, mu)
    return _negative_binomial_lower(y, mu, phi if family == "nb2" else mu / phi)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each distinct combination, each row's combination); missing values are equal."""
    which = pd.DataFrame(dict(enumerate(columns))).groupby(list(range(len(columns))), sort=False, dropna=False).ngroup().to_numpy()
    return np.unique(which, return_index=True)[1], which


#: Values of a distribution that a task remembers; it forgets them all when more come.
KNOWN_STEPS = 100_000


def _count_steps(family: str, nodes: list[tuple[float, float]]):
    """Distribution at y and at y - 1, averaged over ``nodes`` of a normal effect of deviation sigma.

    It is computed once per distinct mean, dispersion, deviation and count that a task meets, the counts and those below them together.
    """

    def values(y: np.ndarray, mu: np.ndarray, phi: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        total = 0.0
        for t, weight in nodes:
            total = total + weight * _count_cdf(family, y, mu * np.exp(sigma * t), phi)
        return total

    @F.pandas_udf("upto double, below double")
    def steps(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, float] = {}
        for batch in batches:
            rows = [c.to_numpy(float) for c in batch]
            first, row = _numbered(*rows)
            y, mu, phi, sigma = (c[first] for c in rows)
            twice = [np.concatenate([y, y - 1]), *[np.tile(c, 2) for c in (mu, phi, sigma)]]
            at, place = _numbered(*twice)
            places = np.column_stack([c[at] for c in twice])
            keys = [p.tobytes() for p in places]
            new = [k for k, key in enumerate(keys) if key not in known]
            if len(known) + len(new) > KNOWN_STEPS:
                known.clear()
                new = list(range(len(keys)))
            if new:
                known.update(zip([keys[k] for k in new], values(*places[new].T).tolist()))
            value = np.array([known[key] for key in keys], dtype=float)[place]
            yield pd.DataFrame({"upto": _series(value[: len(first)][row]), "below": _series(value[len(first) :][row])})

    return steps


@F.pandas_udf(DoubleType())
def _binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    k, n, p = np.floor(k.to_numpy(float)), n.to_numpy(float), p.to_numpy(float)
    inner = (k >= 0) & (k < n)
    value = _beta_lower(np.where(inner, n - k, 1.0), np.where(inner, k + 1, 1.0), 1 - p)
    return _series(np.where(k < 0, 0.0, np.where(k >= n, 1.0, value)))


@F.pandas_udf(DoubleType())
def _kolmogorov_tail(d: pd.Series, n: pd.Series) -> pd.Series:
    d, n = d.to_numpy(float), n.to_numpy(float)
    root = np.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    total = np.zeros_like(lam)
    for j in range(1, 101):
        total += 2 * (-1) ** (j - 1) * np.exp(-2 * j * j * lam * lam)
    return _series(np.where(lam < 0.2, 1.0, np.clip(total, 0, 1)))


def _double(c: ColumnOrName) -> Column:
    return as_col(c).cast("double")


def normal_two_sided(z: ColumnOrName) -> Column:
    return _normal_two_sided(_double(z))


def normal_cdf(z: ColumnOrName) -> Column:
    return _normal_cdf(_double(z))


def t_two_sided(t: ColumnOrName, df: ColumnOrName) -> Column:
    """Two-sided p; an infinite df gives the normal tail."""
    return _t_two_sided(_double(t), _double(df))


def t_975(df: ColumnOrName) -> Column:
    """97.5 % point of Student's t; an infinite df gives the normal point."""
    return _t_975(_double(df))


def chi2_upper_tail(x: ColumnOrName, df: ColumnOrName) -> Column:
    return _chi2_tail(_double(x), _double(df))


def f_upper_tail(x: ColumnOrName, d1: ColumnOrName, d2: ColumnOrName) -> Column:
    return _f_tail(_double(x), _double(d1), _double(d2))


def poisson_cdf(y: ColumnOrName, mu: ColumnOrName) -> Column:
    return _poisson_cdf(_double(y), _double(mu))


def negative_binomial_cdf(y: ColumnOrName, mu: ColumnOrName, size: ColumnOrName) -> Column:
    return _negative_binomial_cdf(_double(y), _double(mu), _double(size))


def count_steps(
    family: str, y: ColumnOrName, mu: ColumnOrName, phi: ColumnOrName, sigma: ColumnOrName | None = None, nodes: Sequence[tuple[float, float]] = ()
) -> Column:
    """Distribution of a count family at y (``upto``) and at y - 1 (``below``) as one struct.

    With ``sigma`` both are means over a normal effect on the log scale, given by standard normal ``nodes`` and their weights.
    """
    at = [(float(t), float(w)) for t, w in nodes] if sigma is not None else [(0.0, 1.0)]
    return _count_steps(family, at)(_double(y), _double(mu), _double(phi), _double(F.lit(0.0) if sigma is None else sigma))


def binomial_cdf(k: ColumnOrName, n: ColumnOrName, p: ColumnOrName) -> Column:
    return _binomial_cdf(_double(k), _double(n), _double(p))


def kolmogorov_tail(d: ColumnOrName, n: ColumnOrName) -> Column:
    return _kolmogorov_tail(_double(d), _double(n))
