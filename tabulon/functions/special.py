"""Distributions, error and Bessel functions.

Closed forms are expressions. The incomplete beta and gamma functions, which have none, are
series and continued fractions over whole Arrow batches in numpy.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import finite, let
from .core import function as _function
from .math import truncated

#: Arrow UDFs can't stand inside a bound call.
function = partial(_function, direct=True)
#: Of expressions alone: arguments and results are held once.
bound = partial(_function, bound=True)
ROOT2, ROOT2PI = math.sqrt(2.0), math.sqrt(2.0 * math.pi)


# ---- vectorised numerics ------------------------------------------------------------------
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's evaluation of the incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(~np.isfinite(delta) | (np.abs(delta - 1) < 1e-15)):
            break
    return h


def betainc(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    with np.errstate(all="ignore"):
        inside = np.clip(x, 1e-320, 1 - 1e-17)
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
        low = x < (a + 1) / (a + b + 2)
        one = np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)
        v = front * beta_fraction(*one) / one[0]
        out = np.where(low, v, 1 - v)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gammainc(x, a) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.maximum(x, 1e-320)) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all(~np.isfinite(term) | (np.abs(term) <= np.abs(total) * 1e-16) | (x > a + 1)):
                break
        b = x + 1 - a
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            delta = c * d
            h = h * delta
            if np.all(~np.isfinite(delta) | (np.abs(delta - 1) < 1e-15) | (x <= a + 1)):
                break
        out = np.where(x <= a + 1, front * total, 1 - front * h)
    return np.where(x <= 0, 0.0, np.clip(out, 0.0, 1.0))


def bisect(cdf, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = 100) -> np.ndarray:
    """Where an increasing ``cdf`` reaches ``p``."""
    lo, hi = (np.broadcast_to(v, p.shape).astype(float).copy() for v in (lo, hi))
    for _ in range(200):  # widen an open upper end
        short = cdf(hi) < p
        if not np.any(short & np.isfinite(hi)) or np.all(hi[short] > 1e300):
            break
        hi[short] = hi[short] * 2 + 1
    for _ in range(steps):
        mid = (lo + hi) / 2
        over = cdf(mid) >= p
        hi = np.where(over, mid, hi)
        lo = np.where(over, lo, mid)
    return (lo + hi) / 2


def t_cdf(x, df):
    tail = betainc(df / (df + x * x), df / 2, 0.5) / 2
    return np.where(x > 0, 1 - tail, tail)


def t_tail(x, df):
    return betainc(df / (df + x * x), df / 2, 0.5)


def f_cdf(x, d1, d2):
    return betainc(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def bessel(kind: str, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Integral representations by Gauss-Legendre quadrature over many panels; Y by its second integral."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    out = np.empty(len(x))
    for i, (v, k) in enumerate(zip(x, n)):
        def over(f, a, b, panels=16):
            edges = np.linspace(a, b, panels + 1)
            mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
            t = mid[:, None] + half[:, None] * nodes
            return float((f(t) * weights * half[:, None]).sum())

        if not np.isfinite(v) or k < 0 or (kind in "KY" and v <= 0):
            out[i] = np.nan
        elif kind == "J":
            out[i] = over(lambda t: np.cos(k * t - v * np.sin(t)), 0, np.pi) / np.pi
        elif kind == "I":
            out[i] = over(lambda t: np.exp(v * np.cos(t)) * np.cos(k * t), 0, np.pi) / np.pi
        elif kind == "K":
            top = np.arccosh(1 + (700 + k * 20) / v)
            with np.errstate(all="ignore"):
                out[i] = over(lambda t: np.exp(-v * np.cosh(t) + np.log(np.cosh(k * t))), 0, top, 64)
        else:
            top = np.arcsinh((700 + k * 20) / v)
            with np.errstate(all="ignore"):
                first = over(lambda t: np.sin(v * np.sin(t) - k * t), 0, np.pi) / np.pi
                second = over(lambda t: (np.exp(k * t - v * np.sinh(t)) + (-1.0) ** k * np.exp(-k * t - v * np.sinh(t))), 0, top, 64) / np.pi
            out[i] = first - second
    return out


def batched(f, *args: Column) -> Column:
    """``f`` of numpy arrays as an Arrow UDF; rows with a null argument stay null."""

    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        values = [frame[c].to_numpy(float) for c in frame.columns]
        ok = np.all([np.isfinite(v) for v in values], axis=0) if values else np.array([], bool)
        out = np.full(len(frame), np.nan)
        if ok.any():
            with np.errstate(all="ignore"):
                out[ok] = f(*[v[ok] for v in values])
        return pd.Series(out)

    return run(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(args)]))


# ---- normal -------------------------------------------------------------------------------
def erf_exact(x: Column) -> Column:
    """Error function to rounding: Taylor series near 0, a continued fraction beyond."""

    def body(v: Column) -> Column:
        a = F.abs(v)
        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")), lambda s, n: F.struct((s["t"] * (-a * a) / n).alias("t"), (s["s"] + s["t"] * (-a * a) / n / (2 * n + 1)).alias("s")), lambda s: s["s"] * 2 / math.sqrt(math.pi))
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, n: (n / 2.0) / (a + acc))
        tail = F.exp(-a * a) / math.sqrt(math.pi) / (a + fraction)
        return F.signum(v) * F.when(a < 2.5, series).otherwise(1 - tail)

    return let(x, body)


def phi(z: Column) -> Column:
    return F.exp(-z * z / 2) / ROOT2PI


def normal_cdf(z: Column) -> Column:
    return (1 + erf_exact(z / ROOT2)) / 2


#: Coefficients of the rational approximation to the normal quantile.
CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    return let(p, _quantile)


def _quantile(p: Column) -> Column:
    q, edge = p - 0.5, 0.02425
    r = q * q
    middle = q * polynomial(r, CENTRE[0]) / polynomial(r, CENTRE[1])
    tail = lambda u: polynomial(u, TAIL[0]) / polynomial(u, TAIL[1])
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < edge, tail(low)).when(p > 1 - edge, -tail(high)).otherwise(middle)


bound("ERF", "n n=")(lambda a, b=None: erf_exact(a) if b is None else erf_exact(b) - erf_exact(a))
bound("ERF.PRECISE", "n")(erf_exact)
bound("ERFC", "n", "ERFC.PRECISE")(lambda x: 1 - erf_exact(x))
bound("PHI", "n")(phi)
bound("GAUSS", "n")(lambda z: normal_cdf(z) - 0.5)
bound("NORM.S.DIST", "n l")(lambda z, c: F.when(c, normal_cdf(z)).otherwise(phi(z)))
bound("NORMSDIST", "n")(normal_cdf)
function("FISHER", "n")(lambda x: finite(F.atanh(x), (F.abs(x) >= 1, "#NUM!")))
function("FISHERINV", "n")(lambda x: F.tanh(x))
function("STANDARDIZE", "n n n")(lambda x, m, s: finite(F.try_divide(x - m, s), (s <= 0, "#NUM!")))
PROBABILITY = lambda p: ((p <= 0) | (p >= 1), "#NUM!")
bound("NORM.S.INV", "n", "NORMSINV")(lambda p: finite(normal_quantile(p), PROBABILITY(p)))
bound("NORM.INV", "n n n", "NORMINV")(lambda p, m, s: finite(m + s * normal_quantile(p), PROBABILITY(p), (s <= 0, "#NUM!")))
bound("NORM.DIST", "n n n l", "NORMDIST")(lambda x, m, s, c: finite(F.when(c, normal_cdf(F.try_divide(x - m, s))).otherwise(F.try_divide(phi(F.try_divide(x - m, s)), s)), (s <= 0, "#NUM!")))
bound("LOGNORM.DIST", "n n n l")(lambda x, m, s, c: finite(F.when(c, normal_cdf((F.ln(x) - m) / s)).otherwise(phi((F.ln(x) - m) / s) / (x * s)), ((x <= 0) | (s <= 0), "#NUM!")))
bound("LOGNORMDIST", "n n n")(lambda x, m, s: finite(normal_cdf((F.ln(x) - m) / s), ((x <= 0) | (s <= 0), "#NUM!")))
bound("LOGNORM.INV", "n n n", "LOGINV")(lambda p, m, s: finite(F.exp(m + s * normal_quantile(p)), PROBABILITY(p), (s <= 0, "#NUM!")))
bound("CONFIDENCE", "n n n", "CONFIDENCE.NORM")(lambda a, s, n: finite(normal_quantile(1 - a / 2) * s / F.sqrt(F.floor(n)), PROBABILITY(a), ((s <= 0) | (n < 1), "#NUM!")))
function("WEIBULL", "n n n l", "WEIBULL.DIST")(lambda x, a, b, c: finite(F.when(c, 1 - F.exp(-F.pow(x / b, a))).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * F.exp(-F.pow(x / b, a))), ((x < 0) | (a <= 0) | (b <= 0), "#NUM!")))
function("EXPON.DIST", "n n l", "EXPONDIST")(lambda x, k, c: finite(F.when(c, 1 - F.exp(-k * x)).otherwise(k * F.exp(-k * x)), ((x < 0) | (k <= 0), "#NUM!")))


# ---- discrete -----------------------------------------------------------------------------
def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence; x > 0."""

    def series(v: Column) -> Column:
        y = v + 8
        out = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
        for i in range(8):
            out = out - F.ln(v + i)
        return out

    return let(x, series)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def summed(lo: Column, hi: Column, f) -> Column:
    span = F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(span, F.lit(0.0), lambda a, i: a + f(i.cast("double")))


def binomial(k, n, p):
    edge = F.when(p == 0, (k == 0).cast("double")).when(p == 1, (k == n).cast("double"))
    return F.coalesce(edge, F.exp(log_choose(n, k) + k * F.ln(p) + (n - k) * F.ln(1 - p)))


@bound("BINOM.DIST", "n n n l", "BINOMDIST")
def binom_dist(k, n, p, c):
    k, n = truncated(k), truncated(n)
    wrong = (k < 0) | (k > n) | (p < 0) | (p > 1) | (n > 1e6)
    return finite(F.when(~wrong, F.when(c, summed(F.lit(0.0), k, lambda i: binomial(i, n, p))).otherwise(binomial(k, n, p))), (wrong, "#NUM!"))


@bound("BINOM.DIST.RANGE", "n n n n=")
def binom_range(n, p, a, b=None):
    n, a = truncated(n), truncated(a)
    b = a if b is None else truncated(b)
    wrong = (a < 0) | (b < a) | (b > n) | (p < 0) | (p > 1) | (n > 1e6)
    return finite(F.when(~wrong, summed(a, b, lambda i: binomial(i, n, p))), (wrong, "#NUM!"))


@bound("BINOM.INV", "n n n", "CRITBINOM")
def binom_inv(n, p, alpha):
    n = truncated(n)
    wrong = (n < 0) | (n > 1e6) | (p <= 0) | (p >= 1) | (alpha <= 0) | (alpha >= 1)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("k"))

    def step(a, i):
        s = a["sum"] + binomial(i.cast("double"), n, p)
        return F.struct(s.alias("sum"), F.coalesce(a["k"], F.when(s >= alpha, i.cast("double"))).alias("k"))

    span = F.sequence(F.lit(0).cast("long"), F.when(wrong, 0).otherwise(n).cast("long"))
    return finite(F.aggregate(span, start, step, lambda a: F.coalesce(a["k"], n)), (wrong, "#NUM!"))


@bound("POISSON", "n n l", "POISSON.DIST")
def poisson(k, m, c):
    k = truncated(k)
    pmf = lambda i: F.when(m == 0, (i == 0).cast("double")).otherwise(F.exp(i * F.ln(m) - m - log_gamma(i + 1)))
    wrong = (k < 0) | (m < 0) | (k > 1e6)
    return finite(F.when(~wrong, F.when(c, summed(F.lit(0.0), k, pmf)).otherwise(pmf(k))), (wrong, "#NUM!"))


def hypergeometric(k, n, good, size):
    return F.exp(log_choose(good, k) + log_choose(size - good, n - k) - log_choose(size, n))


@bound("HYPGEOM.DIST", "n n n n l")
def hypgeom(k, n, good, size, c):
    k, n, good, size = map(truncated, (k, n, good, size))
    low = F.greatest(F.lit(0.0), n - (size - good))
    wrong = (k < low) | (k > n) | (k > good) | (n > size) | (good > size) | (size > 1e6)
    return finite(F.when(~wrong, F.when(c, summed(low, k, lambda i: hypergeometric(i, n, good, size))).otherwise(hypergeometric(k, n, good, size))), (wrong, "#NUM!"))


@bound("HYPGEOMDIST", "n n n n")
def hypgeom_old(k, n, good, size):
    k, n, good, size = map(truncated, (k, n, good, size))
    wrong = (k < F.greatest(F.lit(0.0), n - (size - good))) | (k > n) | (k > good) | (n > size) | (good > size)
    return finite(F.when(~wrong, hypergeometric(k, n, good, size)), (wrong, "#NUM!"))


def negative_binomial(f, s, p):
    return F.exp(log_choose(f + s - 1, s - 1) + s * F.ln(p) + f * F.ln(1 - p))


@bound("NEGBINOM.DIST", "n n n l")
def negbinom(f, s, p, c):
    f, s = truncated(f), truncated(s)
    wrong = (f < 0) | (s < 1) | (p <= 0) | (p >= 1) | (f > 1e6)
    return finite(F.when(~wrong, F.when(c, summed(F.lit(0.0), f, lambda i: negative_binomial(i, s, p))).otherwise(negative_binomial(f, s, p))), (wrong, "#NUM!"))


@bound("NEGBINOMDIST", "n n n")
def negbinom_old(f, s, p):
    f, s = truncated(f), truncated(s)
    return finite(negative_binomial(f, s, p), ((f < 0) | (s < 1) | (p <= 0) | (p >= 1), "#NUM!"))


# ---- gamma, beta and their kin --------------------------------------------------------------
def log_density_gamma(x, a, b):
    return F.exp((a - 1) * F.ln(x) - x / b - a * F.ln(b) - log_gamma(a))


@bound("GAMMALN", "n", "GAMMALN.PRECISE")
def gammaln(x):
    return finite(log_gamma(x), (x <= 0, "#NUM!"))


@bound("GAMMA", "n")
def gamma(x):
    """By the reflection formula below 0."""
    up = F.exp(log_gamma(x))
    down = math.pi / (F.sin(math.pi * x) * F.exp(log_gamma(1 - x)))
    rounded = F.when((x == F.floor(x)) & (x <= 20), F.floor(up + 0.5).cast("double")).otherwise(up)
    return finite(F.when(x > 0, rounded).otherwise(down), ((x <= 0) & (x == F.floor(x)), "#NUM!"))


GAMMA_RULES = lambda x, a, b: ((x < 0) | (a <= 0) | (b <= 0), "#NUM!")


@function("GAMMA.DIST", "n n n l", "GAMMADIST")
def gamma_dist(x, a, b, c):
    return finite(F.when(c, batched(gammainc, x / b, a)).otherwise(log_density_gamma(x, a, b)), GAMMA_RULES(x, a, b))


@function("GAMMA.INV", "n n n", "GAMMAINV")
def gamma_inv(p, a, b):
    return finite(batched(lambda q, k: bisect(lambda v: gammainc(v, k), q, np.zeros_like(q), k + 1), p, a) * b, ((p < 0) | (p >= 1) | (a <= 0) | (b <= 0), "#NUM!"))


@function("CHISQ.DIST", "n n l")
def chisq_dist(x, df, c):
    k = truncated(df)
    return finite(F.when(c, batched(gammainc, x / 2, k / 2)).otherwise(log_density_gamma(x, k / 2, F.lit(2.0))), ((x < 0) | (k < 1), "#NUM!"))


@function("CHISQ.DIST.RT", "n n", "CHIDIST")
def chisq_rt(x, df):
    k = truncated(df)
    return finite(1 - batched(gammainc, x / 2, k / 2), ((x < 0) | (k < 1), "#NUM!"))


def chi_quantile(q, k):
    return 2 * bisect(lambda v: gammainc(v, k / 2), q, np.zeros_like(q), k + 1)


@function("CHISQ.INV", "n n")
def chisq_inv(p, df):
    return finite(batched(chi_quantile, p, truncated(df)), ((p < 0) | (p >= 1) | (df < 1), "#NUM!"))


@function("CHISQ.INV.RT", "n n", "CHIINV")
def chisq_inv_rt(p, df):
    return finite(batched(chi_quantile, 1 - p, truncated(df)), ((p <= 0) | (p > 1) | (df < 1), "#NUM!"))


def beta_density(x, a, b):
    return F.exp((a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))


@function("BETA.DIST", "n n n l n=0 n=1")
def beta_dist(x, a, b, c, lo, hi):
    z = F.try_divide(x - lo, hi - lo)
    return finite(F.when(c, batched(betainc, z, a, b)).otherwise(beta_density(z, a, b) / (hi - lo)), ((a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo == hi), "#NUM!"))


@function("BETADIST", "n n n n=0 n=1")
def beta_dist_old(x, a, b, lo, hi):
    return finite(batched(betainc, F.try_divide(x - lo, hi - lo), a, b), ((a <= 0) | (b <= 0) | (x < lo) | (x > hi) | (lo == hi), "#NUM!"))


@function("BETA.INV", "n n n n=0 n=1", "BETAINV")
def beta_inv(p, a, b, lo, hi):
    found = batched(lambda q, i, j: bisect(lambda v: betainc(v, i, j), q, np.zeros_like(q), np.ones_like(q)), p, a, b)
    return finite(lo + found * (hi - lo), ((p <= 0) | (p >= 1) | (a <= 0) | (b <= 0), "#NUM!"))


def f_density(x, a, b):
    return F.exp(a / 2 * F.ln(a) + b / 2 * F.ln(b) + (a / 2 - 1) * F.ln(x) - (a + b) / 2 * F.ln(b + a * x) + log_gamma((a + b) / 2) - log_gamma(a / 2) - log_gamma(b / 2))


F_RULES = lambda a, b: ((a < 1) | (b < 1), "#NUM!")


@function("F.DIST", "n n n l")
def f_dist(x, a, b, c):
    a, b = truncated(a), truncated(b)
    return finite(F.when(c, batched(f_cdf, x, a, b)).otherwise(f_density(x, a, b)), F_RULES(a, b), (x < 0, "#NUM!"))


@function("F.DIST.RT", "n n n", "FDIST")
def f_rt(x, a, b):
    a, b = truncated(a), truncated(b)
    return finite(1 - batched(f_cdf, x, a, b), F_RULES(a, b), (x < 0, "#NUM!"))


def f_quantile(q, a, b):
    return bisect(lambda v: f_cdf(v, a, b), q, np.zeros_like(q), np.ones_like(q))


@function("F.INV", "n n n")
def f_inv(p, a, b):
    a, b = truncated(a), truncated(b)
    return finite(batched(f_quantile, p, a, b), F_RULES(a, b), ((p < 0) | (p >= 1), "#NUM!"))


@function("F.INV.RT", "n n n", "FINV")
def f_inv_rt(p, a, b):
    a, b = truncated(a), truncated(b)
    return finite(batched(f_quantile, 1 - p, a, b), F_RULES(a, b), ((p <= 0) | (p > 1), "#NUM!"))


def t_density(x, k):
    return F.exp(log_gamma((k + 1) / 2) - log_gamma(k / 2) - 0.5 * F.ln(k * math.pi) - (k + 1) / 2 * F.ln(1 + x * x / k))


@function("T.DIST", "n n l")
def t_dist(x, df, c):
    k = truncated(df)
    return finite(F.when(c, batched(t_cdf, x, k)).otherwise(t_density(x, k)), (k < 1, "#NUM!"))


@function("T.DIST.RT", "n n")
def t_rt(x, df):
    return finite(1 - batched(t_cdf, x, truncated(df)), (df < 1, "#NUM!"))


@function("T.DIST.2T", "n n")
def t_2t(x, df):
    return finite(batched(t_tail, x, truncated(df)), ((df < 1) | (x < 0), "#NUM!"))


@function("TDIST", "n n n")
def t_old(x, df, tails):
    both = batched(t_tail, x, truncated(df))
    k = truncated(tails)
    return finite(F.when(k == 1, both / 2).otherwise(both), ((df < 1) | (x < 0) | ~k.isin(1.0, 2.0), "#NUM!"))


def t_quantile(q, k):
    """Symmetric: the upper half is found and mirrored."""
    up = np.where(q >= 0.5, q, 1 - q)
    v = bisect(lambda x: t_cdf(x, k), up, np.zeros_like(q), np.ones_like(q))
    return np.where(q >= 0.5, v, -v)


@function("T.INV", "n n")
def t_inv(p, df):
    return finite(batched(t_quantile, p, truncated(df)), PROBABILITY(p), (df < 1, "#NUM!"))


@function("T.INV.2T", "n n", "TINV")
def t_inv_2t(p, df):
    return finite(batched(lambda q, k: t_quantile(1 - q / 2, k), p, truncated(df)), ((p <= 0) | (p > 1) | (df < 1), "#NUM!"))


@function("CONFIDENCE.T", "n n n")
def confidence_t(a, s, n):
    k = truncated(n)
    return finite(batched(lambda q, m: t_quantile(1 - q / 2, m - 1), a, k) * s / F.sqrt(k), PROBABILITY(a), (k == 1, "#DIV/0!"), ((s <= 0) | (k < 1), "#NUM!"))


def _bessel(kind: str) -> None:
    @function(f"BESSEL{kind}", "n n")
    def body(x, n):
        k = truncated(n)
        rules = [(k < 0, "#NUM!")] + ([(x <= 0, "#NUM!")] if kind in "KY" else [])
        return finite(batched(lambda v, m: bessel(kind, v, m), x, k), *rules)


for _kind in "IJKY":
    _bessel(_kind)

