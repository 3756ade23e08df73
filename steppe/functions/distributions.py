"""Distribution functions as Column expressions.

Spark has no log-gamma, incomplete gamma or normal quantile. Those of closed form
are built from built-in functions, so that they stay in the JVM. The incomplete
gamma function and its quantile are series and steps of a length that the values
decide; a higher-order function evaluates those term by term without generated
code, so whole columns go through ``gamma_p_batch`` and ``gamma_ppf``, in Arrow
batches. ``gamma_p`` is the form that may stand inside a lambda.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7, nine terms).
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)

# Rational approximations of the normal quantile (AS 241).
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _poly(x: Column, coefficients) -> Column:
    total = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(float(c))
    return total


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


#: Shapes beyond this are nearly normal in their cube root: the error is under 1e-7.
LARGE_SHAPE = 1e6


def _gamma_series(v: Column) -> Column:
    """P(a, x) of a struct (a, x): as many terms as its value needs.

    Beyond x - a terms each is smaller than the one before, and the rest decay
    like a Gaussian tail.
    """
    a, x = v["a"], v["x"]
    terms = (F.greatest(x - a, F.lit(0.0)) + 10 * F.sqrt(F.greatest(a, x)) + 30).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * x / (a + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["total"])
    head = a * F.log(x) - x - log_gamma(a + 1.0)
    return F.least(F.lit(1.0), F.exp(head + F.log(total)))


def _cube_root_normal(v: Column) -> Column:
    """P(a, x) of a very large shape, by the normal distribution of the cube root."""
    a = v["a"]
    z = 3 * F.sqrt(a) * (F.cbrt(v["x"] / a) - 1 + 1 / (9 * a))

    def phi(z):
        half = F.struct(F.lit(0.5).alias("a"), F.greatest(F.lit(1e-300), F.least(z * z / 2, F.lit(60.0))).alias("x"))
        return 0.5 + F.signum(z) * let(half, _gamma_series) / 2

    return let(z, phi)


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma P(a, x); null for a <= 0, 0 for x <= 0.

    Far above the shape the other tail is under exp(-45) and the value is 1, so
    the number of terms is bounded by some square roots of the shape.
    """

    def inner(v):
        a, x = v["a"], v["x"]
        surely = (x > a) & (x - a - a * F.log(x / a) > 45)
        return F.when(surely, 1.0).when(a > LARGE_SHAPE, _cube_root_normal(v)).otherwise(_gamma_series(v))

    value = F.struct(a.cast("double").alias("a"), x.cast("double").alias("x"))
    return F.when(a > 0, F.when(x > 0, let(value, inner)).when(x <= 0, 0.0))


def norm_cdf(x: Column) -> Column:
    half = gamma_p(F.lit(0.5), x * x / 2) / 2
    return F.when(x >= 0, 0.5 + half).when(x < 0, 0.5 - half)


def norm_ppf(p: Column) -> Column:
    """Normal quantile; null outside (0, 1)."""

    def inner(p):
        q = p - 0.5
        central = let(0.180625 - q * q, lambda r: q * _poly(r, CENTRE[0]) / _poly(r, CENTRE[1]))

        def outer(r):
            near = let(r - 1.6, lambda s: _poly(s, MIDDLE[0]) / _poly(s, MIDDLE[1]))
            far = let(r - 5.0, lambda s: _poly(s, TAIL[0]) / _poly(s, TAIL[1]))
            return F.when(r <= 5, near).otherwise(far)

        tail = let(F.sqrt(-F.log(F.least(p, 1 - p))), outer) * F.signum(q)
        return F.when(F.abs(q) <= 0.425, central).otherwise(tail)

    return F.when((p > 0) & (p < 1), let(p.cast("double"), inner))


def _kernels():
    """Both functions on arrays, nested so that they travel to the executors by value."""
    import math

    import numpy as np

    lanczos, large, (top, bottom) = LANCZOS, LARGE_SHAPE, CENTRE

    def log_gamma_of(x):
        z = x - 1.0
        total = lanczos[0] + sum(c / (z + i) for i, c in enumerate(lanczos[1:], 1))
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)

    def head(a, x):
        """ln of x^a exp(-x) / Gamma(a + 1), without the cancellation of large terms."""
        d = (x - a) / a
        w = 1 / (a * a)
        rest = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / a
        stirling = -a * (d - np.log1p(d)) - 0.5 * np.log(2 * math.pi * a) - rest
        return np.where(a >= 10, stirling, a * np.log(x) - x - log_gamma_of(a + 1))

    def series(a, x):
        """P(a, x): terms until what follows can't be seen."""
        out = np.ones(len(a))
        at, k = np.arange(len(a)), 0
        term, sums, one, other = np.ones(len(a)), np.ones(len(a)), a, x
        while len(at):
            for _ in range(16):
                k += 1
                term = term * (other / (one + k))
                sums = sums + term
            going = (term > 1e-18 * sums) | (one + k < other)
            out[at[~going]] = sums[~going]
            at, term, sums, one, other = at[going], term[going], sums[going], one[going], other[going]
        return np.minimum(1.0, np.exp(head(a, x) + np.log(out)))

    def cube_root_normal(a, x):
        z = 3 * np.sqrt(a) * (np.cbrt(x / a) - 1 + 1 / (9 * a))
        return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])

    def gamma_p_of(a, x):
        out = np.where((a > 0) & (x <= 0), 0.0, np.nan)
        todo = np.flatnonzero((a > 0) & (x > 0))
        a, x = a[todo], x[todo]
        value = np.ones(len(todo))
        surely = (x > a) & (x - a - a * np.log(x / a) > 45)
        for rows, f in ((np.flatnonzero(~surely & (a <= large)), series), (np.flatnonzero(~surely & (a > large)), cube_root_normal)):
            value[rows] = f(a[rows], x[rows])
        out[todo] = value
        return out

    def normal_quantile(p):
        q = p - 0.5
        r = 0.180625 - q * q
        tail = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        outer = tail - (2.515517 + tail * (0.802853 + tail * 0.010328)) / (1 + tail * (1.432788 + tail * (0.189269 + tail * 0.001308)))
        return np.where(np.abs(q) <= 0.425, q * np.polyval(top[::-1], r) / np.polyval(bottom[::-1], r), np.sign(q) * outer)  # only a start

    def gamma_ppf_of(p, a, rounds):
        out = np.where(p <= 0, 0.0, np.nan)
        todo = np.flatnonzero((p > 0) & (p < 1) & (a > 0))
        p, a = p[todo], a[todo]
        c = 1 / (9 * a)
        cube = np.maximum(1 - c + normal_quantile(p) * np.sqrt(c), 0.0) ** 3 * a
        small = np.exp((np.log(p) + log_gamma_of(a + 1.0)) / a)
        y = np.log(np.where((cube > 0.05 * a) & (a > 0.5), cube, np.maximum(small, 1e-300)))
        at = np.arange(len(p))
        for _ in range(rounds):
            x = np.exp(y[at])
            slope = a[at] * np.exp(head(a[at], x))
            step = np.clip((p[at] - gamma_p_of(a[at], x)) / np.maximum(slope, 1e-300), -2.0, 2.0)
            y[at] += step
            at = at[np.abs(step) > 1e-10]  # the next step would be about its square
            if not len(at):
                break
        out[todo] = np.exp(y)
        return out

    return gamma_p_of, gamma_ppf_of


def gamma_p_batch(a: Column, x: Column) -> Column:
    """``gamma_p`` of whole columns, in Arrow batches."""
    gamma_p_of, _ = _kernels()

    def run(a: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(gamma_p_of(a.to_numpy("float64"), x.to_numpy("float64")))

    return F.pandas_udf(run, "double")(a.cast("double"), x.cast("double"))


def gamma_ppf(p: Column, a: Column, scale: Column, rounds: int = 12) -> Column:
    """Gamma quantile by Newton steps in logarithms from Wilson and Hilferty's start, in Arrow batches."""
    _, gamma_ppf_of = _kernels()

    def run(p: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(gamma_ppf_of(p.to_numpy("float64"), a.to_numpy("float64"), rounds))

    return F.when(p <= 0, 0.0).otherwise(F.pandas_udf(run, "double")(p.cast("double"), a.cast("double")) * scale)


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: six steps of recurrence, then the asymptotic series."""
    shift = F.lit(0.0)
    for i in range(6):
        shift = shift + 1 / (x + float(i))
    y = x + 6.0
    w = 1 / (y * y)
    return F.log(y) - 1 / (2 * y) - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240))) - shift


def trigamma(x: Column) -> Column:
    shift = F.lit(0.0)
    for i in range(6):
        shift = shift + 1 / ((x + float(i)) * (x + float(i)))
    y = x + 6.0
    w = 1 / (y * y)
    return 1 / y + w / 2 + (1 / y) * w * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30))) + shift
