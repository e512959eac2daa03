"""Distribution functions as Column expressions: folds over short literal sequences, no Python in the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation with g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Terms of the error function's series, which are enough up to 6; steps of the beta function's fraction.
TERMS, STEPS = 150, 300


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x above 0.5."""
    t = x + 6.5
    total = sum((c / (x - 1 + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def normal_two_sided(z: Column) -> Column:
    """The chance of a standard normal value farther from 0 than z."""
    x = F.abs(z) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["total"]) * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    return F.when(x > 6, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - erf))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out"))

    def half(s: Column, up: Column) -> Column:
        c, d = away(1 + up / s["c"]), 1 / away(1 + up * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * c * d).alias("out"))

    # Odd and even steps of the fraction take turns: k = 2 m - 1 and 2 m.
    def step(s: Column, k: Column) -> Column:
        m = F.ceil(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(k % 2 == 1, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * STEPS)), start, step, lambda s: s["out"])


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    low, high = front * _beta_fraction(a, b, x) / a, 1 - front * _beta_fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance of a value farther from 0 than t, with df degrees of freedom."""
    df = df.cast("double")
    return beta_cdf(df / 2, F.lit(0.5), df / (df + t * t))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """The chance of a ratio above f."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    return F.when(f > 0, beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))).otherwise(1.0)
