"""Tests and regressions: moments and lagged products in SQL, and small kernels for what needs a solve or a draw."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.metrics import average_rank
from loomspan.operators.returns import by_time


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz rule."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def jarque_bera(returns: DataFrame, key: str = "asset") -> DataFrame:
    n, s, k = F.count("r"), F.skewness("r"), F.kurtosis("r")
    out = returns.groupBy(key).agg((n / 6 * (s * s + k * k / 4)).alias("jb"))
    return out.withColumn("p_value", F.exp(-F.col("jb") / 2))


def autocorrelation(returns: DataFrame, lags: int = 10, key: str = "asset") -> DataFrame:
    """(key, lag, rho): biased autocorrelations from lag 1; each is one lagged product in a shared pass."""
    w, mean = by_time(key), F.avg("r").over(Window.partitionBy(key))
    out = returns.withColumn("_x", F.col("r") - mean)
    out = out.withColumns({f"_l{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    sums = out.groupBy(key).agg(F.count("r").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_v"), *[F.sum(f"_l{k}").alias(f"_l{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_l{k}") / F.col("_v")).alias("rho")) for k in range(1, lags + 1)])
    return sums.select(key, "n", F.explode(pairs).alias("p")).select(key, "n", "p.lag", "p.rho")


def ljung_box(returns: DataFrame, lags: int = 10, key: str = "asset") -> DataFrame:
    rho = autocorrelation(returns, lags, key)
    return rho.groupBy(key).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))).alias("q"))


def runs_test(returns: DataFrame, key: str = "asset") -> DataFrame:
    """z of the number of runs of one sign; zeros are left out."""
    out = returns.where(F.col("r") != 0).withColumn("_s", F.col("r") > 0)
    out = out.withColumn("_new", F.coalesce(F.col("_s") != F.lag("_s").over(by_time(key)), F.lit(True)))
    g = out.groupBy(key).agg(F.count_if("_new").alias("runs"), F.count_if("_s").cast("double").alias("_p"), F.count_if(~F.col("_s")).cast("double").alias("_q"))
    p, q = F.col("_p"), F.col("_q")
    n = p + q
    mean, var = 2 * p * q / n + 1, 2 * p * q * (2 * p * q - n) / (n * n * (n - 1))
    return g.select(key, "runs", F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)).alias("z"))


def paired_t(pairs: DataFrame, least: int = 10) -> DataFrame:
    """pairs: a, b, ra, rb. t of the mean difference, and the signed-rank statistic with averaged ties."""
    d = pairs.withColumn("_d", F.col("ra") - F.col("rb"))
    t = d.groupBy("a", "b").agg(F.count("_d").alias("n"), (F.avg("_d") / (F.stddev_samp("_d") / F.sqrt(F.count("_d")))).alias("t")).where(F.col("n") >= least)
    ranked = d.where(F.col("_d") != 0).withColumn("_a", F.abs("_d")).withColumn("_r", average_rank("_a", ["a", "b"]))
    w = ranked.groupBy("a", "b").agg(F.least(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))).alias("w"))
    return t.join(w, ["a", "b"], "left")


def diebold_mariano(pairs: DataFrame, h: int = 1) -> DataFrame:
    """pairs: dt, a, b, ra, rb. Loss is the squared value; the variance of the mean difference has h - 1 autocovariances."""
    w = Window.partitionBy("a", "b")
    d = pairs.withColumn("_d", F.col("ra") * F.col("ra") - F.col("rb") * F.col("rb"))
    d = d.withColumn("_x", F.col("_d") - F.avg("_d").over(w))
    d = d.withColumns({f"_c{k}": F.col("_x") * F.lag("_x", k).over(w.orderBy("dt")) for k in range(1, h)})
    n = F.count("_d")
    var = (F.sum(F.col("_x") * F.col("_x")) / n + sum((2 * F.sum(f"_c{k}") / n for k in range(1, h)), F.lit(0.0))) / n
    return d.groupBy("a", "b").agg((F.avg("_d") / F.sqrt(var)).alias("dm"), n.alias("n"))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return beta, float(e @ e), np.sqrt(np.maximum(0, s2 * np.diag(np.linalg.pinv(x.T @ x))))


def adf_statistic(x: np.ndarray, lags: int) -> float:
    """t of the level in a regression of changes on a constant, the level and lagged changes."""
    d = np.diff(x)
    n = len(d) - lags
    cols = [np.ones(n), x[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))]
    beta, _, se = _ols(np.stack(cols, 1), d[lags:])
    return float(beta[1] / se[1])


def adf(x: np.ndarray) -> tuple[float, int, bool]:
    """(statistic, lags by information criterion, stationary at 5 %). Critical values follow the published response surface for a constant."""
    n, best = len(x), (math.inf, 0)
    most = min(int(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)
    for lags in range(most + 1):
        m = len(d) - most
        cols = [np.ones(m), x[most:-1], *(d[most - k : len(d) - k] for k in range(1, lags + 1))]
        _, sse, _ = _ols(np.stack(cols, 1), d[most:])
        best = min(best, (m * math.log(max(sse, 1e-300) / m) + 2 * (lags + 2), lags))
    stat = adf_statistic(x, best[1])
    critical = -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3
    return stat, best[1], stat < critical


def kpss(x: np.ndarray) -> tuple[float, bool]:
    """Level statistic with a Bartlett variance whose lags follow from the data, and whether it stays below the 5 % value 0.463."""
    n = len(x)
    e = x - x.mean()
    near = [e[k:] @ e[:-k] / (n / 2) for k in range(1, int(n ** (2 / 9)) + 1)]
    slope = sum(k * c for k, c in enumerate(near, 1)) / (e @ e / n + sum(near))
    lags = int(1.1447 * (slope * slope) ** (1 / 3) * n ** (1 / 3))
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * var))
    return stat, stat < 0.463


def granger(x: np.ndarray, y: np.ndarray, most: int = 5) -> tuple[float, int, float]:
    """(F, lag, p) of the lag, 1 to `most`, at which past x tells most about y."""
    best = (0.0, 1, 1.1)
    for k in range(1, most + 1):
        n = len(y) - k
        if n <= 3 * k + 1:
            break
        own = [y[k - j : len(y) - j] for j in range(1, k + 1)]
        other = [x[k - j : len(x) - j] for j in range(1, k + 1)]
        one = np.ones(n)
        _, small, _ = _ols(np.stack([one, *own], 1), y[k:])
        _, full, _ = _ols(np.stack([one, *own, *other], 1), y[k:])
        df = n - 2 * k - 1
        f = (small - full) / k / (full / df)
        p = f_upper(f, k, df)
        if p < best[2]:
            best = (float(f), k, p)
    return best


def cointegration(x: np.ndarray, y: np.ndarray) -> tuple[float, bool]:
    """Unit-root statistic of the residual of y on x, against the 5 % value for two series."""
    z = np.stack([np.ones(len(x)), x], 1)
    beta, *_ = _ols(z, y)
    stat, _, _ = adf(y - z @ beta)
    return stat, stat < -3.33613 - 6.1101 / len(x) - 6.823 / len(x) ** 2


def stationarity_report(panel: DataFrame, value: str = "px", key: str = "asset") -> DataFrame:
    """Unit-root and level tests of each series; under 20 rows the results are null. A series is one group: it is one asset's history."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("dt")[value].dropna().to_numpy(float)
        row = {key: pdf[key].iloc[0], "n": len(x), "adf": None, "lags": None, "adf_stationary": None, "kpss": None, "kpss_stationary": None}
        if len(x) >= 20:
            a, lags, ok = adf(x)
            b, level = kpss(x)
            row |= {"adf": a, "lags": lags, "adf_stationary": bool(ok), "kpss": b, "kpss_stationary": bool(level)}
        return pd.DataFrame([row]).astype({"adf": float, "kpss": float, "lags": "Int64", "adf_stationary": "boolean", "kpss_stationary": "boolean"})

    kind = panel.schema[key].dataType.simpleString()
    return panel.select(key, "dt", value).groupBy(key).applyInPandas(run, f"{key} {kind}, n long, adf double, lags long, adf_stationary boolean, kpss double, kpss_stationary boolean")


def pair_tests(pairs: DataFrame) -> DataFrame:
    """pairs: dt, a, b, ra, rb. Granger causality from a to b, and cointegration of the two cumulated series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x, y = pdf["ra"].to_numpy(float), pdf["rb"].to_numpy(float)
        f, lag, p = granger(x, y)
        stat, ok = cointegration(np.cumsum(x), np.cumsum(y)) if len(x) >= 20 else (float("nan"), False)
        return pd.DataFrame([{"a": pdf["a"].iloc[0], "b": pdf["b"].iloc[0], "f": f, "lag": lag, "p_value": p, "coint": stat, "cointegrated": bool(ok)}])

    return pairs.groupBy("a", "b").applyInPandas(run, "a string, b string, f double, lag long, p_value double, coint double, cointegrated boolean")


def inflation(g: np.ndarray) -> np.ndarray:
    """Variance inflation without constant, from the Gram matrix."""
    return np.diag(g) * np.diag(np.linalg.pinv(g))


def drop_inflated(g: np.ndarray, names: list[str], threshold: float = 10.0) -> list[str]:
    """Names left when the worst is dropped until all are at or below the threshold, or two are left."""
    left = list(range(len(names)))
    while len(left) > 2:
        v = inflation(g[np.ix_(left, left)])
        if v.max() <= threshold:
            break
        left.pop(int(v.argmax()))
    return [names[i] for i in left]


def interval(draws: DataFrame, level: float = 0.95, key: str = "asset") -> DataFrame:
    a = (1 - level) / 2
    return draws.groupBy(key).agg(F.avg("value").alias("mean"), F.expr(f"percentile(value, {a}D)").alias("lo"), F.expr(f"percentile(value, {1 - a}D)").alias("hi"), F.count("value").alias("reps"))


def stars(p):
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def break_even(costs: DataFrame, benchmark: float | Column) -> DataFrame:
    """costs: bps, sharpe. The level at which sharpe first falls through the benchmark, linearly between two rows."""
    w = Window.orderBy("bps")
    out = costs.withColumns({"_b": F.lead("bps").over(w), "_s": F.lead("sharpe").over(w)})
    cross = out.where((F.col("sharpe") >= benchmark) & (F.col("_s") < benchmark)).orderBy("bps").limit(1)
    return cross.select((F.col("bps") + (F.col("sharpe") - benchmark) / (F.col("sharpe") - F.col("_s")) * (F.col("_b") - F.col("bps"))).alias("break_even_bps"))
