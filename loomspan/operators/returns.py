"""Returns and row-wise price transforms over a long panel (dt, asset, px)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT


def by_time(key: str | list[str] = "asset", order: str = "dt"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def change(x: Column, k: int, w) -> Column:
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def simple_returns(prices: DataFrame, horizons=DEFAULT.horizons) -> DataFrame:
    """Adds ret_{h}d: the relative change over h rows of the asset."""
    return prices.withColumns({f"ret_{h}d": change(F.col("px"), h, by_time()) for h in horizons})


def momentum(prices: DataFrame, windows=DEFAULT.windows) -> DataFrame:
    return prices.withColumns({f"mom_{h}d": change(F.col("px"), h, by_time()) for h in windows})


def log_returns(prices: DataFrame) -> DataFrame:
    return prices.withColumn("log_ret", F.ln(F.col("px") / F.lag("px").over(by_time())))


def total_returns(prices: DataFrame) -> DataFrame:
    """Simple returns whose first row is 0."""
    first = F.row_number().over(by_time()) == 1
    return prices.withColumn("ret", F.when(first, 0.0).otherwise(change(F.col("px"), 1, by_time())))


def forward_returns(prices: DataFrame, horizon: int = 21) -> DataFrame:
    return prices.withColumn("fwd", F.lead("px", horizon).over(by_time()) / F.col("px") - 1)


def base_100(prices: DataFrame) -> DataFrame:
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return prices.withColumn("base100", F.col("px") / F.first("px", ignorenulls=True).over(w) * 100)


def relative_strength(prices: DataFrame) -> DataFrame:
    """Growth since the asset's first row, over the mean growth of all assets on the date."""
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grown = prices.withColumn("_g", F.col("px") / F.first("px", ignorenulls=True).over(w))
    mean = grown.groupBy("dt").agg(F.avg("_g").alias("_m"))
    return grown.join(mean, "dt").withColumn("rel_strength", F.col("_g") / F.col("_m")).drop("_g", "_m")


def no_infinity(x: Column) -> Column:
    """Null in place of NaN and the infinities: null is the only missing value."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def growth(r: Column, w) -> Column:
    """Running product of 1 + r."""
    return F.exp(F.sum(F.ln(1 + r)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cumulative_growth(returns: DataFrame, key: str = "asset") -> DataFrame:
    return returns.withColumn("growth", growth(F.col("r"), by_time(key)))


def buy_and_hold_weights(prices: DataFrame) -> DataFrame:
    """Drifted weights of an equal start: each asset's growth over the sum of all growths of the date."""
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grown = prices.withColumn("_g", F.col("px") / F.first("px").over(w))
    total = grown.groupBy("dt").agg(F.sum("_g").alias("_t"))
    return grown.join(total, "dt").withColumn("weight", F.col("_g") / F.col("_t")).drop("_g", "_t")


def macro_changes(macro: DataFrame, window: int = 63, least: int = 31) -> DataFrame:
    """Difference, relative change and rolling z-score of each series."""
    w = by_time("series")
    frame = w.rowsBetween(1 - window, 0)
    v, n = F.col("value"), F.count("value").over(frame)
    std = F.stddev_samp("value").over(frame)
    z = F.when((n >= least) & (std > 0), (v - F.avg("value").over(frame)) / std)
    return macro.withColumns({"diff": v - F.lag(v).over(w), "pct": no_infinity(change(v, 1, w)), "zscore": z})


def macro_surprise(macro: DataFrame, window: int = 63, limit: float = 5.0) -> DataFrame:
    z = F.col("zscore")
    clipped = F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return macro_changes(macro, window).select("dt", "series", "value", clipped.alias("surprise"))


def lagged(macro: DataFrame, lags=DEFAULT.lags) -> DataFrame:
    return macro.withColumns({f"lag_{k}": F.lag("value", k).over(by_time("series")) for k in lags})


def winsorize(returns: DataFrame, q: float = 0.01, key: str = "asset") -> DataFrame:
    """r clipped to its asset's q and 1 - q quantiles (linear interpolation)."""
    edges = returns.groupBy(key).agg(F.expr(f"percentile(r, {q})").alias("_lo"), F.expr(f"percentile(r, {1 - q})").alias("_hi"))
    return returns.join(edges, key).withColumn("r", F.greatest("_lo", F.least("_hi", "r"))).drop("_lo", "_hi")


def regime_flags(macro: DataFrame, high: float, low: float, series: str = "series") -> DataFrame:
    """1.0 where the value is above `high`, below `low`, or rose over 21 rows; 0.0 else, for missing values too."""
    w = by_time(series)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return macro.withColumns({"is_high": flag(F.col("value") > high), "is_low": flag(F.col("value") < low), "is_rising": flag(F.col("value") > F.lag("value", 21).over(w))})
