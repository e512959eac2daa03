"""Rolling and expanding features. Frames count rows of a key by date; a value needs max(window / 2, 1) rows unless said."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.returns import by_time, growth


def frame(n: int, key="asset"):
    return by_time(key).rowsBetween(1 - n, 0)


def enough(x: str, n: int, value: Column, least: int | None = None, key="asset") -> Column:
    return F.when(F.count(x).over(frame(n, key)) >= (max(n // 2, 1) if least is None else least), value)


def rolling_volatility(returns: DataFrame, windows=DEFAULT.windows, days: int = DEFAULT.days) -> DataFrame:
    return returns.withColumns({f"vol_{n}d": enough("r", n, F.stddev_samp("r").over(frame(n)) * math.sqrt(days)) for n in windows})


def realized_variance(returns: DataFrame, n: int = 21, days: int = DEFAULT.days) -> DataFrame:
    return returns.withColumn("realized_var", enough("r", n, F.sum(F.col("r") * F.col("r")).over(frame(n)) * (days / n)))


def garman_klass(bars: DataFrame, n: int = 21, days: int = DEFAULT.days) -> DataFrame:
    """bars: dt, asset, open, high, low, close."""
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    out = bars.withColumn("_gk", 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)
    mean = F.avg("_gk").over(frame(n))
    return out.withColumn("gk_vol", enough("_gk", n, F.when(mean >= 0, F.sqrt(mean * days)))).drop("_gk")


def bollinger(prices: DataFrame, n: int = DEFAULT.bollinger[0], k: float = DEFAULT.bollinger[1]) -> DataFrame:
    mid = enough("px", n, F.avg("px").over(frame(n)), n)
    std = enough("px", n, F.stddev_samp("px").over(frame(n)), n)
    out = prices.withColumns({"mid": mid, "upper": mid + k * std, "lower": mid - k * std})
    width = F.col("upper") - F.col("lower")
    return out.withColumns({"pct_b": F.when(width != 0, (F.col("px") - F.col("lower")) / width), "width": width / F.col("mid")})


def crossover(prices: DataFrame, short: int = DEFAULT.crossover[0], long: int = DEFAULT.crossover[1]) -> DataFrame:
    a, b = enough("px", short, F.avg("px").over(frame(short))), enough("px", long, F.avg("px").over(frame(long)))
    out = prices.withColumns({"_a": a, "_b": b})
    cols = {"ma_ratio": F.col("_a") / F.col("_b"), "golden": F.when(F.col("_a") > F.col("_b"), 1.0).otherwise(0.0), "ma_spread": (F.col("_a") - F.col("_b")) / F.col("px")}
    return out.withColumns(cols).drop("_a", "_b")


def rsi_simple(prices: DataFrame, n: int = DEFAULT.rsi) -> DataFrame:
    d = F.col("px") - F.lag("px").over(by_time())
    out = prices.withColumns({"_u": F.when(d > 0, d).when(d.isNotNull(), 0.0), "_d": F.when(d < 0, -d).when(d.isNotNull(), 0.0)})
    up, down = F.avg("_u").over(frame(n)), F.avg("_d").over(frame(n))
    full = F.count("_d").over(frame(n)) >= n
    return out.withColumn("rsi", F.when(full & (down > 0), 100 - 100 / (1 + up / down))).drop("_u", "_d")


def _per_asset(df: DataFrame, fn, added: str, key: str = "asset") -> DataFrame:
    """Recursive filters: one Arrow group for each key, in date order. A key's series is its history, one row a date."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    names = [c.split()[0] for c in added.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        got = fn(pdf)
        return pdf.assign(**{n: got[n] for n in names})

    return df.groupBy(key).applyInPandas(run, schema)


def rsi_wilder(prices: DataFrame, n: int = DEFAULT.rsi) -> DataFrame:
    """Recursive means with weight 1 / n; a mean loss of 0 gives null."""

    def run(pdf):
        d = pdf["px"].diff()
        up, down = (x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
        return {"rsi": (100 - 100 / (1 + up / down.where(down > 0))).astype("float64")}

    return _per_asset(prices, run, "rsi double")


def macd(prices: DataFrame, fast: int = DEFAULT.macd[0], slow: int = DEFAULT.macd[1], signal: int = DEFAULT.macd[2], least: bool = True) -> DataFrame:
    def run(pdf):
        ema = lambda s, span: s.ewm(span=span, adjust=False, min_periods=span if least else 0).mean()
        line = ema(pdf["px"], fast) - ema(pdf["px"], slow)
        sig = ema(line, signal)
        return {"macd": line, "signal": sig, "hist": line - sig}

    return _per_asset(prices, run, "macd double, signal double, hist double")


def ewma_volatility(returns: DataFrame, halflife: int = DEFAULT.ewma_halflife, days: int = DEFAULT.days) -> DataFrame:
    """Weighted deviation with all weights from the first row on, corrected for bias."""
    run = lambda pdf: {"ewma_vol": (pdf["r"].ewm(halflife=halflife, min_periods=halflife).var() * days) ** 0.5}
    return _per_asset(returns, run, "ewma_vol double")


def rolling_beta(returns: DataFrame, market: DataFrame, n: int = 63) -> DataFrame:
    """market: (dt, b)."""
    f = frame(n)
    out = returns.join(market, "dt")
    return out.withColumn("beta", enough("r", n, F.try_divide(F.covar_samp("r", "b").over(f), F.var_samp("b").over(f))))


def pairs(returns: DataFrame) -> DataFrame:
    """(dt, a, b, ra, rb): the assets of a date, each pair once. A panel's width is fixed, so this is width / 2 rows a row."""
    x, y = returns.select("dt", F.col("asset").alias("a"), F.col("r").alias("ra")), returns.select("dt", F.col("asset").alias("b"), F.col("r").alias("rb"))
    return x.join(y, "dt").where(F.col("a") < F.col("b"))


def rolling_mean_correlation(returns: DataFrame, n: int = 63) -> DataFrame:
    f = frame(n, ["a", "b"])
    full = F.count("ra").over(f) >= n
    return pairs(returns).withColumn("_c", F.when(full, F.corr("ra", "rb").over(f))).groupBy("dt").agg(F.avg("_c").alias("mean_corr")).where(F.col("mean_corr").isNotNull())


def rolling_correlation_with(returns: DataFrame, base: str, n: int = 63) -> DataFrame:
    b = returns.where(F.col("asset") == base).select("dt", F.col("r").alias("b"))
    out = returns.where(F.col("asset") != base).join(b, "dt")
    return out.withColumn("corr", F.when(F.count("r").over(frame(n)) >= n, F.corr("r", "b").over(frame(n)))).where(F.col("corr").isNotNull())


def dispersion(returns: DataFrame, n: int = 21) -> DataFrame:
    """Deviation across the assets of each date, and its rolling mean. The last step is over one row a date."""
    d = returns.groupBy("dt").agg(F.stddev_samp("r").alias("dispersion"))
    w = Window.orderBy("dt").rowsBetween(1 - n, 0)
    return d.withColumn("mean_dispersion", F.when(F.count("dispersion").over(w) >= max(n // 2, 1), F.avg("dispersion").over(w)))


def percentile_rank(df: DataFrame, value: str, key: str) -> DataFrame:
    """Rank with ties averaged, over the count."""
    w, n = Window.partitionBy(key).orderBy(value), F.count(value).over(Window.partitionBy(key))
    ties = F.count(value).over(Window.partitionBy(key, value))
    return df.withColumn("pct_rank", F.when(F.col(value).isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / n))


def expanding_quantiles(macro: DataFrame, lo: float = 0.25, hi: float = 0.75, least: int = 63) -> DataFrame:
    w = by_time("series").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("value").over(w)
    return macro.withColumns({c: F.when(n >= least, F.expr(f"percentile(value, {q})").over(w)) for c, q in (("q_lo", lo), ("q_hi", hi))})


def rolling_median(macro: DataFrame, n: int = 252, least: int = 63) -> DataFrame:
    f = frame(n, "series")
    return macro.withColumn("median", F.when(F.count("value").over(f) >= least, F.expr("percentile(value, 0.5)").over(f)))


def drawdowns(returns: DataFrame, key: str = "asset") -> DataFrame:
    """Adds growth and drawdown; the running top starts at the first row's growth."""
    w = by_time(key)
    out = returns.withColumn("growth", growth(F.col("r"), w))
    return out.withColumn("drawdown", F.col("growth") / F.max("growth").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def drawdown_episodes(returns: DataFrame, key: str = "asset") -> DataFrame:
    """A row for each stretch below the running top: start, trough, recovery date (null if none), depth, and rows of each leg."""
    w = by_time(key)
    # Growth in logs: a top is a top to the last digit however products are rounded.
    out = returns.withColumn("_g", F.round(F.sum(F.ln(1 + F.col("r"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), 12))
    out = out.withColumns({"_top": F.max("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(w), "_next": F.lead("dt").over(w)})
    out = out.withColumns({"_down": F.col("_g") < F.col("_top"), "depth": F.exp(F.col("_g") - F.col("_top")) - 1})
    out = out.withColumn("_top_no", F.sum(F.when(~F.col("_down"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = out.where("_down").groupBy(key, "_top_no").agg(F.min("dt").alias("start"), F.min_by("dt", F.struct("depth", "dt")).alias("trough"), F.max_by("_next", "_i").alias("recovered"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("duration"), (F.max("_i") - F.min_by("_i", F.struct("depth", "dt"))).alias("_left"))
    return run.select(key, "start", "trough", "recovered", "depth", "duration", F.when(F.col("recovered").isNotNull(), F.col("_left") + 1).alias("recovery"))


def spans(df: DataFrame, flag: str, key: str, order: str = "dt") -> DataFrame:
    """First and last row number (from 0), and dates, of each unbroken run of `flag`."""
    w = by_time(key, order)
    out = df.withColumns({"_i": F.row_number().over(w) - 1}).where(flag)
    out = out.withColumn("_run", F.col("_i") - F.row_number().over(w))
    return out.groupBy(key, "_run").agg(F.min("_i").cast("long").alias("first"), F.max("_i").cast("long").alias("last"), F.min(order).alias("from_dt"), F.max(order).alias("to_dt")).drop("_run")


def rolling_metrics(returns: DataFrame, n: int = DEFAULT.days, key: str = "asset", days: int = DEFAULT.days) -> DataFrame:
    """Annual return, volatility and Sharpe ratio over n rows, and the fall below the top of the last n rows."""
    f = frame(n, key)
    out = returns.withColumns({"_g": growth(F.col("r"), by_time(key)), "_n": F.count("r").over(f), "roll_ret": F.avg("r").over(f) * days, "roll_vol": F.stddev_samp("r").over(f) * math.sqrt(days)})
    out = out.withColumns({"roll_sharpe": F.when(F.col("roll_vol") > 1e-12, F.col("roll_ret") / F.col("roll_vol")), "roll_dd": F.col("_g") / F.max("_g").over(f) - 1})
    return out.where((F.col("_n") >= n) & F.col("roll_sharpe").isNotNull()).drop("_g", "_n")


def worst_drawdown_in_window(returns: DataFrame, n: int = 63, key: str = "asset") -> DataFrame:
    """The deepest fall within the last n rows, tops counted from the window's start. Windows hold n values."""
    f = frame(n, key)
    out = returns.withColumns({"_a": F.collect_list("r").over(f)}).where(F.size("_a") >= n)
    start = F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("top"), F.lit(0.0).alias("worst"))

    def step(s, r):
        g = s["g"] * (1 + r)
        top = F.greatest(s["top"], g)
        return F.struct(g.alias("g"), top.alias("top"), F.least(s["worst"], g / top - 1).alias("worst"))

    return out.withColumn("worst_dd", F.aggregate("_a", start, step, lambda s: s["worst"])).drop("_a")


def signal_decay(signals: DataFrame, value: str = "value", halflife: int = 5, key: str = "series") -> DataFrame:
    """Missing values become the last known one, halved every `halflife` rows."""
    w = by_time(key).rowsBetween(Window.unboundedPreceding, 0)
    out = signals.withColumn("_i", F.row_number().over(by_time(key)))
    at = F.last(F.when(F.col(value).isNotNull(), F.col("_i")), ignorenulls=True).over(w)
    return out.withColumn("decayed", F.last(value, ignorenulls=True).over(w) * F.exp(-math.log(2) / halflife * (F.col("_i") - at))).drop("_i")


def prediction_turnover(predictions: DataFrame, k: int = 5, value: str = "p") -> DataFrame:
    """Mean absolute change over k rows across the assets of a date."""
    out = predictions.withColumn("_d", F.abs(F.col(value) - F.lag(value, k).over(by_time())))
    return out.groupBy("dt").agg(F.avg("_d").alias("turnover"), F.count("_d").alias("n")).where(F.col("n") >= 3)


def recent_mean(df: DataFrame, value: str, n: int = 10, key: str = "asset") -> DataFrame:
    return df.withColumn("recent", F.coalesce(F.avg(value).over(frame(n, key)), F.lit(0.0)))


def window_signal(prices: DataFrame, n: int = 21, sign: int = 1, confidence: float = 1.0) -> DataFrame:
    """Change from n rows to one row before; sign -1 bets against it. The row itself isn't used."""
    w = by_time()
    return prices.withColumn("signal", F.coalesce(F.lit(sign * confidence) * (F.lag("px", 1).over(w) / F.lag("px", n).over(w) - 1), F.lit(0.0)))


def inverse_vol_signal(returns: DataFrame, n: int = 63) -> DataFrame:
    """1 / deviation of the n - 1 rows before, normalised over the date's assets, less their even share."""
    w = by_time().rowsBetween(1 - n, -1)
    std = F.when(F.count("r").over(w) >= n - 1, F.stddev_samp("r").over(w))
    out = returns.withColumn("_iv", 1 / F.when(std > 0, std)).where(F.col("_iv").isNotNull())
    total = out.groupBy("dt").agg(F.sum("_iv").alias("_t"), F.count("_iv").alias("_n"))
    return out.join(total, "dt").withColumn("signal", F.col("_iv") / F.col("_t") - 1 / F.col("_n")).drop("_iv", "_t", "_n")
