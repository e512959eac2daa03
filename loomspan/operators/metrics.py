"""Return, risk and forecast metrics, each one grouped aggregation over a long frame.

Three families of risk metrics differ by definition and stay apart: `geometric` (compounded annual return, root mean square of
losses), `arithmetic` (mean times days, deviation of losses) and `periodic` (growth rate, population deviation).
A group's undefined ratio is 0 where a deviation is below 1e-12.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.windows import drawdowns


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-12, a / b).otherwise(0.0)


def total_growth(r: Column | None = None) -> Column:
    r = F.col("r") if r is None else r
    return F.exp(F.sum(F.ln(1 + r)))


def annual_geometric(r: Column | None = None, days: int = DEFAULT.days) -> Column:
    r = F.col("r") if r is None else r
    return F.pow(total_growth(r), F.lit(float(days)) / F.count(r)) - 1


def annual_volatility(r: Column | None = None, days: int = DEFAULT.days) -> Column:
    r = F.col("r") if r is None else r
    return F.coalesce(F.stddev_samp(r), F.lit(0.0)) * math.sqrt(days)


def sharpe(r: Column | None = None, rf: float = 0.0, days: int = DEFAULT.days) -> Column:
    r = F.col("r") if r is None else r
    return ratio(F.avg(r) - rf / days, F.stddev_samp(r)) * math.sqrt(days)


def sortino_rms(r: Column | None = None, days: int = DEFAULT.days) -> Column:
    r = F.col("r") if r is None else r
    return ratio(F.avg(r), F.sqrt(F.avg(F.when(r < 0, r * r)))) * math.sqrt(days)


def omega(r: Column | None = None, t: float = 0.0) -> Column:
    r = F.col("r") if r is None else r
    return F.try_divide(F.sum(F.greatest(r - t, F.lit(0.0))), F.sum(F.greatest(t - r, F.lit(0.0))))


def quantile(r: str, q: float) -> Column:
    return F.expr(f"percentile({r}, {q})")


def cornish_fisher(r: Column | None = None, confidence: float = 0.95) -> Column:
    r = F.col("r") if r is None else r
    z = NormalDist().inv_cdf(1 - confidence)
    s, k = F.skewness(r), F.kurtosis(r)
    adjusted = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    return F.avg(r) + F.when(F.count(r) >= 4, adjusted).otherwise(z) * F.stddev_samp(r)


def parametric_var(r: Column | None = None, confidence: float = 0.95) -> Column:
    r = F.col("r") if r is None else r
    return F.avg(r) + NormalDist().inv_cdf(1 - confidence) * F.stddev_samp(r)


def with_var(returns: DataFrame, key: str = "asset", confidence: float = 0.95) -> DataFrame:
    """Adds var: the key's 1 - confidence quantile. One row a key is joined back."""
    return returns.join(returns.groupBy(key).agg(quantile("r", round(1 - confidence, 10)).alias("var")), key)


def geometric(returns: DataFrame, key: str = "asset") -> DataFrame:
    """Family of compounded returns."""
    falls = drawdowns(returns, key)
    tail = with_var(falls, key)
    out = tail.groupBy(key).agg(
        annual_geometric().alias("annual_return"),
        annual_volatility().alias("annual_volatility"),
        sharpe().alias("sharpe"),
        sortino_rms().alias("sortino"),
        omega().alias("omega"),
        F.min("drawdown").alias("max_drawdown"),
        F.first("var").alias("var_95"),
        F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar_95"),
        parametric_var().alias("parametric_var"),
        cornish_fisher().alias("cornish_fisher_var"),
        ratio(F.abs(quantile("r", 0.95)), F.abs(quantile("r", 0.05))).alias("tail_ratio"),
    )
    return out.withColumn("calmar", ratio(F.col("annual_return"), F.abs("max_drawdown")))


def arithmetic(returns: DataFrame, key: str = "asset", days: int = DEFAULT.days) -> DataFrame:
    """Family of mean returns; skew and kurtosis as moments of the sample."""
    tail = with_var(drawdowns(returns, key), key)
    out = tail.groupBy(key).agg(
        (F.avg("r") * days).alias("annual_return"),
        annual_volatility().alias("annual_volatility"),
        sharpe().alias("sharpe"),
        (ratio(F.avg("r") * days, F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * math.sqrt(days))).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        (total_growth() - 1).alias("total_return"),
        F.first("var").alias("var_95"),
        F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar_95"),
        F.skewness("r").alias("skew"),
        F.kurtosis("r").alias("kurtosis"),
        (F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)) * 100).alias("winning_pct"),
    )
    return out.withColumn("calmar", ratio(F.col("annual_return"), F.abs("max_drawdown")))


def periodic(returns: DataFrame, key: str = "asset", periods: int = 12) -> DataFrame:
    """Family of the simulator: growth rate, population deviation."""
    out = drawdowns(returns, key).groupBy(key).agg(
        (F.pow(total_growth(), F.lit(float(periods)) / F.count("r")) - 1).alias("cagr"),
        (F.stddev_pop("r") * math.sqrt(periods)).alias("volatility"),
        (ratio(F.avg("r"), F.stddev_pop("r")) * math.sqrt(periods)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
    )
    return out


def evaluate_oos(returns: DataFrame, key: str = "asset") -> DataFrame:
    return arithmetic(returns, key).select(key, "sharpe", "sortino", "annual_return", "annual_volatility", "max_drawdown", "total_return")


def wins_and_losses(returns: DataFrame, key: str = "asset") -> DataFrame:
    win, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, F.col("r")))
    return returns.groupBy(key).agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), F.abs(win / loss).alias("win_loss_ratio"))


def relative(returns: DataFrame, benchmark: DataFrame, key: str = "asset", days: int = DEFAULT.days) -> DataFrame:
    """Against (dt, b): tracking error, information ratio, beta, alphas, captures, active return."""
    b, d = F.col("b"), F.col("r") - F.col("b")
    both = returns.join(benchmark, "dt").where(F.col("r").isNotNull() & b.isNotNull())
    out = both.groupBy(key).agg(
        (F.stddev_samp(d) * math.sqrt(days)).alias("tracking_error"),
        ratio(F.avg(d) * days, F.stddev_samp(d) * math.sqrt(days)).alias("information_ratio"),
        F.try_divide(F.covar_samp("r", "b"), F.var_samp("b")).alias("beta"),
        F.avg("r").alias("_r"),
        F.avg("b").alias("_b"),
        annual_geometric().alias("_gr"),
        annual_geometric(b).alias("_gb"),
        (F.avg(F.when(b > 0, F.col("r"))) / F.avg(F.when(b > 0, b))).alias("up_capture"),
        (F.avg(F.when(b < 0, F.col("r"))) / F.avg(F.when(b < 0, b))).alias("down_capture"),
        (F.avg(d) * days).alias("active_return"),
    )
    cols = {
        "alpha": (F.col("_r") - F.col("beta") * F.col("_b")) * days,
        "jensen_alpha": F.col("_gr") - F.col("beta") * F.col("_gb"),
        "treynor": ratio(F.col("_gr"), F.col("beta")),
        "capture_ratio": F.col("up_capture") / F.col("down_capture"),
    }
    return out.withColumns(cols).drop("_r", "_b", "_gr", "_gb")


def drawdown_duration(returns: DataFrame, key: str = "asset") -> DataFrame:
    """Rows of the longest stretch below the running top."""
    from loomspan.operators.windows import drawdown_episodes

    return drawdown_episodes(returns, key).groupBy(key).agg(F.max("duration").alias("max_duration"))


def stability(returns: DataFrame, key: str = "asset") -> DataFrame:
    """R squared of cumulative log returns on time."""
    w = Window.partitionBy(key).orderBy("dt")
    out = returns.withColumns({"_y": F.sum(F.ln(1 + F.greatest(F.col("r"), F.lit(-0.9999)))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.row_number().over(w).cast("double")})
    return out.groupBy(key).agg(F.pow(F.corr("_t", "_y"), 2).alias("stability"))


def tail_risk(returns: DataFrame, key: str = "asset", levels=(0.90, 0.95, 0.975, 0.99)) -> DataFrame:
    """VaR and CVaR at several levels, a row each."""
    qs = ", ".join(f"{1 - c:.4f}D" for c in levels)
    edges = returns.groupBy(key).agg(F.expr(f"percentile(r, array({qs}))").alias("_q")).select(key, F.posexplode("_q").alias("_i", "var"))
    edges = edges.withColumn("level", F.element_at(F.array(*map(F.lit, levels)), F.col("_i") + 1)).drop("_i")
    return returns.join(edges, key).groupBy(key, "level").agg(F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"))


def average_rank(value: str, key: list[str]) -> Column:
    """Rank within key; ties get their mean rank."""
    return F.rank().over(Window.partitionBy(*key).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, value)) - 1) / 2


def prediction_metrics(panel: DataFrame, key: str = "asset") -> DataFrame:
    """panel: key, y, p. Errors, R squared, direction, and rank and linear correlations."""
    ranked = panel.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumns({"_ry": average_rank("y", [key]), "_rp": average_rank("p", [key])})
    y, e = F.col("y"), F.col("y") - F.col("p")
    return ranked.groupBy(key).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("mape"),
        F.avg((F.signum("y") == F.signum("p")).cast("double")).alias("directional_accuracy"),
        F.corr("_ry", "_rp").alias("rank_ic"),
        F.corr("y", "p").alias("pearson_ic"),
    )


def top_k_hits(panel: DataFrame, k: int = 3) -> DataFrame:
    """For each date, the share of the k largest p that are among the k largest y; then the mean over dates."""
    top = lambda c: F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(c), "asset")) <= k
    each = panel.withColumns({"_y": top("y"), "_p": top("p")}).groupBy("dt").agg((F.sum((F.col("_y") & F.col("_p")).cast("int")) / k).alias("h"))
    return each.agg(F.avg("h").alias("hit_rate"), F.count(F.lit(1)).alias("dates"))


def decile_spread(panel: DataFrame, key: str = "asset") -> DataFrame:
    """Mean y of the tenth with the largest p less that of the smallest (halves below ten rows)."""
    w = Window.partitionBy(key)
    ranked = panel.withColumns({"_i": F.row_number().over(w.orderBy("p", "dt")), "_n": F.count(F.lit(1)).over(w)})
    k = F.when(F.col("_n") < 10, F.floor(F.col("_n") / 2)).otherwise(F.floor(F.col("_n") / 10))
    return ranked.groupBy(key).agg((F.avg(F.when(F.col("_i") > F.col("_n") - k, F.col("y"))) - F.avg(F.when(F.col("_i") <= k, F.col("y")))).alias("spread"))


def calibration(panel: DataFrame, bins: int = 10) -> DataFrame:
    """Quantile bins of p, equal edges merged: count, mean p, mean and deviation of y, bias."""
    qs = ", ".join(f"{i / bins}D" for i in range(1, bins))
    edges = panel.agg(F.array_distinct(F.expr(f"percentile(p, array({qs}))")).alias("_e"))
    binned = panel.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: F.col("p") > e)))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y"), F.avg(F.col("p") - F.col("y")).alias("bias"))


def prediction_summary(panel: DataFrame, key: str = "asset", least: int = 5) -> DataFrame:
    e = F.col("p") - F.col("y")
    out = panel.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("std_y"), F.corr("p", "y").alias("corr"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    return out.where(F.col("n") >= least)


def summarize(df: DataFrame, value: str, key: str) -> DataFrame:
    """Counts, quartiles and moments; skew and kurtosis corrected for bias; shares of nulls and zeros."""
    n, x = F.count(value), F.col(value)
    g1, g2 = F.skewness(value), F.kurtosis(value)
    q = {f"q{int(p * 100)}": F.expr(f"percentile({value}, {p}D)") for p in (0.25, 0.5, 0.75)}
    return df.groupBy(key).agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        *[c.alias(k) for k, c in q.items()],
        F.max(value).alias("max"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
        (F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)) * 100).alias("null_pct"),
        (F.avg(F.when(x == 0, 1.0).otherwise(0.0)) * 100).alias("zero_pct"),
    )


def coverage(macro: DataFrame, start: str, end: str, key: str = "series") -> DataFrame:
    """First and last date, share of nulls, and whether the span is covered within 30 days with under a fifth null."""
    out = macro.groupBy(key).agg(F.min(F.when(F.col("value").isNotNull(), F.col("dt"))).alias("first_dt"), F.max(F.when(F.col("value").isNotNull(), F.col("dt"))).alias("last_dt"), (F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)) * 100).alias("null_pct"))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return out.withColumn("passed", (F.col("first_dt") <= F.date_add(s, 30)) & (F.col("last_dt") >= F.date_add(e, -30)) & (F.col("null_pct") < 20))


def price_quality(prices: DataFrame) -> DataFrame:
    """Extreme and zero returns, non-positive prices, and date span of each asset."""
    w = Window.partitionBy("asset").orderBy("dt")
    out = prices.withColumn("_r", F.col("px") / F.lag("px").over(w) - 1)
    return out.groupBy("asset").agg(F.count("px").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.count_if(F.abs("_r") > 0.1).alias("extreme"), F.max(F.abs("_r")).alias("max_abs_ret"), F.count_if(F.col("_r") == 0).alias("zero_days"), F.count_if(F.col("px") <= 0).alias("nonpositive"))


def longest_gap(panel: DataFrame, value: str = "value", key: str = "series") -> DataFrame:
    """Rows of the longest run of nulls."""
    w = Window.partitionBy(key).orderBy("dt")
    out = panel.withColumns({"_i": F.row_number().over(w)}).where(F.col(value).isNull()).withColumn("_g", F.col("_i") - F.row_number().over(w))
    runs = out.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("gap"))
    return panel.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("gap", F.lit(0)).alias("gap"))


def validate(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """One row: rows, nulls, infinities, and keys that repeat."""
    doubled = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.sum("_n").alias("rows"))
    one = df.agg(F.count_if(F.col(value).isNull()).alias("nulls"), F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))).alias("infinite"))
    return doubled.crossJoin(one)


def validate_returns(returns: DataFrame, key: str = "asset") -> DataFrame:
    return returns.groupBy(key).agg((F.count_if(F.col("r") != 0) == 0).alias("all_zero"), (F.min("r") == F.max("r")).alias("constant"), (F.count_if((F.col("r") > 1) | (F.col("r") < -0.5)) > 0).alias("extreme"), (F.avg(F.col("r").isNull().cast("double")) > 0.1).alias("sparse"))


def concentration(weights: DataFrame, key: str = "dt", w: str = "weight") -> DataFrame:
    """Herfindahl index, effective number, largest weight, and Gini index over weights from the largest down."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = weights.withColumns({"_i": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(w), "asset")), "_n": n})
    i, x, m = F.col("_i"), F.col(w), F.col("_n")
    return ranked.groupBy(key).agg(F.sum(x * x).alias("hhi"), (1 / F.sum(x * x)).alias("effective_n"), F.max(w).alias("max_weight"), (F.sum((2 * i - m - 1) * x) / (F.first(m) * F.sum(x))).alias("gini"))


def prices_of_costs(trades: DataFrame, bps: float = DEFAULT.cost_bps, impact: float = 0.1, key: str = "dt") -> DataFrame:
    """trades: key, w_old, w_new, value, vol, adv. Fixed, spread, square-root impact and their sum, as shares of value."""
    d = F.abs(F.col("w_new") - F.col("w_old"))
    dollars = d * F.col("value")
    hit = F.when(F.col("adv") > 0, impact * F.col("vol") * F.sqrt(dollars / F.col("adv")) * dollars).otherwise(0.0)
    out = trades.groupBy(key).agg((F.sum(d) * bps / 1e4).alias("fixed"), (F.sum(dollars) * bps / 1e4).alias("proportional"), (F.sum(hit) / F.first("value")).alias("impact"), F.sum(d).alias("turnover"), (0.5 * F.sum(d)).alias("one_way_turnover"))
    return out.withColumn("composite", F.col("fixed") + F.col("impact"))
