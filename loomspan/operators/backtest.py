"""Backtests. Between rebalance dates weights drift in closed form, so returns are window SQL; only a turnover limit against
drifted weights has to go date by date, in one group a strategy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.allocation import Constraints, covariance, mean_variance
from loomspan.operators.metrics import arithmetic
from loomspan.operators.panels import rebalance_dates
from loomspan.operators.returns import growth


def carried(prices: DataFrame) -> DataFrame:
    """(asset, dt, px) on each date of the panel from the asset's first on: a date without its price has the last one before it.

    The calendar is one row, an array as long as there are dates, broadcast to one row an asset."""
    calendar = prices.agg(F.array_sort(F.collect_set("dt")).alias("_days"))
    spans = prices.groupBy("asset").agg(F.min("dt").alias("_from"))
    days = spans.crossJoin(F.broadcast(calendar)).select("asset", F.explode(F.filter("_days", lambda d: d >= F.col("_from"))).alias("dt"))
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(prices.select("asset", "dt", "px"), ["asset", "dt"], "left").withColumn("px", F.last("px", ignorenulls=True).over(w))


def held_panel(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """(strategy, since, dt, asset, target, px, closing): holdings from each target date up to the next one, which closes the span
    with the old holdings.

    targets: (strategy, dt, asset, weight). Their dates are few, so spans of validity are joined by range, broadcast."""
    w = Window.partitionBy("strategy").orderBy("dt")
    spans = targets.select("strategy", "dt").distinct().withColumn("until", F.lead("dt").over(w)).withColumnRenamed("dt", "since")
    dates = prices.select("dt").distinct()
    ruled = dates.join(F.broadcast(spans), (F.col("dt") >= F.col("since")) & (F.col("until").isNull() | (F.col("dt") <= F.col("until"))))
    out = ruled.join(targets.withColumnRenamed("dt", "since"), ["strategy", "since"]).join(carried(prices), ["dt", "asset"])
    closing = F.coalesce(F.col("dt") == F.col("until"), F.lit(False))
    return out.select("strategy", "since", "dt", "asset", F.col("weight").alias("target"), "px", closing.alias("closing"))


def drifted_panel(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """held_panel with value (the growth of the asset's target since its rebalance), weight (its share, null where all is worth 0) and
    before (its value on the date before)."""
    own = Window.partitionBy("strategy", "since", "asset").orderBy("dt")
    out = held_panel(prices, targets).withColumn("value", F.col("target") * F.col("px") / F.first("px").over(own))
    total = F.sum("value").over(Window.partitionBy("strategy", "since", "dt"))
    return out.withColumns({"weight": F.when(total != 0, F.col("value") / total), "before": F.lag("value").over(own)})


def drifted(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """(strategy, dt, since, asset, target, weight, value) of the holdings that each date ends with."""
    return drifted_panel(prices, targets).where(~F.col("closing")).select("strategy", "dt", "since", "asset", "target", "weight", "value")


def strategy_returns(prices: DataFrame, targets: DataFrame, bps: float = DEFAULT.cost_bps) -> DataFrame:
    """(strategy, dt, r, turnover, cost). The rebalance day's weights earn from the next row on; cost falls on the rebalance day
    and is bps times the sum of |target - drifted weight|. A date whose old holdings are worth nothing returns 0."""
    d = drifted_panel(prices, targets)
    moved = F.sum(F.when(F.col("dt") == F.col("since"), F.col("target")).otherwise(0.0)) - F.sum(F.when(F.col("closing"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    later = F.col("dt") > F.col("since")
    each = d.groupBy("strategy", "dt", "asset").agg(
        moved.alias("moved"),
        F.max(F.col("closing") | (F.col("dt") == F.col("since"))).alias("rebalanced"),
        F.sum(F.when(later, F.col("value"))).alias("now"),
        F.sum(F.when(later, F.col("before"))).alias("was"),
    )
    out = each.groupBy("strategy", "dt").agg(
        F.coalesce(F.when(F.sum("was") != 0, F.sum("now") / F.sum("was") - 1), F.lit(0.0)).alias("gross"),
        F.coalesce(F.sum(F.when(F.col("rebalanced"), F.abs("moved"))), F.lit(0.0)).alias("turnover"),
    )
    cost = F.col("turnover") * bps / 1e4
    return out.select("strategy", "dt", (F.col("gross") - cost).alias("r"), "turnover", cost.alias("cost"))


def schedule(prices: DataFrame, every: int = DEFAULT.rebalance, offset: int = DEFAULT.offset) -> DataFrame:
    return rebalance_dates(prices.select("dt").distinct(), every, offset)


def equal_targets(prices: DataFrame, dates: DataFrame, name: str = "equal_weight") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("dt"))
    return prices.join(F.broadcast(dates.select("dt")), "dt").select(F.lit(name).alias("strategy"), "dt", "asset", (1 / n).alias("weight"))


def fixed_targets(prices: DataFrame, dates: DataFrame, weights: dict[str, float], name: str = "sixty_forty") -> DataFrame:
    """Given weights over the assets that a date has, normalised; equal weights where none of them is there."""
    w = F.lit(0.0)
    for asset, x in weights.items():
        w = F.when(F.col("asset") == asset, float(x)).otherwise(w)
    out = prices.join(F.broadcast(dates.select("dt")), "dt").withColumn("_w", w)
    total, n = F.sum("_w").over(Window.partitionBy("dt")), F.count(F.lit(1)).over(Window.partitionBy("dt"))
    return out.select(F.lit(name).alias("strategy"), "dt", "asset", F.when(total > 0, F.col("_w") / total).otherwise(1 / n).alias("weight"))


def inverse_vol_targets(returns: DataFrame, dates: DataFrame, lookback: int = DEFAULT.lookback, name: str = "inverse_vol") -> DataFrame:
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(-lookback, -1)
    out = returns.withColumn("_s", F.stddev_samp("r").over(w)).join(F.broadcast(dates.select("dt")), "dt").where(F.col("_s") > 0)
    return out.select(F.lit(name).alias("strategy"), "dt", "asset", (1 / F.col("_s") / F.sum(1 / F.col("_s")).over(Window.partitionBy("dt"))).alias("weight"))


def no_drift_returns(returns: DataFrame, targets: DataFrame, bps: float = DEFAULT.cost_bps) -> DataFrame:
    """Weights stand still between rebalances and earn from the row after; cost on the change of targets."""
    w = Window.partitionBy("strategy").orderBy("dt")
    spans = targets.select("strategy", "dt").distinct().withColumns({"until": F.lead("dt").over(w), "before": F.lag("dt").over(w)})
    dates = returns.select("dt").distinct()
    ruled = dates.join(F.broadcast(spans.withColumnRenamed("dt", "since")), (F.col("dt") > F.col("since")) & (F.col("until").isNull() | (F.col("dt") <= F.col("until"))))
    got = ruled.join(targets.withColumnRenamed("dt", "since"), ["strategy", "since"]).join(returns, ["dt", "asset"], "left")
    gross = got.groupBy("strategy", "dt").agg(F.sum(F.coalesce("r", F.lit(0.0)) * F.col("weight")).alias("g"))
    old = spans.where(F.col("before").isNotNull()).select("strategy", "dt", F.col("before").alias("p")).join(targets.select("strategy", F.col("dt").alias("p"), "asset", F.col("weight").alias("wo")), ["strategy", "p"]).drop("p")
    turn = targets.join(old, ["strategy", "dt", "asset"], "full").groupBy("strategy", "dt").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("wo", F.lit(0.0)))).alias("turnover"))
    out = gross.join(turn, ["strategy", "dt"], "left")
    return out.select("strategy", "dt", (F.col("g") - F.coalesce("turnover", F.lit(0.0)) * bps / 1e4).alias("r"))


def daily_asof_returns(returns: DataFrame, targets: DataFrame, bps: float = DEFAULT.cost_bps) -> DataFrame:
    """The latest target is set again each day, and each day pays for the day's drift: |target - drifted| after the day's return."""
    w = Window.partitionBy("strategy").orderBy("dt")
    spans = targets.select("strategy", "dt").distinct().withColumn("until", F.lead("dt").over(w)).withColumnRenamed("dt", "since")
    ruled = returns.join(F.broadcast(spans), (F.col("dt") >= F.col("since")) & (F.col("until").isNull() | (F.col("dt") < F.col("until"))))
    got = ruled.join(targets.withColumnRenamed("dt", "since"), ["strategy", "since", "asset"])
    g = got.groupBy("strategy", "dt").agg(F.sum(F.col("weight") * F.col("r")).alias("g"))
    moved = got.join(g, ["strategy", "dt"]).groupBy("strategy", "dt").agg(F.first("g").alias("g"), F.sum(F.abs(F.col("weight") - F.col("weight") * (1 + F.col("r")) / (1 + F.col("g")))).alias("turnover"))
    return moved.select("strategy", "dt", (F.col("g") - F.col("turnover") * bps / 1e4).alias("r"), "turnover")


def turnover_limited(prices: DataFrame, limits: list[float | None], every: int = DEFAULT.rebalance, offset: int = DEFAULT.lookback, lookback: int = DEFAULT.lookback, aversion: float = 2.0, bps: float = DEFAULT.cost_bps, days: int = DEFAULT.days) -> DataFrame:
    """(strategy, dt, r, turnover) for each limit on |target - drifted|. A limit is one group: its dates depend on each other."""
    levels = prices.sparkSession.createDataFrame([("none" if x is None else f"{x:g}", x) for x in limits], "strategy string, cap double")
    panel = prices.select("dt", "asset", "px").crossJoin(F.broadcast(levels))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="dt", columns="asset", values="px", aggfunc="first").sort_index().ffill().dropna()
        x, cap = wide.pct_change().fillna(0).to_numpy(float), pdf["cap"].iloc[0]
        w, rows = None, []
        for t in range(offset, len(x)):
            r = 0.0 if w is None else float(w @ x[t])
            if w is not None:
                w = w * (1 + x[t]) / (1 + r)
            turn = 0.0
            if (t - offset) % every == 0:
                past = x[max(1, t - lookback + 1) : t + 1]
                rules = Constraints(x.shape[1])
                if w is not None and cap == cap and cap is not None:
                    rules = rules.turnover(w, cap)
                new = mean_variance(past.mean(0) * days, covariance(past, days=days), aversion, rules)
                turn = float(np.abs(new - (0 if w is None else w)).sum())
                w = new
            rows.append((pdf["strategy"].iloc[0], wide.index[t], r - turn * bps / 1e4, turn))
        return pd.DataFrame(rows, columns=["strategy", "dt", "r", "turnover"])

    return panel.groupBy("strategy").applyInPandas(run, "strategy string, dt date, r double, turnover double")


def cost_sweep(returns: DataFrame, levels=(0, 5, 10, 15, 20, 30, 40, 50)) -> DataFrame:
    """returns: (strategy, dt, r, turnover, cost) at any cost; net returns at each level, without running anything anew."""
    grid = returns.sparkSession.createDataFrame([(float(x),) for x in levels], "bps double")
    return returns.crossJoin(F.broadcast(grid)).select("strategy", "dt", "bps", (F.col("r") + F.col("cost") - F.col("turnover") * F.col("bps") / 1e4).alias("r"))


def holding_returns(prices: DataFrame, weights: DataFrame, rows: int = 21) -> DataFrame:
    """Return of each rebalance date's weights over the next `rows` rows, and turnover against the former targets."""
    ahead = prices.select("dt", "asset", (F.lead("px", rows).over(Window.partitionBy("asset").orderBy("dt")) / F.col("px") - 1).alias("_f"))
    w = Window.partitionBy("strategy", "asset").orderBy("dt")
    got = weights.join(ahead, ["dt", "asset"]).withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    return got.groupBy("strategy", "dt").agg(F.sum(F.col("weight") * F.col("_f")).alias("r"), F.sum("_d").alias("turnover")).where(F.col("r").isNotNull())


def stress(returns: DataFrame, scenarios: DataFrame, key: str = "asset", days: int = DEFAULT.days) -> DataFrame:
    """scenarios: (scenario, start, stop), a few rows; metrics of each window that has rows."""
    got = returns.join(F.broadcast(scenarios), F.col("dt").between(F.col("start"), F.col("stop")))
    out = got.withColumn("_g", growth(F.col("r"), Window.partitionBy("scenario", key).orderBy("dt")))
    top = F.max("_g").over(Window.partitionBy("scenario", key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_dd", F.col("_g") / top - 1)
    return out.groupBy("scenario", key).agg(F.count("r").alias("n"), (F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("total_return"), (F.stddev_samp("r") * math.sqrt(days)).alias("volatility"), F.min("_dd").alias("max_drawdown"), F.min("r").alias("worst_day"))


def regime_split(returns: DataFrame, market: DataFrame, pct: float = 0.75, n: int = 63, key: str = "asset") -> DataFrame:
    """Metrics of days on which the market's n-row volatility is above (high) or not above its own percentile."""
    w = Window.orderBy("dt").rowsBetween(1 - n, 0)
    vol = market.withColumn("_v", F.when(F.count("b").over(w) >= n, F.stddev_samp("b").over(w)))
    edge = vol.agg(F.expr(f"percentile(_v, {pct})").alias("_e"))
    days = vol.crossJoin(F.broadcast(edge)).withColumn("regime", F.when(F.col("_v") > F.col("_e"), "high").when(F.col("_v").isNotNull(), "normal"))
    got = returns.join(days.select("dt", "regime"), "dt").where(F.col("regime").isNotNull())
    out = got.groupBy(key, "regime").agg(F.count("r").alias("n"), (F.avg("r") * 252).alias("annual_return"), (F.stddev_samp("r") * math.sqrt(252)).alias("volatility"))
    return out.where(F.col("n") > 5)


def compare(results: DataFrame) -> DataFrame:
    """results: (strategy, dt, r). One row of metrics a strategy, by Sharpe ratio."""
    return arithmetic(results, "strategy").orderBy(F.desc("sharpe"))


def verdict(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """metrics: (strategy, sharpe). The best one, the difference of two, and what it means."""
    best = metrics.agg(F.max_by("strategy", "sharpe").alias("winner"), F.max(F.when(F.col("strategy") == base, F.col("sharpe"))).alias("base_sharpe"), F.max(F.when(F.col("strategy") == other, F.col("sharpe"))).alias("other_sharpe"))
    d = F.col("other_sharpe") - F.col("base_sharpe")
    return best.withColumns({"delta": d, "verdict": F.when(d > 0.1, "positive").when(d > 0, "slightly positive").when(d > -0.1, "neutral").otherwise("negative")})
