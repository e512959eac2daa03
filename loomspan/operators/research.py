"""Reports, lookups and registries beside the panels, and strategies that follow forecasts, views or agents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.allocation import Constraints, black_litterman, covariance, dealt, mean_variance, nearest_psd, shrunk

# ---- columns and lookups ------------------------------------------------------------------------------------------------


def first_of_each_name(df: DataFrame) -> DataFrame:
    """The first of equally named columns (names compared as Spark does, without case)."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    seen: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        seen.setdefault(name.lower(), i)
    return plain.select([F.col(f"c{i}").alias(df.columns[i]) for i in seen.values()])


def class_of(asset: Column, classes: dict[str, list[str]]) -> Column:
    """The first class that lists the asset, else Unknown."""
    out = F.lit("Unknown")
    for name, assets in reversed(classes.items()):
        out = F.when(asset.isin(*assets), name).otherwise(out)
    return out


def display_name(feature: Column, names: dict[str, str]) -> Column:
    """A series' name in words, without the suffix of its lag."""
    base, lag = F.regexp_replace(feature, r"_lag\d+$", ""), F.regexp_extract(feature, r"_lag(\d+)$", 1)
    known = reduce(lambda rest, n: F.when(base == n[0], n[1]).otherwise(rest), names.items(), base)
    return F.when(lag != "", F.concat(known, F.lit(" (lag "), lag, F.lit(")"))).otherwise(known)


def persona(kind: Column, name: Column, personas: dict[str, tuple[str, str]], other: tuple[str, str]) -> tuple[Column, Column]:
    """(stance, biography) of an agent by its entity's type; the biography's {} is the name."""
    pick = lambda i: reduce(lambda rest, p: F.when(kind == p[0], p[1][i]).otherwise(rest), personas.items(), F.lit(other[i]))
    return pick(0), F.replace(pick(1), F.lit("{}"), name)


def by_position(left: DataFrame, right: DataFrame, order: str = "dt") -> DataFrame:
    """Rows of two frames joined by their place in `order`, as long as both have one: series that aren't aligned by date.

    left and right: (order, one value). A calendar is numbered by one ordered window; series by key go through key joins."""
    w = Window.orderBy(order)
    a = left.withColumn("position", F.row_number().over(w) - 1)
    b = right.withColumn("position", F.row_number().over(w) - 1).drop(order)
    return a.join(b, "position")


# ---- reports and registries ---------------------------------------------------------------------------------------------


def quality(panels: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """panels: source to (long panel, key, value). Coverage of each key of each source, in one table."""
    parts = []
    for source, (panel, key, value) in panels.items():
        v = F.col(value)
        one = panel.groupBy(F.col(key).alias("name")).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("dt").alias("first_dt"),
            F.max("dt").alias("last_dt"),
            (F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)) * 100).alias("null_pct"),
            F.count_if(v <= 0).alias("not_positive"),
        )
        parts.append(one.select(F.lit(source).alias("source"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compare_models(registry: DataFrame, target: str, metrics: list[str]) -> DataFrame:
    """registry: (target, model, fold, metrics...). Means over the folds of a target's models, the best first metric on top."""
    got = registry.where(F.col("target") == target).groupBy("model").agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics])
    return got.orderBy(f"{metrics[0]}_mean", "model")


def best_models(registry: DataFrame, metric: str, lower_is_better: bool = True) -> DataFrame:
    """Each target's best model by the metric's mean over folds; of equal ones the first by name."""
    mean = registry.groupBy("target", "model").agg(F.avg(metric).alias("score"))
    order = F.struct(F.col("score") if lower_is_better else -F.col("score"), F.col("model"))
    return mean.groupBy("target").agg(F.min_by("model", order).alias("model"), (F.min("score") if lower_is_better else F.max("score")).alias("score"))


# ---- strategies ---------------------------------------------------------------------------------------------------------


def signal_targets(signals: DataFrame, name: str = "agents") -> DataFrame:
    """(strategy, dt, asset, weight) in proportion to positive signals of a date; equal where none is positive. signals: (dt, asset,
    ensemble)."""
    w = Window.partitionBy("dt")
    up = F.greatest(F.coalesce("ensemble", F.lit(0.0)), F.lit(0.0))
    total, n = F.sum(up).over(w), F.count(F.lit(1)).over(w)
    return signals.select(F.lit(name).alias("strategy"), "dt", "asset", F.when(total > 0, up / total).otherwise(1 / n).alias("weight"))


#: What an agent gives to each class of assets in each state of the market.
STATE_WEIGHTS = {
    "defensive": {"equity": -0.03, "bond": 0.04, "alt": 0.02},
    "risk_on": {"equity": 0.04, "bond": -0.02, "alt": 0.01},
    "balanced": {"equity": 0.01, "bond": 0.01, "alt": 0.005},
}


def market_state(level: Column, spread: Column, high: float = 25.0, low: float = 15.0, inverted: float = -0.5, unknown: float = 20.0) -> Column:
    """defensive above `high`, risk_on below `low`, else balanced; a spread below `inverted` makes it one step more defensive. An unknown
    level counts as `unknown`, an unknown spread changes nothing."""
    at = F.coalesce(level, F.lit(unknown))
    deep = F.coalesce(spread < inverted, F.lit(False))
    return F.when(at > high, "defensive").when(at < low, F.when(deep, "balanced").otherwise("risk_on")).otherwise(F.when(deep, "defensive").otherwise("balanced"))


def state_signal(state: Column, asset: Column, classes: dict[str, list[str]], tilts: dict[str, dict[str, float]], confidence: float = 1.0) -> Column:
    """The weight of the asset's class in the state (an asset of no class is equity) and the state's own tilt of the asset, times the
    agent's confidence."""
    kind = F.when(class_of(asset, classes) == "Unknown", "equity").otherwise(class_of(asset, classes))
    pick = lambda table, key: F.coalesce(F.element_at(F.create_map(*[c for k, v in table.items() for c in (F.lit(k), F.lit(v))]), key), F.lit(0.0))
    none = F.lit(0.0)
    base = reduce(lambda rest, s: F.when(state == s, pick(STATE_WEIGHTS[s], kind)).otherwise(rest), STATE_WEIGHTS, none)
    tilt = reduce(lambda rest, s: F.when(state == s, pick(tilts[s], asset)).otherwise(rest), tilts, none)
    return (base + tilt) * confidence


def track_record(signals: DataFrame, outcomes: DataFrame, by: str = "agent") -> DataFrame:
    """(by, dt, ic): the correlation over assets of an agent's signals of a round with what came of them; null where either doesn't vary.
    signals: (by, dt, asset, signal); outcomes: (dt, asset, actual)."""
    both = signals.join(outcomes, ["dt", "asset"])
    varies = (F.stddev_pop("signal") > 1e-12) & (F.stddev_pop("actual") > 1e-12)
    return both.groupBy(by, "dt").agg(F.when(varies, F.corr("signal", "actual")).alias("ic"))


def adapted(records: DataFrame, by: str = "agent", base: float = 0.6, rate: float = 0.1, window: int = 10, least: float = 0.1, most: float = 0.95, start: float | None = None) -> DataFrame:
    """(by, dt, confidence, blend) of an agent in each round, by its record (by, dt, ic) of the rounds before.

    Confidence rises by half the rate (up to `most`) when the mean of the last `window` rounds is above 0.05, falls by the rate (down to
    `least`) when it is below -0.05, and else goes a tenth of the way back to `base`. The blend of momentum (1) and its contrary (0)
    begins at 0.5 and moves by 0.05, between 0.1 and 0.9, towards the one that did better in the last five rounds, once there are
    five. A round is a calendar's, so an agent's history is one fold."""
    w = Window.partitionBy(by).orderBy("dt")
    recent = F.coalesce(F.avg("ic").over(w.rowsBetween(-window, -1)), F.lit(0.0))
    last = w.rowsBetween(-5, -1)
    mean = F.avg(F.coalesce("ic", F.lit(0.0))).over(last)
    # A mean that is 0 but for the last digits of its sum moves nothing.
    better = F.when(F.count(F.lit(1)).over(last) >= 5, F.when(mean > 1e-9, 1.0).when(mean < -1e-9, -1.0).otherwise(0.0)).otherwise(0.0)
    moves = records.select(by, "dt", F.when(recent > 0.05, 1).when(recent < -0.05, -1).otherwise(0).alias("up"), better.alias("to"))
    rounds = moves.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dt", "up", "to"))).alias("rounds"))
    day = records.schema["dt"].dataType.simpleString()
    begin = F.struct(F.lit(base if start is None else start).alias("c"), F.lit(0.5).alias("b"), F.array().cast(f"array<struct<dt:{day},confidence:double,blend:double>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        c = F.when(r["up"] > 0, F.least(s["c"] + rate * 0.5, F.lit(most))).when(r["up"] < 0, F.greatest(s["c"] - rate, F.lit(least))).otherwise(s["c"] + (base - s["c"]) * 0.1)
        b = F.when(r["to"] > 0, F.least(s["b"] + 0.05, F.lit(0.9))).when(r["to"] < 0, F.greatest(s["b"] - 0.05, F.lit(0.1))).otherwise(s["b"])
        return F.struct(c.alias("c"), b.alias("b"), F.concat(s["out"], F.array(F.struct(r["dt"].alias("dt"), c.alias("confidence"), b.alias("blend")))).alias("out"))

    return rounds.select(by, F.explode(F.aggregate("rounds", begin, step, lambda s: s["out"])).alias("r")).select(by, "r.*")


def blended_signal(momentum: Column, blend: Column, confidence: Column) -> Column:
    """Momentum and its contrary in shares of blend and 1 - blend, times confidence."""
    return (blend * momentum + (1 - blend) * -momentum) * confidence


def forward_covariance(x: np.ndarray, forecast: np.ndarray, blend: float = 0.3, days: int = DEFAULT.days) -> np.ndarray:
    """Annual covariance for the time ahead: shrunk history, `blend` of it with variances moved to the size of forecast returns."""
    past = shrunk(x) * days
    scale = np.sqrt(np.maximum(forecast**2, 1e-12) / np.maximum(np.diag(past), 1e-12))
    ahead = past * np.outer(scale, scale)
    return nearest_psd((1 - blend) * past + blend * ahead)


def view_weights(cov, market, p, q, tau: float = 0.05, aversion: float = 2.5, rules: Constraints | None = None) -> np.ndarray:
    """Mean-variance weights at the posterior mean of market equilibrium and views, with covariance (1 + tau) S."""
    mean, _ = black_litterman(np.asarray(cov), np.asarray(market), p, q, tau, aversion)
    return mean_variance(mean, (1 + tau) * np.asarray(cov), aversion, rules)


def forecast_targets(predictions: DataFrame, returns: DataFrame, dates: DataFrame, horizon: int = 21, lookback: int = DEFAULT.lookback, aversion: float = 5.0, cap: float = DEFAULT.max_weight, shrink: float = 0.5, days: int = DEFAULT.days) -> DataFrame:
    """(strategy, dt, asset, weight): at each date the annualised predictions (p * days / horizon), shrunk to the mean of the window's
    returns, against the window's shrunk covariance, under a weight cap. A date is one group: lookback rows of the assets predicted.

    predictions: (dt, asset, p); the latest of each asset at or before a date counts."""
    calendar = returns.select("dt").distinct().withColumn("j", F.row_number().over(Window.orderBy("dt")))
    at = dates.select(F.col("dt").alias("on")).join(calendar.select(F.col("dt").alias("on"), F.col("j").alias("i")), "on")
    spans = predictions.select("asset", F.col("dt").alias("since"), "p", F.lead("dt").over(Window.partitionBy("asset").orderBy("dt")).alias("until"))
    now = spans.join(F.broadcast(at), (F.col("since") <= F.col("on")) & (F.col("until").isNull() | (F.col("on") < F.col("until")))).select("on", "i", "asset", "p")
    past = returns.join(calendar, "dt").select("asset", "j", "r")
    rows = past.join(now, (past["asset"] == now["asset"]) & (F.col("j") <= F.col("i")) & (F.col("j") > F.col("i") - lookback)).select("on", "j", now["asset"], "p", "r")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="j", columns="asset", values="r", aggfunc="first").sort_index().fillna(0.0)
        p = pdf.groupby("asset")["p"].first()[wide.columns].to_numpy(float)
        x = wide.to_numpy(float)
        if len(x) < 20:
            return pd.DataFrame(columns=["strategy", "dt", "asset", "weight"])
        mu = (1 - shrink) * p * days / horizon + shrink * x.mean(0) * days
        w = mean_variance(mu, covariance(x, days=days), aversion, Constraints(len(mu)).box(0.0, max(cap, 1 / len(mu))))
        return pd.DataFrame({"strategy": "optimised_forecast", "dt": pdf["on"].iloc[0], "asset": wide.columns, "weight": w})

    # A row a date and asset: kept, as a backtest reads its targets several times and would solve anew.
    return dealt(rows, "on").groupBy("on").applyInPandas(run, "strategy string, dt date, asset string, weight double").persist()
