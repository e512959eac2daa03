"""Parts that a study can be given: estimates of expected returns, cost models and scores, as factories of Columns, by name.

Each registry is a dictionary; `register` adds to one. What is registered is an expression, so a study with another model is another plan
and no other code path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.backtest import drifted_panel

#: Window to annual expected return: the rows of an asset that the estimate may see.
Expected = Callable[[Window], Column]
#: Moved share of the portfolio, volatility and daily value of the asset to cost as a share of the portfolio.
Cost = Callable[[Column, Column, Column], Column]
#: Label and prediction to an aggregate; higher is better.
Score = Callable[[Column, Column], Column]

EXPECTED: dict[str, Expected] = {
    "mean": lambda w: F.avg("r").over(w) * DEFAULT.days,
    "median": lambda w: F.percentile("r", F.lit(0.5)).over(w) * DEFAULT.days,
    "geometric": lambda w: F.exp(F.avg(F.ln(1 + F.col("r"))).over(w) * DEFAULT.days) - 1,
    "trimmed": lambda w: F.avg(F.greatest(F.lit(-0.02), F.least(F.lit(0.02), F.col("r")))).over(w) * DEFAULT.days,
}


def proportional(bps: float = DEFAULT.cost_bps) -> Cost:
    return lambda moved, vol, volume: moved * bps / 1e4


def per_trade(fee: float = 1e-5, least: float = 1e-9) -> Cost:
    """A fee for each asset that is traded at all."""
    return lambda moved, vol, volume: F.when(moved > least, fee).otherwise(0.0)


def square_root_impact(coefficient: float = 0.1, value: float = 1e6) -> Cost:
    """Volatility times the root of the traded share of an asset's daily value, on what is traded, for a portfolio of `value`."""
    return lambda moved, vol, volume: F.when(volume > 0, coefficient * vol * F.sqrt(moved * value / volume) * moved).otherwise(0.0)


def together(*models: Cost) -> Cost:
    return lambda moved, vol, volume: reduce(lambda a, b: a + b, (m(moved, vol, volume) for m in models))


COSTS: dict[str, Cost] = {"proportional": proportional(), "per_trade": per_trade(), "impact": square_root_impact(), "all": together(proportional(), per_trade(), square_root_impact())}

SCORES: dict[str, Score] = {
    "neg_mse": lambda y, p: -F.avg((y - p) * (y - p)),
    "neg_mae": lambda y, p: -F.avg(F.abs(y - p)),
    "r2": lambda y, p: 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y)),
    "ic": lambda y, p: F.corr(y, p),
    "direction": lambda y, p: F.avg(F.when(F.signum(y) == F.signum(p), 1.0).otherwise(0.0)),
}


def register(registry: dict, name: str, part: Callable) -> None:
    if name in registry:
        raise ValueError(f"{name} is there already")
    registry[name] = part


def expected_returns(returns: DataFrame, dates: DataFrame, names: list[str], lookback: int = DEFAULT.lookback, least: int = 20, registry: dict[str, Expected] = EXPECTED) -> DataFrame:
    """(dt, asset, and a column for each estimate) at each date, of the `lookback` rows of the asset before it, where there are `least`."""
    w = Window.partitionBy("asset").orderBy("dt").rowsBetween(-lookback, -1)
    got = returns.select("asset", "dt", F.count("r").over(w).alias("_n"), *[registry[n](w).alias(n) for n in names])
    return got.where(F.col("_n") >= least).join(F.broadcast(dates.select("dt")), "dt").select("dt", "asset", *names)


def priced_returns(prices: DataFrame, targets: DataFrame, market: DataFrame, models: list[str], registry: dict[str, Cost] = COSTS) -> DataFrame:
    """(strategy, dt, model, r, cost): returns net of each cost model, from one pass over the holdings. market: (asset, vol, volume), the
    volatility and daily value that impact needs; an asset without them has none."""
    d = drifted_panel(prices, targets)
    later = F.col("dt") > F.col("since")
    moved = F.sum(F.when(F.col("dt") == F.col("since"), F.col("target")).otherwise(0.0)) - F.sum(F.when(F.col("closing"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    each = d.groupBy("strategy", "dt", "asset").agg(moved.alias("_m"), F.max(F.col("closing") | (F.col("dt") == F.col("since"))).alias("_on"), F.sum(F.when(later, F.col("value"))).alias("_now"), F.sum(F.when(later, F.col("before"))).alias("_was"))
    each = each.join(market, "asset", "left")
    cost = lambda n: F.coalesce(F.sum(F.when(F.col("_on"), registry[n](F.abs("_m"), F.coalesce("vol", F.lit(0.0)), F.coalesce("volume", F.lit(0.0))))), F.lit(0.0))
    gross = F.coalesce(F.when(F.sum("_was") != 0, F.sum("_now") / F.sum("_was") - 1), F.lit(0.0))
    day = each.groupBy("strategy", "dt").agg(gross.alias("_g"), *[cost(n).alias(n) for n in models])
    return day.unpivot(["strategy", "dt", "_g"], models, "model", "cost").select("strategy", "dt", "model", (F.col("_g") - F.col("cost")).alias("r"), "cost")


def scored(panel: DataFrame, by: list[str], names: list[str], registry: dict[str, Score] = SCORES) -> DataFrame:
    """(by..., and a column for each score) of the rows that have a label and a prediction."""
    full = panel.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    return full.groupBy(*by).agg(*[registry[n](F.col("y"), F.col("p")).alias(n) for n in names])
