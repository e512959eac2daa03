"""Studies put together from the other operators: excess returns, rolling rank correlation, reports, searches and walk-forward runs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.functions.special import normal_two_sided
from loomspan.operators import allocation as al
from loomspan.operators import backtest as bt
from loomspan.operators import forecasts as fc
from loomspan.operators import linear as ln
from loomspan.operators import panels as pn
from loomspan.operators.returns import by_time


def excess_returns(returns: DataFrame, rates: DataFrame, days: int = DEFAULT.days) -> DataFrame:
    """r less the annual percent rate (dt, rate) of the date, carried forward, then backward, over the calendar of returns."""
    dates = returns.select("dt").distinct().join(rates.select("dt", "rate"), "dt", "left")
    w = Window.orderBy("dt")
    known = F.coalesce(F.last("rate", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("rate", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return returns.join(dates.select("dt", known.alias("_rate")), "dt").withColumn("excess", F.col("r") - F.col("_rate") / 100 / days).drop("_rate")


def rank_consensus(scores: DataFrame, item: str = "feature", by: str = "model", value: str = "value") -> DataFrame:
    """Mean rank of each item over models, the best first."""
    r = scores.withColumn("_r", F.rank().over(Window.partitionBy(by).orderBy(F.desc(value))))
    return r.groupBy(item).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def lead_correlation(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """(asset, series, corr): the month's change of a macro series' last value against the next month's summed return."""
    m = macro.groupBy("series", F.trunc("dt", "MM").alias("month")).agg(F.max_by("value", "dt").alias("v"))
    m = m.withColumn("chg", F.col("v") / F.lag("v").over(Window.partitionBy("series").orderBy("month")) - 1)
    r = returns.groupBy("asset", F.trunc("dt", "MM").alias("month")).agg(F.sum("r").alias("s"))
    r = r.withColumn("ahead", F.lead("s").over(Window.partitionBy("asset").orderBy("month")))
    return r.join(m, "month").where(F.col("chg").isNotNull() & F.col("ahead").isNotNull()).groupBy("asset", "series").agg(F.corr("chg", "ahead").alias("corr"), F.count(F.lit(1)).alias("n"))


def quality_report(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(column, nulls, infinite, zeros, constant, rows): one pass over the frame."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.abs(F.col(c)) == float("inf")).alias("infinite"), F.count_if(F.col(c) == 0).alias("zeros"), (F.min(c) == F.max(c)).alias("constant"), F.count(F.lit(1)).alias("rows"))
    return df.agg(F.array(*[one(c) for c in values]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def normality(returns: DataFrame, value: str = "r", key: str = "asset") -> DataFrame:
    """(key, n, statistic, p_value): the Kolmogorov-Smirnov distance of a key's values to the normal distribution with their mean and
    deviation, and its chance by the limit distribution with Stephens' correction for n."""
    w = Window.partitionBy(key)
    z = (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)
    placed = returns.select(key, z.alias("_z"), F.row_number().over(w.orderBy(value)).alias("_i"), F.count(F.lit(1)).over(w).alias("n"))
    tail = normal_two_sided(F.col("_z")) / 2
    below = placed.withColumn("_f", F.when(F.col("_z") > 0, 1 - tail).otherwise(tail))
    apart = F.greatest(F.col("_i") / F.col("n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("n"))
    out = below.groupBy(key, "n").agg(F.max(apart).alias("statistic"))
    root = F.sqrt("n")
    scaled = (root + 0.12 + 0.11 / root) * F.col("statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * scaled * scaled))
    return out.select(key, "n", "statistic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)).alias("p_value"))


def residual_diagnostics(panel: DataFrame, key: str = "asset") -> DataFrame:
    """Moments of y - p, Jarque-Bera and Durbin-Watson statistics, and the first autocorrelation."""
    e = panel.withColumn("_e", F.col("y") - F.col("p"))
    mean = F.avg("_e").over(Window.partitionBy(key))
    e = e.withColumns({"_x": F.col("_e") - mean, "_l": F.lag("_e").over(by_time(key))}).withColumn("_lx", F.lag("_x").over(by_time(key)))
    s, k, n = F.skewness("_e"), F.kurtosis("_e"), F.count("_e")
    d = F.col("_e") - F.col("_l")
    return e.groupBy(key).agg(F.avg("_e").alias("mean"), F.stddev_samp("_e").alias("std"), s.alias("skew"), k.alias("kurtosis"), (n / 6 * (s * s + k * k / 4)).alias("jb"), (F.sum(d * d) / F.sum(F.col("_e") * F.col("_e"))).alias("dw"), (F.sum(F.col("_x") * F.col("_lx")) / F.sum(F.col("_x") * F.col("_x"))).alias("rho_1"))


def forecast_comparison(oof: DataFrame, base: str) -> DataFrame:
    """Error metrics of each model, and the statistic of its squared errors against the base's, best first."""
    from loomspan.operators.metrics import prediction_metrics

    e = oof.withColumn("_e", (F.col("y") - F.col("p")) ** 2)
    b = e.where(F.col("model") == base).select("asset", "fold", "dt", F.col("_e").alias("_b"))
    d = e.join(b, ["asset", "fold", "dt"]).withColumn("_d", F.col("_e") - F.col("_b"))
    dm = d.groupBy("model").agg(F.when(F.stddev_pop("_d") > 0, F.avg("_d") / (F.stddev_pop("_d") / F.sqrt(F.count("_d")))).alias("dm"))
    return prediction_metrics(oof, "model").join(dm, "model").orderBy("rmse")


def horizon_decay(signals: DataFrame, prices: DataFrame, horizons=(5, 21, 63)) -> DataFrame:
    """(horizon, pearson, hit): a signal (dt, asset, p) against returns over several horizons."""
    w = by_time()
    ahead = prices.select("dt", "asset", *[(F.lead("px", h).over(w) / F.col("px") - 1).alias(f"h{h}") for h in horizons])
    long = signals.join(ahead, ["dt", "asset"]).unpivot(["dt", "asset", "p"], [f"h{h}" for h in horizons], "h", "y").where(F.col("y").isNotNull())
    return long.groupBy(F.substring("h", 2, 9).cast("int").alias("horizon")).agg(F.corr("p", "y").alias("pearson"), F.avg((F.signum("p") == F.signum("y")).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"))


def random_portfolios(spark: SparkSession, assets: list[str], mu: np.ndarray, cov: np.ndarray, n: int = 5000, seed: int = 42) -> DataFrame:
    """(id, weights, ret, vol, sharpe): even draws from the simplex, as normalised exponentials of hashed uniforms."""
    u = lambda i: (F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(2**31 - 1)) + 1) / (2.0**31)
    e = F.array(*[-F.ln(u(i)) for i in range(len(assets))])
    out = spark.range(n).withColumn("_e", e).withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("weights", F.transform("_e", lambda x: x / F.col("_t"))).drop("_e", "_t")
    w = [F.col("weights")[i] for i in range(len(assets))]
    ret = sum((float(mu[i]) * w[i] for i in range(len(assets))), F.lit(0.0))
    var = sum((float(cov[i, j]) * w[i] * w[j] for i, j in itertools.product(range(len(assets)), repeat=2)), F.lit(0.0))
    return out.withColumns({"ret": ret, "vol": F.sqrt(var)}).withColumn("sharpe", F.col("ret") / F.col("vol"))


def moments(returns: DataFrame, assets: list[str], days: int = DEFAULT.days) -> tuple[np.ndarray, np.ndarray]:
    """Annual means and covariances of the named assets: one aggregation each, a small matrix on the driver."""
    k = {a: i for i, a in enumerate(assets)}
    mu = np.zeros(len(assets))
    for r in returns.where(F.col("asset").isin(assets)).groupBy("asset").agg((F.avg("r") * days).alias("m")).collect():
        mu[k[r["asset"]]] = r["m"]
    cov = np.zeros((len(assets),) * 2)
    for r in al.covariance_long(returns.where(F.col("asset").isin(assets)), days).collect():
        cov[k[r["i"]], k[r["j"]]] = r["cov"] or 0.0
    return mu, al.nearest_psd(cov)


def frontier(spark: SparkSession, mu: np.ndarray, cov: np.ndarray, points: int = 50, rf: float = 0.0) -> DataFrame:
    """(kind, ret, vol): frontier portfolios, solved in parallel, and the line through the best one."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                w = al.mean_variance(mu, cov, float(0.1 * 500 ** (i / max(1, points - 1))))
                rows.append(("frontier", int(i), float(mu @ w), math.sqrt(w @ cov @ w)))
            yield pd.DataFrame(rows, columns=["kind", "id", "ret", "vol"])

    out = spark.range(0, points, 1, min(points, 16)).mapInPandas(run, "kind string, id long, ret double, vol double")
    best = al.max_sharpe(mu, cov, rf)
    if best is None:
        return out
    r, v = float(mu @ best), math.sqrt(best @ cov @ best)
    line = spark.range(16).select(F.lit("line").alias("kind"), "id", (rf + F.col("id") / 10 * (r - rf)).alias("ret"), (F.col("id") / 10 * v).alias("vol"))
    return out.unionByName(line)


def strategy_table(weights: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """weights: (name, asset, weight). Statistics and concentration of each strategy."""
    w = F.col("weight")
    conc = weights.groupBy("name").agg(F.max(w).alias("max_weight"), (1 / F.sum(w * w)).alias("effective_n"), F.count_if(w > 1e-6).alias("held"))
    return al.portfolio_stats(weights, mu, cov).join(conc, "name").orderBy(F.desc("sharpe"))


def views(predictions: DataFrame, confidence: DataFrame) -> DataFrame:
    """(asset, q, omega): each asset's last prediction as an absolute view with variance (1 - c) / c, c clipped to .01 to .99."""
    last = predictions.groupBy("asset").agg(F.max_by("p", "dt").alias("q"))
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("confidence")))
    return last.join(confidence, "asset").select("asset", "q", ((1 - c) / c).alias("omega"))


def random_search(table: DataFrame, splits: DataFrame, features: list[str], candidates: list[dict], key: str = "asset") -> DataFrame:
    """(candidate, mse, n): ridge penalties or tree settings, each candidate and fold in a group of its own."""
    import json

    rows = pn.rows_of_split(table, splits, key)
    grid = table.sparkSession.createDataFrame([(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(candidates)], "candidate long, settings string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = json.loads(pdf["settings"].iloc[0])
        pdf = pdf.sort_values("dt")
        a, b = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        if len(a) < 20 or not len(b):
            return pd.DataFrame(columns=["candidate", "sse", "n"])
        made = {"linear": fc.Linear, "boosted": fc.Boosted, "bagged": fc.Bagged}[c.pop("model")](**c)
        m = made.fit(a[features].to_numpy(float), a["y"].to_numpy(float))
        e = m.predict(b[features].to_numpy(float)) - b["y"].to_numpy(float)
        return pd.DataFrame([{"candidate": pdf["candidate"].iloc[0], "sse": float(e @ e), "n": len(e)}])

    got = rows.crossJoin(F.broadcast(grid)).groupBy("candidate", key, "fold").applyInPandas(run, "candidate long, sse double, n long")
    return got.groupBy("candidate").agg((F.sum("sse") / F.sum("n")).alias("mse"), F.sum("n").alias("n")).join(grid, "candidate").orderBy("mse")


def ic_weights(oof: DataFrame, floor: float = 0.001) -> DataFrame:
    """(model, asset, weight): weights by the linear correlation of out-of-fold predictions, at least `floor`, normalised."""
    ic = oof.groupBy("model", "asset").agg(F.greatest(F.lit(floor), F.coalesce(F.corr("y", "p"), F.lit(0.0))).alias("_ic"))
    return ic.withColumn("weight", F.col("_ic") / F.sum("_ic").over(Window.partitionBy("asset"))).drop("_ic")


def intervals(oof: DataFrame, level: float = 0.9, key: str = "asset") -> DataFrame:
    """(key, lo, hi): quantiles of out-of-fold residuals, to be added to a prediction."""
    a = (1 - level) / 2
    e = oof.withColumn("_e", F.col("y") - F.col("p"))
    return e.groupBy(key).agg(F.expr(f"percentile(_e, {a}D)").alias("lo"), F.expr(f"percentile(_e, {1 - a}D)").alias("hi"), F.count("_e").alias("n"))


def walk_forward(table: DataFrame, features: list[str], model: str = "ridge", every_months: int = 3, least: int = 100, horizon: int = 0, key: str = "asset") -> DataFrame:
    """(key, dt, p): retrained at the start of each period on rows before it (`horizon` rows before, where labels look ahead).

    Ridge models come from running sums of products. Others see their rows: each key and period is a group, its history up to then."""
    if model == "ridge":
        return ln.walk_forward(table, features, every_months, least, horizon, key=key)
    t = table.withColumn("_m", ln.period(every_months))
    t = t.withColumn("_i", F.row_number().over(by_time(key)))
    periods = t.groupBy(key, F.col("_m").alias("period")).agg(F.min("_i").alias("_first"))
    rows = t.join(periods, key).where((F.col("_m") == F.col("period")) | (F.col("_i") < F.col("_first") - horizon))
    kind = table.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        now = pdf["_m"] == pdf["period"]
        a, b = pdf[~now], pdf[now]
        if len(a) < least:
            return pd.DataFrame(columns=[key, "dt", "p"])
        m = fc.MODELS[model]().fit(a[features].to_numpy(float), a["y"].to_numpy(float))
        return b.assign(p=m.predict(b[features].to_numpy(float)))[[key, "dt", "p"]]

    return rows.groupBy(key, "period").applyInPandas(run, f"{key} {kind}, dt date, p double")


def by_prediction(predictions: DataFrame, dates: DataFrame, cap: float = DEFAULT.max_weight, name: str = "forecast") -> DataFrame:
    """Targets in proportion to positive predictions of each date, capped and normalised; equal where none is positive."""
    p = predictions.join(F.broadcast(dates.select("dt")), "dt").withColumn("_p", F.greatest("p", F.lit(0.0)))
    w = Window.partitionBy("dt")
    raw = F.when(F.sum("_p").over(w) > 0, F.col("_p") / F.sum("_p").over(w)).otherwise(1 / F.count(F.lit(1)).over(w))
    out = p.withColumn("_w", F.least(F.lit(cap), raw))
    return out.select(F.lit(name).alias("strategy"), "dt", "asset", (F.col("_w") / F.sum("_w").over(w)).alias("weight"))


def forecast_backtest(table: DataFrame, prices: DataFrame, features: list[str], model: str = "ridge", every: int = DEFAULT.rebalance, bps: float = DEFAULT.cost_bps) -> DataFrame:
    """Walk-forward predictions to targets in proportion to them to net returns."""
    p = walk_forward(table, features, model, horizon=21)
    dates = pn.rebalance_dates(p.select("dt").distinct(), every, 0)
    return bt.strategy_returns(prices, by_prediction(p, dates), bps)


def integrated_targets(table: DataFrame, returns: DataFrame, features: list[str], agreement: DataFrame | None, model: str = "ridge", every: int = DEFAULT.rebalance, horizon: int = 21, aversion: float = 5.0, cap: float = 0.35) -> DataFrame:
    """(strategy, dt, asset, weight): walk-forward predictions, annualised, against the shrunk covariance of the rows before under a
    weight cap: "optimised_forecast". With (dt, agreement), a second strategy, "integrated", has these weights blended to equal ones by its
    risk scale, the latest known at the date."""
    from loomspan.operators import agents as ag
    from loomspan.operators import research as rs

    p = walk_forward(table, features, model, horizon=horizon)
    dates = pn.rebalance_dates(p.select("dt").distinct(), every, 0)
    targets = rs.forecast_targets(p, returns, dates, horizon, aversion=aversion, cap=cap, shrink=0.0)
    if agreement is None:
        return targets
    scaled = pn.asof(targets, agreement, "agreement").withColumn("scale", F.coalesce(ag.risk_scale(F.col("agreement")), F.lit(1.0)))
    return targets.unionByName(ag.blend_to_equal(scaled).select(F.lit("integrated").alias("strategy"), "dt", "asset", "weight"))


def run_experiment(name: str, features: DataFrame, prices: DataFrame, returns: DataFrame, names: list[str], kind: str = "components", size: int = 2, train_end: str = "1997-12-31", start: str = "1998-01-01", horizon: int = 21, every: int = DEFAULT.rebalance, aversion: float = 5.0, cap: float = DEFAULT.max_weight, bps: float = DEFAULT.cost_bps, least: tuple[int, int] = (500, 50)) -> DataFrame:
    """One row: experiment, ic, direction, and the metrics of its backtest. features: (dt, asset, names...).

    A transform ("components", "top_k", or "none") and a linear model of each asset are fitted on rows up to train_end whose labels,
    `horizon` rows ahead, are known by then, where there are `least` rows to train on and to test; both are applied from `start` on, and the
    predictions to mean-variance targets, net of cost."""
    from loomspan.operators import metrics as mt
    from loomspan.operators import research as rs
    from loomspan.operators import transforms as tf

    w = by_time()
    known_at = F.lead("dt", horizon).over(w)
    labels = prices.select("dt", "asset", (F.lead("px", horizon).over(w) / F.col("px") - 1).alias("y"), known_at.alias("_known"))
    rows = features.dropna(subset=names).join(labels, ["dt", "asset"])
    train, live = rows.where((F.col("dt") <= train_end) & (F.col("_known") <= train_end)), rows.where(F.col("dt") >= start)
    enough = train.groupBy("asset").agg(F.count(F.lit(1)).alias("_a")).join(live.groupBy("asset").agg(F.count("y").alias("_b")), "asset").where((F.col("_a") >= least[0]) & (F.col("_b") >= least[1])).select("asset")
    if kind == "none":
        columns, moved = names, (train, live)
    else:
        fit, apply = {"components": (tf.fit_components, tf.apply_components), "top_k": (tf.fit_top_k, tf.apply_top_k)}[kind]
        fitted = fit(train, names, ["asset"], size)
        moved = [tf.spread(apply(r, fitted, names, ["asset"]), size) for r in (train, live)]
        columns, moved = moved[0][1], (moved[0][0], moved[1][0])
    model = ln.least_squares(moved[0], "y", columns, ["asset"]).join(enough, "asset").select("asset", "beta")
    p = sum((F.col("beta")[i + 1] * F.col(c) for i, c in enumerate(columns)), F.col("beta")[0])
    # A row an asset and date, read by the scores and by the targets.
    scored = moved[1].join(model, "asset").select("asset", "dt", "y", p.alias("p")).persist()
    each = scored.where(F.col("y").isNotNull()).groupBy("asset").agg(F.corr("y", "p").alias("ic"), F.avg((F.signum("y") == F.signum("p")).cast("double")).alias("direction"))
    dates = pn.rebalance_dates(scored.select("dt").distinct(), every, every)
    targets = rs.forecast_targets(scored.select("dt", "asset", "p"), returns, dates, horizon, aversion=aversion, cap=cap, shrink=0.0)
    net = bt.strategy_returns(prices.where(F.col("dt") >= start), targets, bps)
    result = mt.evaluate_oos(net.select("strategy", "dt", "r"), "strategy").drop("strategy")
    return each.agg(F.lit(name).alias("experiment"), F.avg("ic").alias("ic"), F.avg("direction").alias("direction")).crossJoin(F.broadcast(result))


def macro_signal(level: Column, spread: Column, high: float, tilt: Column) -> Column:
    """Against risk when the level is high or the spread negative, with the tilt of the asset else."""
    return F.when((level > high) | (spread < 0), -tilt).otherwise(tilt)


def suggestions(metrics: DataFrame, tried: DataFrame, models: list[str]) -> DataFrame:
    """(rule, detail): what to try next: models that no experiment had, lower cost if turnover is high, less risk if falls are deep."""
    s = metrics.sparkSession
    rest = s.createDataFrame([(m,) for m in models], "model string").join(tried.select("model").distinct(), "model", "left_anti")
    a = rest.select(F.lit("untried_model").alias("rule"), F.col("model").alias("detail"))
    b = metrics.where(F.col("max_drawdown") < -0.2).select(F.lit("reduce_risk").alias("rule"), F.col("strategy").alias("detail"))
    c = metrics.where(F.col("sharpe") < 0.5).select(F.lit("low_sharpe").alias("rule"), F.col("strategy").alias("detail"))
    return a.unionByName(b).unionByName(c)
