"""The market of agents: signals, confidence-weighted ensembles, agreement, overlays and sampling of active agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.returns import by_time


def signals(prices: DataFrame, agents: DataFrame, dates: DataFrame) -> DataFrame:
    """(dt, asset, agent, confidence, signal). agents: (agent, kind, rows, confidence), a few rows.

    Kinds: momentum and contrarian over `rows` rows up to the row before, and noise from a hash of date, asset and agent."""
    lags = sorted({r["rows"] for r in agents.select("rows").distinct().collect()})
    w = by_time()
    out = prices.withColumns({f"_s{n}": F.coalesce(F.lag("px", 1).over(w) / F.lag("px", n).over(w) - 1, F.lit(0.0)) for n in lags})
    out = out.join(F.broadcast(dates.select("dt")), "dt").crossJoin(F.broadcast(agents))
    pick = F.lit(0.0)
    for n in lags:
        pick = F.when(F.col("rows") == n, F.col(f"_s{n}")).otherwise(pick)
    noise = (F.pmod(F.xxhash64("dt", "asset", "agent"), F.lit(2001)) - 1000) / 1e5
    value = F.when(F.col("kind") == "momentum", pick).when(F.col("kind") == "contrarian", -pick).otherwise(noise)
    return out.select("dt", "asset", "agent", "confidence", (value * F.col("confidence")).alias("signal"))


def ensemble(signals: DataFrame) -> DataFrame:
    """(dt, asset, ensemble): mean weighted by confidence."""
    return signals.groupBy("dt", "asset").agg((F.sum(F.col("confidence") * F.col("signal")) / F.sum("confidence")).alias("ensemble"))


def agreement(signals: DataFrame) -> DataFrame:
    """(dt, agreement): mean over agents of the correlation of their signals with the ensemble's over assets; agents whose signals
    don't vary don't count."""
    both = signals.join(ensemble(signals), ["dt", "asset"])
    each = both.groupBy("dt", "agent").agg(F.when((F.stddev_pop("signal") > 1e-12) & (F.stddev_pop("ensemble") > 1e-12), F.corr("signal", "ensemble")).alias("c"))
    return each.groupBy("dt").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("agreement"))


def position_scale(a: Column) -> Column:
    """1 from an agreement of 0.3 on, 0.5 up to 0.1, linear between."""
    return F.when(a >= 0.3, 1.0).when(a <= 0.1, 0.5).otherwise(0.5 + (a - 0.1) / 0.2 * 0.5)


def risk_scale(a: Column, floor: float = 0.3, ceiling: float = 1.0) -> Column:
    return floor + (ceiling - floor) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))


def blend_to_equal(weights: DataFrame, scale: str = "scale") -> DataFrame:
    """weight * scale + (1 - scale) / n over the assets of the date."""
    n = F.count(F.lit(1)).over(Window.partitionBy("dt"))
    return weights.withColumn("weight", F.col(scale) * F.col("weight") + (1 - F.col(scale)) / n)


def redistribute(weights: DataFrame, cash: list[str] | None = None, scale: str = "scale") -> DataFrame:
    """The mass that a scale below 0.99 frees goes to cash assets, or evenly to all; then weights are normalised."""
    w = Window.partitionBy("dt")
    to = F.col("asset").isin(*cash) if cash else F.lit(True)
    freed = F.sum("weight").over(w) * (1 - F.col(scale))
    share = F.when(to, freed / F.sum(to.cast("int")).over(w)).otherwise(0.0)
    moved = F.when(F.col(scale) >= 0.99, F.col("weight")).otherwise(F.col("weight") * F.col(scale) + F.coalesce(share, F.lit(0.0)))
    out = weights.withColumn("_w", moved)
    return out.withColumn("weight", F.col("_w") / F.sum("_w").over(w)).drop("_w")


def regime(level: Column, spread: Column, high: float, low: float) -> Column:
    return F.when((level > high) | (spread < 0), "crisis").when(level < low, "calm").otherwise("normal")


def agreement_terciles(rows: DataFrame) -> DataFrame:
    """rows: (agreement, r). Mean return and count by thirds of agreement, and the correlation of both."""
    edges = rows.agg(F.expr("percentile(agreement, array(0.33D, 0.67D))").alias("e"), F.corr("agreement", "r").alias("corr"))
    got = rows.crossJoin(F.broadcast(edges)).withColumn("tercile", F.when(F.col("agreement") <= F.col("e")[0], "low").when(F.col("agreement") <= F.col("e")[1], "mid").otherwise("high"))
    return got.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"), F.first("corr").alias("corr"))


def distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def active_agents(agents: DataFrame, hour: int, k: int, seed: int = 0) -> DataFrame:
    """agents: (agent_id, hours, rate). Those awake at the hour who pass a hashed draw at rate times the hour's factor; k at most."""
    factor = 1.5 if 18 <= hour <= 22 else 0.3 if hour < 6 else 1.0
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("agent_id").cast("string"), F.lit(str(hour)), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / 2.0**32
    awake = agents.where(F.array_contains("hours", hour)).withColumn("_d", draw).where(F.col("_d") < F.col("rate") * factor)
    return awake.orderBy("_d", "agent_id").limit(k).drop("_d")


def assign_posts(posts: DataFrame, agents: DataFrame) -> DataFrame:
    """posts: (post_id, kind); agents: (agent_id, kind, influence). Posts of a kind go round its agents; without one, to the most
    influential agent of all."""
    a = agents.withColumns({"_j": F.row_number().over(Window.partitionBy("kind").orderBy("agent_id")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("kind"))})
    sizes = a.select("kind", "_n").distinct()
    top = agents.agg(F.max_by("agent_id", F.struct("influence", "agent_id")).alias("_top"))
    p = posts.withColumn("_i", F.row_number().over(Window.partitionBy("kind").orderBy("post_id")) - 1).join(sizes, "kind", "left")
    p = p.withColumn("_j", F.pmod("_i", "_n").cast("int"))
    got = p.join(a.select("kind", F.col("_j").cast("int").alias("_j"), "agent_id"), ["kind", "_j"], "left").crossJoin(F.broadcast(top))
    return got.select("post_id", "kind", F.coalesce("agent_id", "_top").alias("agent_id"))

#: Fixed values of the rule table: kind, posts and comments an hour, first and last active hour, influence.
ACTIVITY = [("organization", 0.2, 0.1, 9, 17, 3.0), ("media", 0.8, 0.4, 7, 23, 2.5), ("expert", 0.3, 0.5, 8, 21, 2.0), ("person", 0.5, 1.0, 7, 23, 1.0)]


def activity_rules(entities: DataFrame, kind: Column, rules=ACTIVITY) -> DataFrame:
    """entities with posts, comments, hours (array) and influence by kind; unknown kinds are persons."""
    table = entities.sparkSession.createDataFrame(rules, "_kind string, posts double, comments double, _a int, _b int, influence double")
    known = F.when(kind.isin([r[0] for r in rules]), kind).otherwise("person")
    out = entities.withColumn("_kind", known).join(F.broadcast(table), "_kind")
    return out.withColumn("hours", F.sequence("_a", "_b")).drop("_kind", "_a", "_b")
