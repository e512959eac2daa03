"""Rank statistics over arrays and windows, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.special import normal_two_sided
from loomspan.operators.metrics import average_rank
from loomspan.operators.returns import by_time


def array_ranks(values: Column) -> Column:
    """Each value's rank in its array from 1, equal values at the mean of their places: its first place in the sorted array and, from
    the other end, its last."""
    up, down, n = F.sort_array(values), F.sort_array(values, False), F.size(values)
    both = F.array(F.struct(up.alias("up"), down.alias("down")))
    ranked = F.transform(both, lambda s: F.transform(values, lambda v: (F.array_position(s["up"], v) + n + 1 - F.array_position(s["down"], v)) / 2))
    return F.get(ranked, F.lit(0))


def array_correlation(x: Column, y: Column) -> Column:
    """Linear correlation of two arrays of one length; null where either doesn't vary."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y", "xx", "yy", "xy")])

    def step(s: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.struct((s["x"] + a).alias("x"), (s["y"] + b).alias("y"), (s["xx"] + a * a).alias("xx"), (s["yy"] + b * b).alias("yy"), (s["xy"] + a * b).alias("xy"))

    n = F.size(x)

    def finish(s: Column) -> Column:
        vx, vy = s["xx"] - s["x"] * s["x"] / n, s["yy"] - s["y"] * s["y"] / n
        return F.when((vx > 1e-9) & (vy > 1e-9), (s["xy"] - s["x"] * s["y"] / n) / F.sqrt(vx * vy))

    return F.aggregate(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), start, step, finish)


def rolling_rank_ic(panel: DataFrame, n: int = 63, least: int = 10, key: str = "asset") -> DataFrame:
    """(key, dt, rank_ic): rank correlation of p and y over the key's last n rows before the row, equal values at the mean of their ranks.
    A frame is an array of n pairs at most."""
    frame = by_time(key).rowsBetween(-n, -1)
    held = panel.withColumn("_f", F.collect_list(F.struct("p", "y")).over(frame)).where(F.size("_f") >= least)
    ranked = held.select(key, "dt", array_ranks(F.col("_f.p")).alias("_p"), array_ranks(F.col("_f.y")).alias("_y"))
    return ranked.select(key, "dt", array_correlation(F.col("_p"), F.col("_y")).alias("rank_ic"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """(a, b, n, w, z, p_value): signed ranks of ra - rb without zeros, equal sizes at their mean rank; the variance is corrected for
    these ties, and the chance is the normal distribution's."""
    d = pairs.select("a", "b", (F.col("ra") - F.col("rb")).alias("_d")).where(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    ranked = d.withColumn("_r", average_rank("_a", ["a", "b"])).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy("a", "b", "_a")))
    up = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0))
    # A tie of t values counts t times with (t * t - 1): t ** 3 - t in all.
    g = ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), up.alias("_up"), F.sum("_r").alias("_all"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"))
    n = F.col("n").cast("double")
    g = g.withColumn("w", F.least(F.col("_up"), F.col("_all") - F.col("_up")))
    deviation = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    g = g.withColumn("z", F.when(deviation > 0, (F.col("w") - n * (n + 1) / 4) / deviation))
    return g.select("a", "b", "n", "w", "z", normal_two_sided(F.col("z")).alias("p_value"))
