"""Bootstraps as Spark jobs: draws are rows whose blocks' starts come from a hash, joined with summaries of each possible block.

A replicate is seeded by md5 of seed, key and number, and its blocks by mixing that with theirs, so any engine draws alike and a lost
task draws the same again. No series goes
to Python or into one row: a series' row holds the summaries of the block that starts there, for each length up to the block's.
A replicate gathers one short struct a block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = "struct<s1:double,s2:double,g:double,peak:double,low:double,fall:double>"


#: Fixed values of the integer mixer: a step between blocks and a multiplier, both below 2**32.
STEP, FACTOR = 2654435761, 73244475


def drawn(start: Column, block: Column, below: Column) -> Column:
    """A number from 0 up to `below`, by mixing 32 bits of start and block: two rounds of shift, exclusive or and multiplication, in
    64-bit integers that don't overflow."""
    x = F.pmod(start + (block + 1) * F.lit(STEP), F.lit(2**32))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(FACTOR), F.lit(2**32))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 16)), below)


def seeded(seed: int, key: Column, rep: Column) -> Column:
    """Where a replicate's draws begin: the first eight hex digits of md5 of seed, key and replicate."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), rep.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _joined(a: Column, b: Column) -> Column:
    """The summary of a stretch followed by another: sums, growth, highest and lowest growth inside, deepest fall from a height."""
    return F.struct(
        (a["s1"] + b["s1"]).alias("s1"),
        (a["s2"] + b["s2"]).alias("s2"),
        (a["g"] * b["g"]).alias("g"),
        F.greatest(a["peak"], a["g"] * b["peak"]).alias("peak"),
        F.least(a["low"], a["g"] * b["low"]).alias("low"),
        F.least(a["fall"], b["fall"], a["g"] * b["low"] / a["peak"] - 1).alias("fall"),
    )


def _single(r: Column) -> Column:
    return F.struct(r.alias("s1"), (r * r).alias("s2"), (1 + r).alias("g"), (1 + r).alias("peak"), (1 + r).alias("low"), F.lit(0.0).alias("fall"))


def blocks(returns: DataFrame, block: int, circular: bool = False, key: str = "asset") -> DataFrame:
    """(key, n, pos, sums): for each row of a key in order, summaries of the 1 to `block` rows from there on; circular: past the end the
    first rows follow."""
    w = Window.partitionBy(key)
    rows = returns.where(F.col("r").isNotNull()).select(key, "r", (F.row_number().over(w.orderBy("dt")) - 1).alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    if circular:
        rows = rows.unionByName(rows.where(F.col("pos") < block - 1).withColumn("pos", (F.col("pos") + F.col("n")).cast("int")))
    frame = w.orderBy("pos").rowsBetween(0, block - 1)
    empty = F.array().cast(f"array<{SUMMARY}>")
    grown = F.aggregate(F.collect_list("r").over(frame), empty, lambda s, r: F.concat(s, F.array(F.when(F.size(s) == 0, _single(r)).otherwise(_joined(F.element_at(s, -1), _single(r))))))
    return rows.select(key, "n", "pos", grown.alias("sums")).where(F.col("pos") < F.col("n"))


def draws(table: DataFrame, reps: int, block: int, length: int | None, circular: bool, seed: int, key: str) -> DataFrame:
    """(key, rep, block, len, s): the summary of each drawn block; table: `blocks`."""
    sizes = table.groupBy(key).agg(F.max("n").alias("n"))
    size = F.least(F.lit(block), F.col("n"))
    sizes = sizes.select(key, F.lit(length).cast("long").alias("len") if length else F.col("n").alias("len"), "n", size.alias("b"))
    count = F.ceil(F.col("len") / F.col("b"))
    # One row a key makes its replicates' rows; they are dealt out before blocks are drawn.
    rows = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(key, "rep").withColumn("seed", seeded(seed, F.col(key), F.col("rep"))).withColumn("block", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    start = drawn(F.col("seed"), F.col("block"), F.col("n") if circular else F.col("n") - F.col("b") + 1)
    take = F.least(F.col("b"), F.col("len") - F.col("block") * F.col("b")).cast("int")
    got = rows.select(key, "rep", "block", "len", start.cast("int").alias("pos"), take.alias("take")).join(table.select(key, "pos", "sums").hint("shuffle_hash"), [key, "pos"])
    return got.select(key, "rep", "block", "len", F.element_at("sums", F.col("take")).alias("s"))


def replicates(returns: DataFrame, reps: int, block: int, length: int | None = None, circular: bool = False, seed: int = 42, key: str = "asset", paths: bool = True) -> DataFrame:
    """(key, rep, n, s): the summary of each replicate of `length` rows (the series' own where it is None), blocks in a row, the last one
    cut to fit. A series shorter than a block draws blocks of its whole length. Without `paths` only sums and growth are kept, which
    add up map-side; a path's depth needs its blocks in order."""
    got = draws(blocks(returns, block, circular, key), reps, block, length, circular, seed, key)
    if not paths:
        none = [F.lit(None).cast("double").alias(n) for n in ("peak", "low", "fall")]
        total = got.groupBy(key, "rep").agg(F.max("len").alias("n"), F.sum("s.s1").alias("s1"), F.sum("s.s2").alias("s2"), F.exp(F.sum(F.ln("s.g"))).alias("g"))
        return total.select(key, "rep", "n", F.struct("s1", "s2", "g", *none).alias("s"))
    got = got.groupBy(key, "rep").agg(F.max("len").alias("n"), F.sort_array(F.collect_list(F.struct("block", "s"))).alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["s"], lambda a, b: _joined(a, b["s"]))
    return got.select(key, "rep", "n", whole.alias("s"))


def statistic(name: str, days: int = 252) -> Column:
    """sharpe, mean, total, volatility (of the population) or max_drawdown of a replicate."""
    n, s = F.col("n"), F.col("s")
    mean = s["s1"] / n
    square = F.greatest(F.lit(0.0), s["s2"] - n * mean * mean)
    std = F.sqrt(square / (n - 1))
    if name == "sharpe":
        return F.when((n > 1) & (std > 1e-12), mean / std * math.sqrt(days)).otherwise(0.0)
    return {"mean": mean, "total": s["g"] - 1, "terminal": s["g"], "annual_return": mean * days, "volatility": F.sqrt(square / n) * math.sqrt(days), "max_drawdown": s["fall"]}[name]


def block_bootstrap(returns: DataFrame, name: str = "sharpe", reps: int = 1000, block: int = 21, circular: bool = False, seed: int = 42, key: str = "asset", days: int = 252) -> DataFrame:
    """(key, rep, value): a statistic of each replicate. block 1 draws single rows."""
    return replicates(returns, reps, block, None, circular, seed, key, name == "max_drawdown").select(key, "rep", statistic(name, days).alias("value"))


def monte_carlo_stress(returns: DataFrame, reps: int = 1000, horizon: int = 252, block: int = 21, levels=(0.01, 0.05, 0.5), seed: int = 42, key: str = "asset", days: int = 252) -> DataFrame:
    """Quantiles over block-drawn paths of `horizon` rows: end value, annual return, volatility (population), deepest fall."""
    names = ["terminal", "annual_return", "volatility", "max_drawdown"]
    paths = replicates(returns, reps, block, horizon, False, seed, key).select(key, *[statistic(n, days).alias(n) for n in names])
    return paths.groupBy(key).agg(*[F.avg(c).alias(f"{c}_mean") for c in names], *[F.expr(f"percentile({c}, {q}D)").alias(f"{c}_q{int(q * 100)}") for c in names for q in levels])
