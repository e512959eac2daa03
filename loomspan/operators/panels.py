"""Alignment, missing data, outliers, cross-sections, reshaping and splits over long panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.returns import by_time

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def align(frames: list[DataFrame], how: str = "inner", on: str = "dt") -> DataFrame:
    """Frames keyed by date, joined into one: inner keeps common dates, outer all."""
    return reduce(lambda a, b: a.join(b, on, "inner" if how == "inner" else "full"), frames)


#: Values that are looked at to cut strings into buckets: those with the least hashes.
CUT_SAMPLE = 8_000


def cuts_of(df: DataFrame, order: str, buckets: int) -> tuple[Column, Column]:
    """(what is compared, rising cuts) for about even buckets of a column: of a number, date or time its approximate percentiles, of a
    string places in a bounded sample of its different values, compared whole, so that a common prefix changes nothing."""
    kind = df.schema[order].dataType.simpleString()
    if kind == "string":
        # Different values alone: a common one would fill the sample, and no cut can divide it.
        some = sorted(r[0] for r in df.where(F.col(order).isNotNull()).select(order).distinct().orderBy(F.xxhash64(order), order).limit(CUT_SAMPLE).collect())
        cuts = sorted({some[k * len(some) // buckets] for k in range(1, buckets)}) if some else []
        return F.col(order), F.array(*map(F.lit, cuts)).cast("array<string>")
    value = F.col(order).cast("timestamp").cast("long") if kind in ("date", "timestamp_ntz") else F.col(order).cast("long")
    got = df.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)])).first()[0]
    return value, F.array(*map(F.lit, sorted(set(got or [])))).cast("array<bigint>")


def numbered(df: DataFrame, order: str, by: list[str] | None = None, buckets: int = 200) -> DataFrame:
    """`df` with _no, a row's number from 0 in `order` within each of few keys: no task orders a whole key.

    Rows are dealt to buckets of rising order, numbered within each bucket, and shifted by the counts of the buckets before. The cuts are
    found by a job of their own when this is called; their number bounds what reaches the driver."""
    keys = by or []
    place, cut = cuts_of(df, order, buckets)
    dealt = df.withColumn("_bucket", F.coalesce(F.size(F.filter(cut, lambda c: c < place)), F.lit(-1)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(offsets, [*keys, "_bucket"]).withColumn("_no", F.col("_from") + F.col("_own")).drop("_bucket", "_own", "_from")


def asof(left: DataFrame, right: DataFrame, value: str, on: str = "dt", by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left with the last non-null `value` of right at or before its time (strict: before). by: keys both sides share.

    With keys, one shuffle: both sides are stacked, sorted by key and time, and the value is carried forward. Without, the different
    times of left alone are stacked so (a calendar: as long as there are dates, whatever the rows), and joined back by time."""
    if not by:
        times = left.select(on).where(F.col(on).isNotNull()).distinct()
        return left.join(_carried(times, right, value, on, [], strict), on, "left").select(*left.columns, value)
    return _carried(left, right, value, on, by, strict)


def _carried(left: DataFrame, right: DataFrame, value: str, on: str, keys: list[str], strict: bool) -> DataFrame:
    marked = right.where(F.col(value).isNotNull()).select(*keys, F.col(on), F.struct(F.col(value)).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    stacked = left.withColumn("_side", F.lit(0 if strict else 1)).unionByName(marked, allowMissingColumns=True).withColumn("_left", F.col("_v").isNull())
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = stacked.withColumn("_got", F.last("_v", ignorenulls=True).over(w))
    return out.where("_left").select(*left.columns, F.col(f"_got.{value}").alias(value))


def asof_ranges(right: DataFrame, value: str, on: str = "dt", by: list[str] | None = None) -> DataFrame:
    """Each value with the span [on, until) over which it is the latest: an as-of join then is a range join on few rows."""
    w = Window.partitionBy(*(by or [])).orderBy(on)
    return right.where(F.col(value).isNotNull()).select(*(by or []), F.col(on).alias("since"), F.lead(on).over(w).alias("until"), value)


def nearest(left: DataFrame, right: DataFrame, value: str, on: str = "dt") -> DataFrame:
    """The value of right nearest in time, past or future; of two as near, the earlier."""
    days = right.select(F.col(on).alias("_t"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    w = Window.orderBy("_t")
    edges = days.withColumn("_next", F.lead("_t").over(w))
    # Each value rules from half-way to its predecessor up to half-way to its successor.
    half = edges.withColumn("_to", F.date_add("_t", F.floor(F.datediff("_next", "_t") / 2).cast("int")))
    half = half.withColumn("_from", F.date_add(F.lag("_to").over(w), 1))
    return left.join(half, (F.col(on) >= F.coalesce("_from", F.lit("0001-01-01").cast("date"))) & (F.col(on) <= F.coalesce("_to", F.lit("9999-12-31").cast("date")))).select(*left.columns, F.col("_v").alias(value))


def business_days(panel: DataFrame, key: str = "asset") -> DataFrame:
    """(key, dt): Monday to Friday from each key's first to last date."""
    span = panel.groupBy(key).agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b")).alias("dt")).where(F.dayofweek("dt").between(2, 6))


def reindex(panel: DataFrame, value: str = "px", key: str = "asset") -> DataFrame:
    """One row for each business day of the key; value is null where there was none."""
    return business_days(panel, key).join(panel.select(key, "dt", value), [key, "dt"], "left")


def fill_forward(panel: DataFrame, value: str = "px", limit: int | None = None, key: str = "asset") -> DataFrame:
    w = by_time(key).rowsBetween(-limit if limit else Window.unboundedPreceding, 0)
    return panel.withColumn(value, F.last(value, ignorenulls=True).over(w))


def fill_both(panel: DataFrame, value: str = "px", key: str = "asset") -> DataFrame:
    """Forward, then backward."""
    w = by_time(key)
    return panel.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def interpolate(panel: DataFrame, value: str = "px", limit: int = 5, key: str = "asset") -> DataFrame:
    """Linear by row between neighbours, for at most `limit` rows after a known value."""
    w = by_time(key)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = panel.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    out = out.withColumns({"_a": F.last(value, ignorenulls=True).over(before), "_b": F.first(value, ignorenulls=True).over(after), "_ia": F.last(at, ignorenulls=True).over(before), "_ib": F.first(at, ignorenulls=True).over(after)})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ia")) / (F.col("_ib") - F.col("_ia"))
    return out.withColumn(value, F.coalesce(value, F.when(F.col("_i") - F.col("_ia") <= limit, line))).drop("_i", "_a", "_b", "_ia", "_ib")


def price_macro(prices: DataFrame, macro: DataFrame, limit: int = 5) -> DataFrame:
    """prices with each macro series of its date, carried forward for at most `limit` of the price dates."""
    dates = prices.select("dt").distinct()
    grid = dates.crossJoin(F.broadcast(macro.select("series").distinct())).join(macro, ["dt", "series"], "left")
    filled = fill_forward(grid, "value", limit, "series").withColumn("series", F.concat(F.lit("macro_"), "series"))
    return prices.join(filled, "dt")


def null_share(panel: DataFrame, by: str, value: str = "value", most: float = 0.2) -> DataFrame:
    """Rows of those `by` groups whose share of nulls is at most `most`, without the nulls left."""
    ok = panel.groupBy(by).agg(F.avg(F.col(value).isNull().cast("double")).alias("_s")).where(F.col("_s") <= most).select(by)
    return panel.join(ok, by).where(F.col(value).isNotNull())


def outliers_z(panel: DataFrame, value: str = "r", threshold: float = 3.0, key: str = "asset") -> DataFrame:
    stats = panel.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return panel.join(stats, key).withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")) > threshold, F.lit(False))).drop("_m", "_s")


def outliers_iqr(panel: DataFrame, value: str = "r", factor: float = 1.5, key: str = "asset") -> DataFrame:
    stats = panel.groupBy(key).agg(F.expr(f"percentile({value}, 0.25D)").alias("_a"), F.expr(f"percentile({value}, 0.75D)").alias("_b"))
    x, d = F.col(value), (F.col("_b") - F.col("_a")) * factor
    return panel.join(stats, key).withColumn("outlier", (x < F.col("_a") - d) | (x > F.col("_b") + d)).drop("_a", "_b")


def alpha_signals(panel: DataFrame, value: str = "p", clip: float = 3.0) -> DataFrame:
    """Over the assets of each date: z-score (clipped), rank share with averaged ties, and min-max to [-1, 1]."""
    w, x = Window.partitionBy("dt"), F.col(value)
    std, n = F.stddev_samp(value).over(w), F.count(value).over(w)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    z = F.when(std > 0, (x - F.avg(value).over(w)) / std).otherwise(0.0)
    rank = (F.rank().over(w.orderBy(value)) + (F.count(value).over(Window.partitionBy("dt", value)) - 1) / 2) / n
    return panel.withColumns({"z": F.greatest(F.lit(-clip), F.least(F.lit(clip), z)), "rank": rank, "minmax": F.when(hi > lo, 2 * (x - lo) / (hi - lo) - 1).otherwise(0.0)})


def combine_signals(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """signals: (name, dt, asset, value). Weighted mean with normalised weights; a name without weight has 1."""
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("name") == name, float(x)).otherwise(w)
    return signals.withColumn("_w", w).groupBy("dt", "asset").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("signal"))


def feature_set(features: DataFrame, name: str) -> DataFrame:
    """features: (..., feature, value). The named sets: all, macro_only, mom_vol, macro_mom, technical."""
    own = "_ret_|_vol_|_mom_|_rsi_"
    sets = {"all": ".", "mom_vol": "_mom_|_vol_", "technical": "_rsi_|_macd|_bb_|_ma_"}
    if name in sets:
        return features.where(F.col("feature").rlike(sets[name]))
    if name == "macro_only":
        return features.where(~F.col("feature").rlike(own))
    if name == "macro_mom":
        return features.where(~F.col("feature").rlike(own) | F.col("feature").contains("_mom_"))
    raise ValueError(f"no feature set {name}")


def features_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """(dt, asset, feature, value) of the named columns; feature is asset_name. Missing values go, infinite ones too."""
    out = wide.unpivot(["dt", "asset"], names, "feature", "value")
    out = out.withColumn("feature", F.concat_ws("_", "asset", "feature"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def monthly(returns: DataFrame, key: str = "asset") -> DataFrame:
    """Compounded return of each month from the first to the last of the key; a month without rows has 0."""
    got = returns.groupBy(key, F.trunc("dt", "MM").alias("month")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("ret"))
    span = got.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return grid.join(got, [key, "month"], "left").select(key, "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def month_table(returns: DataFrame, key: str = "asset") -> DataFrame:
    """A row a key and year: m1 to m12 and the year's compounded return."""
    m = monthly(returns, key).withColumns({"year": F.year("month"), "_m": F.month("month")})
    cells = [F.max(F.when(F.col("_m") == k, F.col("ret"))).alias(f"m{k}") for k in range(1, 13)]
    return m.groupBy(key, "year").agg(*cells, (F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1).alias("ytd"))


def rebalance_dates(dates: DataFrame, every: int = DEFAULT.rebalance, offset: int = 0) -> DataFrame:
    """dates: one row a date. Every `every`th row from row `offset` on, numbered from 0."""
    return dates.withColumn("i", (F.row_number().over(Window.orderBy("dt")) - 1).cast("long")).where((F.col("i") >= offset) & ((F.col("i") - offset) % every == 0))


_SPLIT = "fold long, train_start long, train_end long, test_start long, test_end long"


def expanding_splits(spark: SparkSession, n: int, folds: int = DEFAULT.cv[0], first: int = DEFAULT.cv[1], test: int = DEFAULT.cv[2], gap: int = DEFAULT.cv[3]) -> DataFrame:
    """Half-open row ranges: training grows by `test` rows a fold."""
    i = F.col("id")
    out = spark.range(folds).select(i.alias("fold"), F.lit(0).cast("long").alias("train_start"), (first + i * test).alias("train_end"))
    out = out.withColumn("test_start", F.col("train_end") + gap)
    return out.withColumn("test_end", F.least(F.col("test_start") + test, F.lit(n))).where(F.col("test_start") < n)


def walk_forward_splits(spark: SparkSession, n: int, train: int = DEFAULT.walk[0], test: int = DEFAULT.walk[1], step: int = DEFAULT.walk[2], gap: int = DEFAULT.walk[3]) -> DataFrame:
    count = max(0, (n - train - gap - test) // step + 1)
    i = F.col("id")
    out = spark.range(count).select(i.alias("fold"), (i * step).alias("train_start"), (i * step + train).alias("train_end"))
    return out.withColumn("test_start", F.col("train_end") + gap).withColumn("test_end", F.col("test_start") + test)


def purged_splits(spark: SparkSession, n: int, folds: int = DEFAULT.cv[0], embargo: int = DEFAULT.cv[3]) -> DataFrame:
    """Even test blocks; each trains on what stands before it, less the embargo. The first has nothing to train on and is left out."""
    size = n // (folds + 1)
    i = F.col("id") + 1
    out = spark.range(folds).select(F.col("id").alias("fold"), F.lit(0).cast("long").alias("train_start"), (i * size - embargo).alias("train_end"), (i * size).alias("test_start"))
    return out.withColumn("test_end", F.col("test_start") + size).where(F.col("train_end") > 0)


def blocking_splits(spark: SparkSession, n: int, folds: int = DEFAULT.cv[0], window: int | None = None) -> DataFrame:
    size = n // (folds + 1)
    i = F.col("id") + 1
    start = F.greatest(F.lit(0), i * size - window) if window else F.lit(0)
    return spark.range(folds).select(F.col("id").alias("fold"), start.cast("long").alias("train_start"), (i * size).alias("train_end"), (i * size).alias("test_start"), ((i + 1) * size).alias("test_end"))


#: Kinds of splits by name: folds of a calendar of n dates, and their half-open ranges as expressions of the fold i and n.
SPLITS = {
    "expanding": lambda i, n, folds=DEFAULT.cv[0], first=DEFAULT.cv[1], test=DEFAULT.cv[2], gap=DEFAULT.cv[3]: (F.lit(folds), F.lit(0), first + i * test, first + i * test + gap, F.least(first + (i + 1) * test + gap, n)),
    "walk_forward": lambda i, n, train=DEFAULT.walk[0], test=DEFAULT.walk[1], step=DEFAULT.walk[2], gap=DEFAULT.walk[3]: (F.floor((n - train - gap - test) / step) + 1, i * step, i * step + train, i * step + train + gap, i * step + train + gap + test),
    "purged": lambda i, n, folds=DEFAULT.cv[0], embargo=DEFAULT.cv[3]: (F.lit(folds), F.lit(0), (i + 1) * F.floor(n / (folds + 1)) - embargo, (i + 1) * F.floor(n / (folds + 1)), (i + 2) * F.floor(n / (folds + 1))),
    "blocking": lambda i, n, folds=DEFAULT.cv[0], window=None: (F.lit(folds), F.greatest(F.lit(0), (i + 1) * F.floor(n / (folds + 1)) - window) if window else F.lit(0), (i + 1) * F.floor(n / (folds + 1)), (i + 1) * F.floor(n / (folds + 1)), (i + 2) * F.floor(n / (folds + 1))),
}


def calendar_splits(panel: DataFrame, kind: str, **sizes: int) -> DataFrame:
    """Folds of a panel's own calendar: row ranges as the functions above give them, and the first and last date of each part. A fold
    without rows to train on or to test is left out. The calendar is one row, an array as long as there are dates."""
    days = panel.agg(F.array_sort(F.collect_set("dt")).alias("_days")).withColumn("_n", F.size("_days").cast("long"))
    count = SPLITS[kind](F.lit(0), F.col("_n"), **sizes)[0].cast("int")
    folds = days.withColumn("fold", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))).withColumn("fold", F.col("fold").cast("long"))
    names = ["train_start", "train_end", "test_start", "test_end"]
    out = folds.withColumns({n: c.cast("long") for n, c in zip(names, SPLITS[kind](F.col("fold"), F.col("_n"), **sizes)[1:], strict=True)})
    out = out.where((F.col("train_start") < F.col("train_end")) & (F.col("test_start") < F.least("test_end", "_n")))
    at = lambda c: F.get("_days", F.col(c).cast("int"))
    last = lambda c: F.get("_days", (F.least(F.col(c), F.col("_n")) - 1).cast("int"))
    return out.select("fold", *names, at("train_start").alias("train_from"), last("train_end").alias("train_to"), at("test_start").alias("test_from"), last("test_end").alias("test_to"))


def rows_of_split(panel: DataFrame, splits: DataFrame, key: str = "asset") -> DataFrame:
    """Rows of each fold with their role; splits is a table of a few rows."""
    numbered = panel.withColumn("i", (F.row_number().over(by_time(key)) - 1).cast("long"))
    i = F.col("i")
    train, test = (i >= F.col("train_start")) & (i < F.col("train_end")), (i >= F.col("test_start")) & (i < F.col("test_end"))
    return numbered.join(F.broadcast(splits), train | test).withColumn("role", F.when(test, "test").otherwise("train"))


def label_table(features: DataFrame, prices: DataFrame, horizon: int = 21) -> DataFrame:
    """features (dt, asset, ...) with y, the asset's return over the next `horizon` rows; rows without one go."""
    y = prices.select("dt", "asset", (F.lead("px", horizon).over(by_time()) / F.col("px") - 1).alias("y"))
    return features.join(y, ["dt", "asset"]).where(F.col("y").isNotNull())


def model_weights(scores: DataFrame, method: str = "inverse_rmse", key: str = "asset") -> DataFrame:
    """scores: key, model, rmse. Normalised weights by inverse rmse or mse, softmax of -rmse, or rank."""
    w, rmse = Window.partitionBy(key), F.col("rmse")
    n = F.count(F.lit(1)).over(w)
    raw: Column = {"inverse_rmse": 1 / rmse, "inverse_mse": 1 / (rmse * rmse), "softmax": F.exp(-rmse), "rank": (n + 1 - F.rank().over(w.orderBy("rmse"))).cast("double")}[method]
    out = scores.withColumn("_raw", raw)
    return out.withColumn("weight", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw")


def bayesian_weights(scores: DataFrame, criterion: str = "bic", key: str = "asset") -> DataFrame:
    """scores: key, model, n, k, mse. exp(-d/2) of each information criterion's distance from the least, normalised."""
    n, k = F.col("n"), F.col("k")
    ic = n * F.ln("mse") + (k * F.ln(n) if criterion == "bic" else 2 * k)
    w = Window.partitionBy(key)
    out = scores.withColumn("ic", ic)
    out = out.withColumn("_e", F.exp(-0.5 * (F.col("ic") - F.min("ic").over(w))))
    return out.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def weighted_ensemble(predictions: DataFrame, weights: DataFrame, key: str = "asset") -> DataFrame:
    """predictions: model, dt, key, p."""
    out = predictions.join(weights.select("model", key, "weight"), ["model", key])
    return out.groupBy("dt", key).agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("p"))
