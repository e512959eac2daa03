"""Feature transforms that are fitted on training rows and kept as tables, and applied to any rows by a join.

`by` names what a transform belongs to (an asset, a fold): rows of one key train its transform, and rows of the same key get it. What is
fitted is a table of one row a key and feature, so it can be written, read back, listed and compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.linear import cell, products


def standardised(train: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by..., n, mean, std, corr): means and deviations (population) as arrays in the order of `features`, and the correlation matrix."""
    m = len(features) + 1
    g = train.dropna(subset=features).groupBy(*by).agg(products([F.lit(1.0), *(F.col(f).cast("double") for f in features)]).alias("g"))
    n = cell(F.col("g"), m, 0, 0)
    mean = F.array(*[cell(F.col("g"), m, 0, j) / n for j in range(1, m)])
    cov = lambda i, j: cell(F.col("g"), m, i, j) / n - F.col("mean")[i - 1] * F.col("mean")[j - 1]
    out = g.select(*by, "g", n.cast("long").alias("n"), mean.alias("mean"))
    std = F.array(*[F.sqrt(F.greatest(F.lit(0.0), cov(j, j))) for j in range(1, m)])
    out = out.withColumn("std", F.transform(std, lambda s: F.when(s > 1e-12, s).otherwise(1.0)))
    corr = F.array(*[cov(i, j) / (F.col("std")[i - 1] * F.col("std")[j - 1]) for i in range(1, m) for j in range(1, m)])
    return out.select(*by, "n", "mean", "std", corr.alias("corr"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _principal(corr: pd.Series) -> pd.Series:
    """Eigenvectors of small matrices by falling value, each with its value in front and its largest entry positive."""

    def one(flat) -> list:
        k = int(round(len(flat) ** 0.5))
        values, vectors = np.linalg.eigh(np.asarray(flat, float).reshape(k, k))
        out = []
        for i in np.argsort(-values, kind="stable"):
            v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
            out.append([float(values[i]), *v.tolist()])
        return out

    return pd.Series([one(x) for x in corr])


def fit_components(train: DataFrame, features: list[str], by: list[str], components: int) -> DataFrame:
    """(by..., feature, place, mean, std, loadings, shares): principal components of the standardised features of each key's rows. The
    rows are summed in Spark; a small matrix a key is decomposed."""
    fitted = standardised(train, features, by).withColumn("_v", F.slice(_principal("corr"), 1, min(components, len(features))))
    shares = F.transform("_v", lambda v: F.element_at(v, 1) / len(features))
    one = lambda i, f: F.struct(F.lit(f).alias("feature"), F.lit(i).alias("place"), F.col("mean")[i].alias("mean"), F.col("std")[i].alias("std"), F.transform("_v", lambda v: F.element_at(v, F.lit(i + 2))).alias("loadings"))
    return fitted.select(*by, shares.alias("shares"), F.explode(F.array(*[one(i, f) for i, f in enumerate(features)])).alias("r")).select(*by, "r.*", "shares")


def apply_components(rows: DataFrame, transform: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """`rows` with x, an array of their key's components; rows of a key without a transform go."""
    packed = transform.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "mean", "std", "loadings"))).alias("_t"))
    values = F.array(*[F.col(f).cast("double") for f in features])
    scaled = F.zip_with("_t", values, lambda t, v: F.struct(((v - t["mean"]) / t["std"]).alias("z"), t["loadings"].alias("l")))
    count = F.size(F.col("_t")[0]["loadings"])
    x = F.transform(F.sequence(F.lit(1), count), lambda c: F.aggregate("_z", F.lit(0.0), lambda a, t: a + t["z"] * F.element_at(t["l"], c)))
    return rows.join(packed, by).withColumn("_z", scaled).withColumn("x", x).drop("_t", "_z")


def fit_top_k(train: DataFrame, features: list[str], by: list[str], k: int, bins: int = 10, label: str = "y") -> DataFrame:
    """(by..., feature, mi, place, chosen): mutual information of each feature and the label over a key's rows, both cut into `bins` groups
    of equal size by rank (equal values share a group's first), and whether it is among the k greatest. Only counts are shuffled beside
    the ranks."""
    long = train.dropna(subset=[*features, label]).unpivot([*by, label], features, "feature", "v")
    own = [*by, "feature"]
    w = Window.partitionBy(*own)
    n = F.count(F.lit(1)).over(w)
    group = lambda c: F.floor((F.rank().over(w.orderBy(c)) - 1) * bins / n)
    dealt = long.select(*own, group("v").alias("a"), group(label).alias("b"))
    joint = dealt.groupBy(*own, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*own, *c))
    joint = joint.withColumns({"t": over(), "na": over("a"), "nb": over("b")})
    mi = joint.groupBy(*own).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    # Rounded before ranking: sums of doubles depend on the order of rows.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("mi", 10)), "feature"))
    return mi.withColumn("place", place).withColumn("chosen", F.col("place") <= k)


def apply_top_k(rows: DataFrame, transform: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """`rows` with x, an array of the features chosen for their key, the best first; rows of a key without a transform go."""
    names = transform.where("chosen").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "feature"))).alias("_t"))
    values = F.create_map(*[c for f in features for c in (F.lit(f), F.col(f).cast("double"))])
    return rows.join(names, by).withColumn("_m", values).withColumn("x", F.transform("_t.feature", lambda f: F.element_at("_m", f))).drop("_t", "_m")


def spread(rows: DataFrame, count: int, x: str = "x") -> tuple[DataFrame, list[str]]:
    """`rows` with the first `count` entries of an array as columns of their own, and these columns' names."""
    names = [f"_{x}_{i}" for i in range(count)]
    return rows.select("*", *[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(names)]), names


def transformed_forecasts(table: DataFrame, splits: DataFrame, features: list[str], kind: str, size: int, key: str = "asset") -> DataFrame:
    """(key, fold, dt, y, p): in each fold a transform is fitted on the train rows ("components" or "top_k" of `size`), applied to both
    parts by join, and a linear model of the train rows scores the test rows."""
    from loomspan.operators.linear import least_squares
    from loomspan.operators.panels import rows_of_split

    by, rows = [key, "fold"], rows_of_split(table, splits, key)
    train = rows.where(F.col("role") == "train")
    if kind == "components":
        moved = apply_components(rows, fit_components(train, features, by, size), features, by)
    else:
        moved = apply_top_k(rows, fit_top_k(train, features, by, size), features, by)
    moved, names = spread(moved, min(size, len(features)))
    model = least_squares(moved.where(F.col("role") == "train"), "y", names, by).select(*by, "beta")
    p = sum((F.col("beta")[i + 1] * F.col(c) for i, c in enumerate(names)), F.col("beta")[0])
    return moved.where(F.col("role") == "test").join(model, by).select(*by, "dt", "y", p.alias("p"))
