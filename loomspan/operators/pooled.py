"""Forecast models of Spark ML over panels pooled from all keys: training, scoring, search and importances are Spark jobs over the rows.

A model sees the features and, one-hot, the key. Loops on the driver go over folds, models and candidates, which are few and given;
rows that are trained on again and again are written to the shared folder first."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import linear as ln
from loomspan.operators.panels import rows_of_split
from loomspan.operators.plugins import SCORES
from loomspan.operators.returns import by_time
from loomspan.sources import artefacts as af
from loomspan.sources.scratch import scratch

#: Estimators by name; `register` of the plugins adds more.
ESTIMATORS = {
    "linear": lambda: LinearRegression(regParam=0.0, solver="normal"),
    "ridge": lambda: LinearRegression(regParam=1e-3, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=1e-4, elasticNetParam=1.0),
    "elastic_net": lambda: LinearRegression(regParam=1e-4, elasticNetParam=0.5),
    "huber": lambda: LinearRegression(loss="huber", regParam=1e-4),
    "generalized": lambda: GeneralizedLinearRegression(family="gaussian", regParam=1e-4),
    "decision_tree": lambda: DecisionTreeRegressor(maxDepth=4, seed=42),
    "random_forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=5, seed=42),
    "gradient_boosting": lambda: GBTRegressor(maxIter=15, maxDepth=3, seed=42),
    "factorization": lambda: FMRegressor(factorSize=2, stepSize=0.01, seed=42),
}


def pipeline(name: str, features: list[str], key: str = "asset", label: str = "y", parameters: dict | None = None) -> Pipeline:
    """Key to one-hot, all into a vector, and the estimator with these parameters; it adds p. A key that training has not seen is an
    error."""
    model: Estimator = ESTIMATORS[name]()
    model = model.copy({model.getParam(k): v for k, v in (parameters or {}).items()})
    model.setFeaturesCol("_x").setLabelCol(label).setPredictionCol("p")
    index = StringIndexer(inputCol=key, outputCol="_k", handleInvalid="error", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, OneHotEncoder(inputCol="_k", outputCol="_o"), VectorAssembler(inputCols=[*features, "_o"], outputCol="_x"), model])


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written once and read again by each fit."""
    path = f"{scratch(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def cross_validate(table: DataFrame, splits: DataFrame, models: list[str], features: list[str], key: str = "asset", parameters: dict | None = None) -> DataFrame:
    """(model, key, fold, dt, y, p): out-of-fold predictions of one model a fold for all keys. table: key, dt, y and features without
    nulls; splits: row ranges within a key."""
    rows = kept(rows_of_split(table, splits, key).select(key, "dt", "y", *features, "fold", "role"))
    folds = sorted(r["fold"] for r in splits.select("fold").collect())
    out = []
    for name in models:
        for fold in folds:
            own = rows.where(F.col("fold") == fold)
            model = pipeline(name, features, key, parameters=parameters).fit(own.where(F.col("role") == "train"))
            out.append(model.transform(own.where(F.col("role") == "test")).select(F.lit(name).alias("model"), key, "fold", "dt", "y", "p"))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(table: DataFrame, splits: DataFrame, features: list[str], candidates: list[dict], score: str = "neg_mse", key: str = "asset", scores: dict = SCORES) -> DataFrame:
    """(candidate, settings, score), the best first, over all folds' test rows. A candidate: {"model": name, parameters...}."""
    rows = kept(table.select(key, "dt", "y", *features))
    parts = [cross_validate(rows, splits, [c["model"]], features, key, {k: v for k, v in c.items() if k != "model"}).withColumn("candidate", F.lit(i)) for i, c in enumerate(candidates)]
    got = _union(parts).groupBy("candidate").agg(scores[score](F.col("y"), F.col("p")).alias("score"))
    settings = F.element_at(F.array(*[F.lit(json.dumps(c, sort_keys=True)) for c in candidates]), F.col("candidate") + 1)
    return got.select("candidate", settings.alias("settings"), "score").orderBy(F.desc("score"), "candidate")


def learning_curve(table: DataFrame, name: str, features: list[str], shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), test: int = 63, key: str = "asset") -> DataFrame:
    """(share, n, train_rmse, test_rmse): each key's last `test` rows are held out; training takes the last share of the rest."""
    w = by_time(key)
    placed = kept(table.select(key, "dt", "y", *features, (F.row_number().over(w) - 1).alias("_i"), (F.count(F.lit(1)).over(Window.partitionBy(key)) - test).alias("_n")))
    rmse = lambda: F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2))
    out = []
    for s in shares:
        train = placed.where((F.col("_i") < F.col("_n")) & (F.col("_i") >= F.col("_n") - F.floor(F.col("_n") * s)))
        model = pipeline(name, features, key).fit(train)
        seen = model.transform(train).agg(F.count(F.lit(1)).alias("n"), rmse().alias("train_rmse"))
        held = model.transform(placed.where(F.col("_i") >= F.col("_n"))).agg(rmse().alias("test_rmse"))
        out.append(seen.crossJoin(held).select(F.lit(float(s)).alias("share"), "n", "train_rmse", "test_rmse"))
    return _union(out)


def shuffled(rows: DataFrame, features: list[str], repeats: int, key: str = "asset", seed: int = 42) -> DataFrame:
    """Copies of the rows, one for each feature and repeat, in which that feature's values change places within their key by a hash. What
    is copied is as many times the rows as there are features and repeats; no key's values leave their key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "feature", F.col("rep").cast("string"), F.col(key).cast("string"), F.col("dt").cast("string")))
    own = rows.withColumn("_i", F.row_number().over(by_time(key)))
    grid = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    value = F.lit(None).cast("double")
    for f in features:
        value = F.when(F.col("feature") == f, F.col(f).cast("double")).otherwise(value)
    other = grid.select(key, "feature", "rep", value.alias("_v"), F.row_number().over(Window.partitionBy(key, "feature", "rep").orderBy(order, "dt")).alias("_i"))
    joined = grid.join(other, [key, "feature", "rep", "_i"])
    return joined.withColumns({f: F.when(F.col("feature") == f, F.col("_v")).otherwise(F.col(f)) for f in features}).drop("_v", "_i")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], repeats: int = 5, score: str = "neg_mse", key: str = "asset", scores: dict = SCORES) -> DataFrame:
    """(feature, drop, std, place): how much a score falls when a feature's values change places, the mean over repeats; the greatest first."""
    measure = scores[score](F.col("y"), F.col("p"))
    base = model.transform(rows).agg(measure.alias("_base"))
    each = model.transform(shuffled(rows, features, repeats, key)).groupBy("feature", "rep").agg(measure.alias("_s"))
    drops = each.crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("_base") - F.col("_s")).alias("drop"), F.stddev_pop("_s").alias("std"))
    return drops.withColumn("place", F.row_number().over(Window.orderBy(F.desc("drop"), "feature")))


# ---- stacking ---------------------------------------------------------------------------------------------------------------


class Stack:
    """Base models of all training rows, and the weights (a constant first) that a linear model gives to their out-of-fold predictions."""

    def __init__(self, bases: dict[str, PipelineModel], beta: list[float]):
        self.bases, self.beta = bases, beta

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` with p."""
        out, names = rows, list(self.bases)
        for n in names:
            out = self.bases[n].transform(out).withColumnRenamed("p", f"_p_{n}").drop("_k", "_o", "_x")
        p: Column = F.lit(self.beta[0])
        for n, b in zip(names, self.beta[1:], strict=True):
            p = p + b * F.col(f"_p_{n}")
        return out.withColumn("p", p).drop(*[f"_p_{n}" for n in names])

    def save(self, spark: SparkSession, folder: str, name: str) -> None:
        """A version of each base, and the stack's own row, which names them."""
        parts = {n: af.save_model(spark, m, folder, f"{name}-{n}") for n, m in self.bases.items()}
        about = {"bases": json.dumps(parts), "beta": json.dumps(self.beta)}
        af.save_model(spark, PipelineModel([]), folder, name, parameters=about)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, name: str) -> Stack:
        about = af.catalogue(spark, folder).where((F.col("name") == name) & (F.col("version") == af.latest(spark, folder, name))).first()["parameters"]
        return cls({n: af.load_model(spark, folder, f"{name}-{n}", v) for n, v in json.loads(about["bases"]).items()}, json.loads(about["beta"]))


def fit_stack(table: DataFrame, splits: DataFrame, models: list[str], features: list[str], key: str = "asset") -> Stack:
    """Bases are fitted on all rows; the weights on predictions of rows that the predicting model has not seen."""
    rows = kept(table.select(key, "dt", "y", *features))
    oof = cross_validate(rows, splits, models, features, key)
    wide = oof.groupBy(key, "fold", "dt").pivot("model", models).agg(F.first("p")).join(oof.select(key, "fold", "dt", "y").distinct(), [key, "fold", "dt"])
    beta = ln.least_squares(wide.withColumn("_all", F.lit(1)), "y", models, ["_all"]).first()["beta"]
    return Stack({m: pipeline(m, features, key).fit(rows) for m in models}, list(beta))
