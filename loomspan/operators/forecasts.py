"""Forecast models over panels: Spark ML where it has the estimator, numpy kernels in Arrow groups for those it lacks.

An asset's rows are one group (its history); assets, folds and candidates run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.panels import rows_of_split


class Linear:
    """Least squares with L2 and L1 penalties on standardised columns, by coordinate descent (closed form without L1)."""

    def __init__(self, l2: float = 1.0, l1: float = 0.0, rounds: int = 200):
        self.l2, self.l1, self.rounds = l2, l1, rounds

    def fit(self, x, y):
        self.mx, self.sx = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        self.my, z = y.mean(), (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        n, p = z.shape
        g, c = z.T @ z / n, z.T @ (y - self.my) / n
        if self.l1 == 0:
            self.w = np.linalg.solve(g + self.l2 / n * np.eye(p) + 1e-12 * np.eye(p), c)
            return self
        w = np.zeros(p)
        for _ in range(self.rounds):
            old = w.copy()
            for j in range(p):
                r = c[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(r) * max(0.0, abs(r) - self.l1) / (g[j, j] + self.l2 / n + 1e-12)
            if np.abs(w - old).max() < 1e-10:
                break
        self.w = w
        return self

    def predict(self, x):
        return self.my + (x - self.mx) / self.sx @ self.w

    @property
    def importance(self):
        return np.abs(self.w)


class Tree:
    """Regression tree over quantile bins; every split is the best by squared error over a seeded choice of columns."""

    def __init__(self, depth: int = 3, least: int = 5, share: float = 1.0, bins: int = 16, seed: int = 42):
        self.depth, self.least, self.share, self.bins, self.rng = depth, least, share, bins, np.random.default_rng(seed)

    def fit(self, x, y, w=None):
        self.importance = np.zeros(x.shape[1])
        w = np.ones(len(y)) if w is None else w
        self.root = self._grow(x, y, w, self.depth)
        return self

    def _grow(self, x, y, w, depth):
        mean = float((w * y).sum() / max(1e-300, w.sum()))
        if depth == 0 or len(y) < 2 * self.least or np.ptp(y) == 0:
            return mean
        p = x.shape[1]
        best = (1e-12, -1, 0.0)
        for j in self.rng.permutation(p)[: max(1, int(np.ceil(p * self.share)))]:
            edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]))
            b = np.searchsorted(edges, x[:, j], "left")
            sw, sy, n = (np.bincount(b, v, len(edges) + 1) for v in (w, w * y, np.ones(len(y))))
            cw, cy, cn = np.cumsum(sw)[:-1], np.cumsum(sy)[:-1], np.cumsum(n)[:-1]
            rw, ry = w.sum() - cw, (w * y).sum() - cy
            ok = (cn >= self.least) & (len(y) - cn >= self.least)
            gain = np.where(ok, cy**2 / np.maximum(cw, 1e-300) + ry**2 / np.maximum(rw, 1e-300), -np.inf) - (w * y).sum() ** 2 / w.sum()
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), int(j), float(edges[int(gain.argmax())]))
        if best[1] < 0:
            return mean
        self.importance[best[1]] += best[0]
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], w[left], depth - 1), self._grow(x[~left], y[~left], w[~left], depth - 1)

    def predict(self, x):
        out = np.empty(len(x))

        def walk(node, rows):
            if not isinstance(node, tuple):
                out[rows] = node
                return
            left = x[rows, node[0]] <= node[1]
            walk(node[2], rows[left])
            walk(node[3], rows[~left])

        walk(self.root, np.arange(len(x)))
        return out


class Bagged:
    """Mean of trees on seeded draws of rows."""

    def __init__(self, trees: int = 25, depth: int = 5, share: float = 0.33, seed: int = 42):
        self.trees, self.depth, self.share, self.seed = trees, depth, share, seed

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        self.members = []
        for k in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            self.members.append(Tree(self.depth, share=self.share, seed=self.seed + k).fit(x[rows], y[rows]))
        self.importance = sum(t.importance for t in self.members)
        return self

    def predict(self, x):
        return np.mean([t.predict(x) for t in self.members], 0)


class Boosted:
    """Trees on residuals; rate scales each."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.1, share: float = 1.0, seed: int = 42):
        self.trees, self.depth, self.rate, self.share, self.seed = trees, depth, rate, share, seed

    def fit(self, x, y):
        self.start, self.members, left = float(y.mean()), [], y - y.mean()
        for k in range(self.trees):
            t = Tree(self.depth, share=self.share, seed=self.seed + k).fit(x, left)
            left = left - self.rate * t.predict(x)
            self.members.append(t)
        self.importance = sum(t.importance for t in self.members)
        return self

    def predict(self, x):
        return self.start + self.rate * sum(t.predict(x) for t in self.members)


class AdaBoosted:
    """Weighted median of trees; rows that are badly fitted weigh more in the next (linear loss)."""

    def __init__(self, trees: int = 20, depth: int = 3, seed: int = 42):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x, y):
        w, self.members = np.full(len(y), 1 / len(y)), []
        for k in range(self.trees):
            t = Tree(self.depth, seed=self.seed + k).fit(x, y, w)
            e = np.abs(t.predict(x) - y)
            if e.max() <= 0:
                self.members.append((t, 1.0))
                break
            loss = float((w * e / e.max()).sum())
            if loss >= 0.5 and self.members:
                break
            b = max(loss, 1e-9) / (1 - min(loss, 0.499))
            self.members.append((t, np.log(1 / b)))
            w = w * b ** (1 - e / e.max())
            w = w / w.sum()
        self.importance = sum(t.importance for t, _ in self.members)
        return self

    def predict(self, x):
        p, w = np.array([t.predict(x) for t, _ in self.members]), np.array([a for _, a in self.members])
        order = np.argsort(p, 0)
        cum = np.cumsum(w[order], 0)
        return np.take_along_axis(p, np.take_along_axis(order, (cum >= cum[-1] / 2).argmax(0)[None], 0), 0)[0]


class SupportVector:
    """Kernel regression with an insensitive tube, in random Fourier features, by averaged subgradients."""

    def __init__(self, cost: float = 1.0, tube: float = 0.1, features: int = 100, rounds: int = 300, seed: int = 42):
        self.cost, self.tube, self.features, self.rounds, self.seed = cost, tube, features, rounds, seed

    def _map(self, x):
        z = (x - self.mx) / self.sx
        return np.sqrt(2 / self.features) * np.cos(z @ self.a + self.b)

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        self.mx, self.sx = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        self.my, self.sy = y.mean(), max(1e-12, y.std())
        self.a = rng.normal(0, np.sqrt(1 / x.shape[1]), (x.shape[1], self.features))
        self.b = rng.uniform(0, 2 * np.pi, self.features)
        z, t = self._map(x), (y - self.my) / self.sy
        w, mean = np.zeros(self.features), np.zeros(self.features)
        for k in range(1, self.rounds + 1):
            e = t - z @ w
            g = w / (self.cost * len(t)) - z.T @ (np.sign(e) * (np.abs(e) > self.tube)) / len(t)
            w = w - 2.0 / np.sqrt(k) * g
            mean += (w - mean) / k
        self.w = mean
        return self

    def predict(self, x):
        return self.my + self.sy * (self._map(x) @ self.w)


class Perceptron:
    """One hidden layer of rectified units, full-batch Adam from seeded weights."""

    def __init__(self, hidden: int = 32, rounds: int = 200, rate: float = 0.01, l2: float = 1e-3, seed: int = 42):
        self.hidden, self.rounds, self.rate, self.l2, self.seed = hidden, rounds, rate, l2, seed

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        self.mx, self.sx = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        self.my, self.sy = y.mean(), max(1e-12, y.std())
        z, t, p = (x - self.mx) / self.sx, (y - self.my) / self.sy, x.shape[1]
        w = [rng.normal(0, np.sqrt(2 / p), (p, self.hidden)), np.zeros(self.hidden), rng.normal(0, np.sqrt(1 / self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for k in range(1, self.rounds + 1):
            h = np.maximum(0, z @ w[0] + w[1])
            e = (h @ w[2] + w[3] - t) * 2 / len(t)
            back = np.outer(e, w[2]) * (h > 0)
            for i, g in enumerate((z.T @ back + self.l2 * w[0], back.sum(0), h.T @ e + self.l2 * w[2], e.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - self.rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        self.w = w
        return self

    def predict(self, x):
        return self.my + self.sy * (np.maximum(0, (x - self.mx) / self.sx @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


class Stacked:
    """A linear model over out-of-fold predictions of base models; folds are blocks of time, each fitted on what is before it."""

    def __init__(self, bases: tuple[str, ...] = ("ridge", "random_forest", "boosted"), folds: int = 3):
        self.bases, self.folds = bases, folds

    def fit(self, x, y):
        cuts = np.linspace(0, len(y), self.folds + 2).astype(int)
        held = [(slice(0, a), slice(a, b)) for a, b in zip(cuts[1:-1], cuts[2:], strict=True)]
        oof = np.concatenate([np.stack([MODELS[m]().fit(x[t], y[t]).predict(x[v]) for m in self.bases], 1) for t, v in held])
        self.top = Linear().fit(oof, y[cuts[1] :])
        self.fitted = [MODELS[m]().fit(x, y) for m in self.bases]
        return self

    def predict(self, x):
        return self.top.predict(np.stack([m.predict(x) for m in self.fitted], 1))


MODELS: dict[str, Callable] = {
    "ridge": lambda: Linear(1.0),
    "lasso": lambda: Linear(0.0, 1e-4),
    "elastic_net": lambda: Linear(0.5, 5e-5),
    "random_forest": Bagged,
    "bagging": lambda: Bagged(share=1.0),
    "gradient_boosting": lambda: Boosted(40, 4),
    "boosted": Boosted,
    "boosted_columns": lambda: Boosted(share=0.5),
    "svr": SupportVector,
    "mlp": Perceptron,
    "adaboost": AdaBoosted,
    "stacking": Stacked,
}


def spark_estimator(name: str, features: str = "features", label: str = "y"):
    """The Spark ML estimator for models that it has, for panels pooled over all assets."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    made = {
        "ridge": lambda: LinearRegression(regParam=1e-3, elasticNetParam=0.0),
        "lasso": lambda: LinearRegression(regParam=1e-4, elasticNetParam=1.0),
        "elastic_net": lambda: LinearRegression(regParam=1e-4, elasticNetParam=0.5),
        "random_forest": lambda: RandomForestRegressor(numTrees=50, maxDepth=5, seed=42),
        "gradient_boosting": lambda: GBTRegressor(maxIter=40, maxDepth=4, seed=42),
    }[name]()
    return made.setFeaturesCol(features).setLabelCol(label).setPredictionCol("p")


def cross_validate(table: DataFrame, splits: DataFrame, models: list[str], features: list[str], key: str = "asset") -> DataFrame:
    """(model, key, fold, dt, y, p): out-of-fold predictions. table: key, dt, y and features without nulls."""
    rows = rows_of_split(table, splits, key).crossJoin(F.broadcast(table.sparkSession.createDataFrame([(m,) for m in models], "model string")))
    kind = table.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        if len(train) < 20 or not len(test):
            return pd.DataFrame(columns=["model", key, "fold", "dt", "y", "p"])
        m = MODELS[pdf["model"].iloc[0]]().fit(train[features].to_numpy(float), train["y"].to_numpy(float))
        return test.assign(p=m.predict(test[features].to_numpy(float)))[["model", key, "fold", "dt", "y", "p"]]

    return rows.groupBy("model", key, "fold").applyInPandas(run, f"model string, {key} {kind}, fold long, dt date, y double, p double")


def fit_predict(train: DataFrame, score: DataFrame, model: str, features: list[str], key: str = "asset") -> DataFrame:
    """(key, dt, p): a model for each key, fitted on train and applied to score."""
    kind = train.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) < 20 or not len(b):
            return pd.DataFrame(columns=[key, "dt", "p"])
        a = a.sort_values("dt")
        m = MODELS[model]().fit(a[features].to_numpy(float), a["y"].to_numpy(float))
        return b.assign(p=m.predict(b[features].to_numpy(float)))[[key, "dt", "p"]]

    score = score.select([F.col(c).alias(c) for c in score.columns])  # the two sides may come from one frame
    return train.groupBy(key).cogroup(score.groupBy(key)).applyInPandas(run, f"{key} {kind}, dt date, p double")


def importance(table: DataFrame, model: str, features: list[str], repeats: int = 0, key: str = "asset") -> DataFrame:
    """(key, feature, value, share): the model's own importances, or the loss in squared error when a column is shuffled."""
    kind = table.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x, y = pdf[features].to_numpy(float), pdf["y"].to_numpy(float)
        m = MODELS[model]().fit(x, y)
        if repeats:
            rng, base = np.random.default_rng(42), ((m.predict(x) - y) ** 2).mean()
            v = np.zeros(len(features))
            for j in range(len(features)):
                for _ in range(repeats):
                    z = x.copy()
                    z[:, j] = rng.permutation(z[:, j])
                    v[j] += (((m.predict(z) - y) ** 2).mean() - base) / repeats
        else:
            v = np.asarray(m.importance, float)
        total = np.abs(v).sum() or 1.0
        return pd.DataFrame({key: pdf[key].iloc[0], "feature": features, "value": v, "share": v / total})

    return table.groupBy(key).applyInPandas(run, f"{key} {kind}, feature string, value double, share double")


def learning_curve(table: DataFrame, model: str, features: list[str], shares=(0.2, 0.4, 0.6, 0.8, 1.0), test: int = 63, key: str = "asset") -> DataFrame:
    """(key, share, train_rmse, test_rmse): the last `test` rows are held out; training takes the last share of the rest."""
    kind = table.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        x, y, rows = pdf[features].to_numpy(float), pdf["y"].to_numpy(float), []
        n = len(y) - test
        for s in shares:
            a = n - int(n * s)
            if n - a < 20:
                continue
            m = MODELS[model]().fit(x[a:n], y[a:n])
            err = lambda z, t, m=m: float(np.sqrt(((m.predict(z) - t) ** 2).mean()))
            rows.append((pdf[key].iloc[0], s, err(x[a:n], y[a:n]), err(x[n:], y[n:])))
        return pd.DataFrame(rows, columns=[key, "share", "train_rmse", "test_rmse"])

    return table.groupBy(key).applyInPandas(run, f"{key} {kind}, share double, train_rmse double, test_rmse double")


def principal_components(wide: DataFrame, names: list[str], variance: float = 0.95, most: int = 20) -> tuple[DataFrame, list[float]]:
    """wide with a vector `pca` of standardised columns' components that hold `variance`, and their shares."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    k = min(most, len(names))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="pca")]).fit(wide)
    shares = list(fitted.stages[-1].explainedVariance)
    keep = next((i + 1 for i in range(k) if sum(shares[: i + 1]) >= variance), k)
    return fitted.transform(wide).drop("_x", "_z"), shares[:keep]


def mutual_information(table: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of quantile-binned feature and label, by counting in Spark."""
    q = lambda c: F.expr(f"percentile_approx(`{c}`, array({', '.join(f'{i / bins}D' for i in range(1, bins))}), 10000)")
    edges = table.agg(*[q(c).alias(c) for c in [*features, "y"]]).first()
    cell = lambda c: sum((F.when(F.col(c) > float(e), 1).otherwise(0) for e in edges[c]), F.lit(0))
    long = table.select(cell("y").alias("b"), *[cell(c).alias(c) for c in features]).unpivot(["b"], features, "feature", "a")
    joint = long.groupBy("feature", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    n = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    a = joint.groupBy("feature", "a").agg(F.sum("n").alias("na"))
    b = joint.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    j = joint.join(n, "feature").join(a, ["feature", "a"]).join(b, ["feature", "b"])
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
