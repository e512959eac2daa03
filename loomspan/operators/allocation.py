"""Covariance estimates and portfolio weights.

Moments come from Spark aggregations; what a solver sees is one small matrix a rebalance date, in an Arrow group or on the
driver. Quadratic programmes are solved by accelerated projected gradients: the feasible set's projection is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.config import DEFAULT
from loomspan.operators.windows import pairs

# ---- covariance ---------------------------------------------------------------------------------------------------------


def covariance_long(returns: DataFrame, days: int = DEFAULT.days) -> DataFrame:
    """(i, j, cov): annual sample covariance of each pair of assets over their common dates, both orders and the diagonal."""
    off = pairs(returns).groupBy("a", "b").agg((F.covar_samp("ra", "rb") * days).alias("cov"))
    diag = returns.groupBy(F.col("asset").alias("a")).agg((F.var_samp("r") * days).alias("cov")).select("a", F.col("a").alias("b"), "cov")
    both = off.unionByName(off.select(F.col("b").alias("a"), F.col("a").alias("b"), "cov")).unionByName(diag)
    return both.withColumnsRenamed({"a": "i", "b": "j"})


def nearest_psd(m: np.ndarray, eps: float = 1e-8, always: bool = False) -> np.ndarray:
    """Symmetrised; eigenvalues are raised to eps if any is below -eps, or always."""
    m = (m + m.T) / 2
    value, vector = np.linalg.eigh(m)
    if not always and value.min() >= -eps:
        return m
    out = vector * np.maximum(value, eps) @ vector.T
    return (out + out.T) / 2


def shrunk(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf: population covariance towards a scaled identity, by the optimal intensity."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    sq = x**2
    b2 = min(d2, ((sq.T @ sq).sum() / n - (s**2).sum()) / (n * p))
    k = 0.0 if d2 == 0 else b2 / d2
    return (1 - k) * s + k * mu * np.eye(p)


def ewma(x: np.ndarray, halflife: float = DEFAULT.ewma_halflife) -> np.ndarray:
    """Recursive mean and covariance from zero with weight 1 - exp(-ln 2 / halflife) for the new row."""
    a = 1 - math.exp(-math.log(2) / halflife)
    m, c = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
    for row in x:
        m = (1 - a) * m + a * row
        d = row - m
        c = (1 - a) * c + a * np.outer(d, d)
    return c


def robust(x: np.ndarray, share: float = 0.75, starts: int = 10, seed: int = 42) -> np.ndarray:
    """Minimum covariance determinant: the subset of rows with the smallest determinant, by concentration steps from seeded starts."""
    n, p = x.shape
    h = max(p + 1, int(n * share))
    rng, best = np.random.default_rng(seed), (math.inf, None)
    for _ in range(starts):
        rows = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(30):
            m, c = x[rows].mean(0), np.cov(x[rows].T, bias=True).reshape(p, p) + 1e-12 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if len(new) == len(rows) and (new == rows).all():
                break
            rows = new
        c = np.cov(x[rows].T, bias=True).reshape(p, p)
        det = np.linalg.slogdet(c + 1e-12 * np.eye(p))[1]
        if det < best[0]:
            best = (det, c)
    return best[1]


def denoised(cov: np.ndarray, n: int) -> np.ndarray:
    """Eigenvalues of the correlation below the random-matrix edge become their mean; the diagonal is restored."""
    s = np.sqrt(np.diag(cov))
    value, vector = np.linalg.eigh(cov / np.outer(s, s))
    edge = (1 + math.sqrt(len(cov) / n)) ** 2
    noise = value < edge
    if noise.any():
        value = np.where(noise, value[noise].mean(), value)
    c = vector * value @ vector.T
    d = np.sqrt(np.diag(c))
    return c / np.outer(d, d) * np.outer(s, s)


def diagonal_shrink(cov: np.ndarray, k: float = 0.3) -> np.ndarray:
    return (1 - k) * cov + k * np.diag(np.diag(cov))


def covariance(x: np.ndarray, method: str = "shrinkage", days: int = DEFAULT.days, halflife: float = DEFAULT.ewma_halflife) -> np.ndarray:
    how: dict[str, Callable[[np.ndarray], np.ndarray]] = {"sample": lambda x: np.cov(x.T).reshape(x.shape[1], -1), "shrinkage": shrunk, "ewma": lambda x: ewma(x, halflife), "robust": robust, "blend": lambda x: 0.3 * ewma(x, halflife) + 0.7 * shrunk(x)}
    return nearest_psd(how[method](x) * days)


# ---- programmes ---------------------------------------------------------------------------------------------------------


def project_box_sum(v: np.ndarray, lo, hi, total: float = 1.0) -> np.ndarray:
    """The nearest point of {lo <= w <= hi, sum w = total}: v less a shift, clipped; the shift is found by bisection."""
    lo, hi = np.broadcast_to(lo, v.shape), np.broadcast_to(hi, v.shape)
    a, b = (v - hi).min() - 1, (v - lo).max() + 1
    for _ in range(100):
        m = (a + b) / 2
        if np.clip(v - m, lo, hi).sum() > total:
            a = m
        else:
            b = m
    return np.clip(v - (a + b) / 2, lo, hi)


@dataclass
class Constraints:
    """Bounds, class caps and an L1 limit against held weights; every method returns the object, so calls chain."""

    n: int
    lo: np.ndarray = field(default=None)
    hi: np.ndarray = field(default=None)
    groups: list[tuple[np.ndarray, float]] = field(default_factory=list)
    held: np.ndarray | None = None
    limit: float | None = None

    def __post_init__(self):
        self.lo = np.zeros(self.n) if self.lo is None else np.broadcast_to(self.lo, self.n).astype(float)
        self.hi = np.full(self.n, DEFAULT.max_weight) if self.hi is None else np.broadcast_to(self.hi, self.n).astype(float)
        if self.hi.sum() < 1:
            self.hi = np.full(self.n, 1.0)

    def box(self, lo, hi):
        return Constraints(self.n, lo, hi, self.groups, self.held, self.limit)

    def group(self, members, cap: float):
        mask = np.zeros(self.n, bool)
        mask[list(members)] = True
        return Constraints(self.n, self.lo, self.hi, [*self.groups, (mask, cap)], self.held, self.limit)

    def turnover(self, held, limit: float = DEFAULT.max_turnover):
        return Constraints(self.n, self.lo, self.hi, self.groups, np.asarray(held, float), limit)

    def project(self, v: np.ndarray) -> np.ndarray:
        """Dykstra's alternating projections over the sets; one projection when only the box and the sum are there."""
        sets = [lambda x: project_box_sum(x, self.lo, self.hi)]
        for mask, cap in self.groups:
            sets.append(lambda x, m=mask, c=cap: np.where(m, x - max(0.0, x[m].sum() - c) / m.sum(), x))
        if self.held is not None:
            sets.append(self._ball)
        if len(sets) == 1:
            return sets[0](v)
        x, left = v, [np.zeros(self.n) for _ in sets]
        for _ in range(300):
            old = x
            for k, f in enumerate(sets):
                y = f(x + left[k])
                left[k] = x + left[k] - y
                x = y
            if np.abs(x - old).max() < 1e-12:
                break
        return x

    def _ball(self, x: np.ndarray) -> np.ndarray:
        d = x - self.held
        if np.abs(d).sum() <= self.limit:
            return x
        u = np.sort(np.abs(d))[::-1]
        k = np.arange(1, len(u) + 1)
        t = ((np.cumsum(u) - self.limit) / k)[(u * k > np.cumsum(u) - self.limit).nonzero()[0][-1]]
        return self.held + np.sign(d) * np.maximum(np.abs(d) - t, 0)


def minimise(gradient: Callable, step: float, rules: Constraints, start: np.ndarray | None = None, rounds: int = 2000, finish: Callable | None = None) -> np.ndarray:
    """Accelerated projected gradients with restarts. finish(x), asked now and then, is the optimum if x tells which one it is, else None."""
    x = rules.project(np.full(rules.n, 1 / rules.n) if start is None else start)
    y, t = x, 1.0
    for k in range(rounds):
        new = rules.project(y - step * gradient(y))
        if finish and k % 20 == 19 and (done := finish(new)) is not None:
            return done
        if (y - new) @ (new - x) > 0:
            t = 1.0
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        if np.abs(new - x).max() < 1e-11:
            return new
        x, t = new, s
    return x


def _largest(cov: np.ndarray) -> float:
    return max(1e-12, float(np.linalg.eigvalsh(cov)[-1]))


def mean_variance(mu, cov, aversion: float = 2.0, rules: Constraints | None = None) -> np.ndarray:
    """Largest mu w - aversion / 2 w S w."""
    rules, mu, cov = rules or Constraints(len(mu)), np.asarray(mu, float), np.asarray(cov, float)

    def finish(x: np.ndarray) -> np.ndarray | None:
        """The optimum with x's assets at bounds, if it is feasible and no asset at a bound would rather leave it."""
        free = (x > rules.lo + 1e-6) & (x < rules.hi - 1e-6)
        n, w = int(free.sum()), np.where(free, 0.0, np.where(x <= rules.lo + 1e-6, rules.lo, rules.hi))
        if not n:
            return None
        system = np.zeros((n + 1, n + 1))
        system[:n, :n], system[n, :n], system[:n, n] = aversion * cov[np.ix_(free, free)], 1, 1
        try:
            got = np.linalg.solve(system, np.append(mu[free] - aversion * cov[free] @ w, 1 - w.sum()))
        except np.linalg.LinAlgError:
            return None
        w[free] = got[:n]
        slack = mu - aversion * cov @ w - got[n]
        inside = (w >= rules.lo - 1e-9).all() and (w <= rules.hi + 1e-9).all()
        return np.clip(w, rules.lo, rules.hi) if inside and (slack[~free & (w <= rules.lo)] <= 1e-9).all() and (slack[~free & (w >= rules.hi)] >= -1e-9).all() else None

    plain = not rules.groups and rules.held is None
    return minimise(lambda w: aversion * cov @ w - mu, 1 / max(1e-9, aversion * _largest(cov)), rules, finish=finish if plain else None)


def minimum_variance(cov, rules: Constraints | None = None) -> np.ndarray:
    return mean_variance(np.zeros(len(cov)), cov, 1.0, rules)


def max_sharpe(mu, cov, rf: float = 0.0, rules: Constraints | None = None) -> np.ndarray | None:
    """Largest (mu - rf) w / vol: each step solves a mean-variance problem at the present ratio. None if nothing beats rf."""
    excess = np.asarray(mu) - rf
    if excess.max() <= 0:
        return None
    rules, w = rules or Constraints(len(mu)), None
    aversion = 1.0
    for _ in range(60):
        new = mean_variance(excess, cov, aversion, rules)
        var = new @ cov @ new
        gain = excess @ new
        if var <= 0 or gain <= 0:
            return new
        if w is not None and np.abs(new - w).max() < 1e-9:
            break
        w, aversion = new, gain / var
    return w


def max_diversification(cov, rules: Constraints | None = None) -> np.ndarray:
    return max_sharpe(np.sqrt(np.diag(cov)), cov, 0.0, rules)


def robust_mean_variance(mu, cov, eps_mu: float = 0.05, eps_cov: float = 0.01, aversion: float = 2.0, rules: Constraints | None = None) -> np.ndarray:
    """Against the worst mean within eps_mu of mu, with eps_cov added to the variances."""
    s = cov + eps_cov * np.eye(len(cov))
    grad = lambda w: aversion * s @ w - mu + eps_mu * w / max(1e-9, float(np.linalg.norm(w)))
    return minimise(grad, 1 / (aversion * _largest(s) + eps_mu * math.sqrt(len(mu))), rules or Constraints(len(mu)))


def min_cvar(x: np.ndarray, alpha: float = 0.95, rules: Constraints | None = None, rounds: int = 3000) -> np.ndarray:
    """Smallest mean of the worst 1 - alpha scenarios, by projected subgradients with averaged iterates."""
    rules = rules or Constraints(x.shape[1])
    k = max(1, math.ceil(round(len(x) * (1 - alpha), 9)))
    w = rules.project(np.full(x.shape[1], 1 / x.shape[1]))
    best = (math.inf, w)
    scale = 1 / max(1e-12, np.abs(x).mean())
    for i in range(rounds):
        loss = -(x @ w)
        worst = np.argpartition(loss, -k)[-k:]
        value = loss[worst].mean()
        if value < best[0]:
            best = (value, w)
        w = rules.project(w + 0.1 * scale / (i + 10) * x[worst].mean(0))
    return best[1]


def risk_parity(cov, budget=None, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Risk shares equal to the budget: the minimum of w S w / 2 - sum b ln w, one coordinate at a time, from inverse volatility."""
    n = len(cov)
    b = np.full(n, 1 / n) if budget is None else np.asarray(budget, float) / np.sum(budget)
    w = 1 / np.sqrt(np.diag(cov))
    w = w / math.sqrt(w @ cov @ w)
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            c = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (math.sqrt(c * c + 4 * cov[i, i] * b[i]) - c) / (2 * cov[i, i])
        if np.abs(w - old).max() < tol * w.max():
            break
    return w / w.sum()


def inverse_volatility(cov) -> np.ndarray:
    v = 1 / np.sqrt(np.diag(cov))
    return v / v.sum()


def hierarchical(x: np.ndarray) -> np.ndarray:
    """Single-linkage order of assets on sqrt((1 - rho) / 2), then halves share weight by inverse cluster variance."""
    cov, n = np.cov(x.T).reshape(x.shape[1], -1), x.shape[1]
    s = np.sqrt(np.diag(cov))
    d = np.sqrt(np.maximum(0, 0.5 * (1 - cov / np.outer(s, s))))
    clusters = [[i] for i in range(n)]
    while len(clusters) > 1:
        gap, i, j = min((d[np.ix_(a, b)].min(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        joined = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [joined]
    w, todo = np.ones(n), [clusters[0]]

    def variance(c):
        sub = cov[np.ix_(c, c)]
        v = 1 / np.diag(sub)
        v = v / v.sum()
        return v @ sub @ v

    while todo:
        c = todo.pop()
        if len(c) < 2:
            continue
        a, b = c[: len(c) // 2], c[len(c) // 2 :]
        va, vb = variance(a), variance(b)
        w[a] *= vb / (va + vb)
        w[b] *= va / (va + vb)
        todo += [a, b]
    return w / w.sum()


def implied_returns(cov, market, aversion: float = 2.5) -> np.ndarray:
    return aversion * cov @ market


def black_litterman(cov, market, p, q, tau: float = 0.05, aversion: float = 2.5, confidence=None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance; a view's variance is tau p S p, times 1 / confidence - 1 where given."""
    pi = implied_returns(cov, market, aversion)
    p, q = np.atleast_2d(p), np.asarray(q, float)
    omega = np.diag(np.diag(p @ (tau * cov) @ p.T))
    if confidence is not None:
        omega = omega * np.diag(1 / np.clip(confidence, 0.01, 0.99) - 1)
    a = np.linalg.inv(tau * cov)
    b = np.linalg.pinv(omega)
    post = np.linalg.inv(a + p.T @ b @ p)
    return post @ (a @ pi + p.T @ b @ q), cov + post


def clip_and_normalise(w, lo: float = 0.0, hi: float = DEFAULT.max_weight, rounds: int = 5) -> np.ndarray:
    for _ in range(rounds):
        w = np.clip(w, lo, hi)
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    return w


def frontier(mu, cov, points: int = 50, rules: Constraints | None = None) -> pd.DataFrame:
    rows = []
    for g in np.geomspace(0.1, 50, points):
        w = mean_variance(mu, cov, g, rules)
        rows.append((g, mu @ w, math.sqrt(w @ cov @ w)))
    return pd.DataFrame(rows, columns=["aversion", "ret", "vol"]).sort_values("vol", ignore_index=True)


STRATEGIES: dict[str, Callable] = {
    "mean_variance": lambda mu, cov, x: mean_variance(mu, cov),
    "min_variance": lambda mu, cov, x: minimum_variance(cov),
    "max_sharpe": lambda mu, cov, x: max_sharpe(mu, cov),
    "max_diversification": lambda mu, cov, x: max_diversification(cov),
    "robust": lambda mu, cov, x: robust_mean_variance(mu, cov),
    "cvar": lambda mu, cov, x: min_cvar(x),
    "risk_parity": lambda mu, cov, x: risk_parity(cov),
    "hierarchical": lambda mu, cov, x: hierarchical(x),
    "inverse_vol": lambda mu, cov, x: inverse_volatility(cov),
    "equal_weight": lambda mu, cov, x: np.full(len(mu), 1 / len(mu)),
}


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as a shuffle has: a given number isn't coalesced, and a few small rows may cost much to solve."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def allocate(returns: DataFrame, dates: DataFrame, strategies: list[str] | None = None, lookback: int = DEFAULT.lookback, method: str = "shrinkage", least: int = 20, days: int = DEFAULT.days, strategy_fns: dict[str, Callable] | None = None) -> DataFrame:
    """(strategy, dt, asset, weight) for each rebalance date: a date's window and a strategy are one Arrow group, and all solve in parallel.

    dates: (dt, i) numbered rows of the calendar. A window is `lookback` rows before the date, for assets with a return on a fifth of
    them or more; on the others they stand still."""
    fns = STRATEGIES | (strategy_fns or {})
    names = strategies or list(fns)
    calendar = returns.select("dt").distinct()
    from pyspark.sql import Window

    calendar = calendar.withColumn("j", F.row_number().over(Window.orderBy("dt")) - 1)
    at = dates.select(F.col("dt").alias("on")).join(calendar.select(F.col("dt").alias("on"), F.col("j").alias("i")), "on")
    panel = returns.join(calendar, "dt")
    window = panel.join(F.broadcast(at), (F.col("j") < F.col("i")) & (F.col("j") >= F.col("i") - lookback))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, on = pdf["strategy"].iloc[0], pdf["on"].iloc[0]
        wide = pdf.pivot_table(index="j", columns="asset", values="r", aggfunc="first").sort_index()
        wide = wide.loc[:, wide.notna().mean() >= 0.2].fillna(0.0)
        out = []
        if len(wide) >= least and wide.shape[1]:
            x = wide.to_numpy(float)
            mu = x.mean(0) * days
            w = fns[name](mu, covariance(x, method, days), x)
            w = np.full(len(mu), 1 / len(mu)) if w is None else w
            out = [(name, on, a, float(v)) for a, v in zip(wide.columns, w, strict=True)]
        return pd.DataFrame(out, columns=["strategy", "dt", "asset", "weight"])

    each = window.select("on", "j", "asset", "r", F.explode(F.array(*map(F.lit, names))).alias("strategy"))
    # A row a strategy, date and asset: kept, as a backtest reads its targets several times and would solve anew.
    return dealt(each, "on", "strategy").groupBy("on", "strategy").applyInPandas(run, "strategy string, dt date, asset string, weight double").persist()


# ---- statistics of given weights, in SQL --------------------------------------------------------------------------------


def risk_table(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """weights: (name, asset, weight); cov: (i, j, cov). Adds each asset's marginal and component risk and its share."""
    w = weights.select("name", F.col("asset").alias("j"), F.col("weight").alias("_wj"))
    sw = cov.join(w, "j").groupBy("name", "i").agg(F.sum(F.col("cov") * F.col("_wj")).alias("_sw"))
    out = weights.join(sw.withColumnRenamed("i", "asset"), ["name", "asset"])
    var = out.groupBy("name").agg(F.sum(F.col("weight") * F.col("_sw")).alias("_v"))
    out = out.join(var, "name")
    return out.select("name", "asset", "weight", F.sqrt("_v").alias("vol"), (F.col("_sw") / F.sqrt("_v")).alias("marginal"), (F.col("weight") * F.col("_sw") / F.sqrt("_v")).alias("component"), (F.col("weight") * F.col("_sw") / F.col("_v")).alias("share"))


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.0) -> DataFrame:
    """Return, volatility, Sharpe, diversification ratio, effective bets (entropy of risk shares), Herfindahl index."""
    own = cov.where(F.col("i") == F.col("j")).select(F.col("i").alias("asset"), F.sqrt("cov").alias("_s"))
    t = risk_table(weights, cov).join(mu.select("asset", "mu"), "asset").join(own, "asset")
    s = F.col("share")
    return t.groupBy("name").agg(
        F.sum(F.col("weight") * F.col("mu")).alias("ret"),
        F.first("vol").alias("vol"),
        ((F.sum(F.col("weight") * F.col("mu")) - rf) / F.first("vol")).alias("sharpe"),
        (F.sum(F.col("weight") * F.col("_s")) / F.first("vol")).alias("diversification"),
        F.exp(-F.sum(F.when(s > 0, s * F.ln(s)).otherwise(0.0))).alias("effective_bets"),
        F.sum(F.col("weight") * F.col("weight")).alias("herfindahl"),
    )


def attribution(weights: DataFrame, returns: DataFrame, days: int = DEFAULT.days) -> DataFrame:
    """weights: (dt, asset, weight). Against equal weights: allocation of each asset, and a TOTAL row."""
    own = returns.groupBy("asset").agg((F.avg("r") * days).alias("ar")).crossJoin(returns.agg(F.count_distinct("asset").alias("_n")))
    mean = weights.groupBy("asset").agg(F.avg("weight").alias("pw")).join(own, "asset")
    mean = mean.withColumn("bw", 1 / F.col("_n"))
    total = mean.agg(F.sum(F.col("bw") * F.col("ar")).alias("_br"))
    out = mean.crossJoin(F.broadcast(total)).withColumn("allocation", (F.col("pw") - F.col("bw")) * (F.col("ar") - F.col("_br")))
    return out.rollup("asset").agg(F.sum("pw").alias("pw"), F.sum("bw").alias("bw"), F.sum("allocation").alias("allocation"), F.lit(0.0).alias("selection"), F.lit(0.0).alias("interaction")).withColumn("asset", F.coalesce("asset", F.lit("TOTAL")))
