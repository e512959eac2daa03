"""Numeric kernels against closed forms and optimality conditions."""

import math

import numpy as np
import pytest

from loomspan.operators import allocation as al
from loomspan.operators import forecasts as fc
from loomspan.operators import stats as st

RNG = np.random.default_rng(42)
A = RNG.normal(size=(5, 5))
COV = A @ A.T + 0.01 * np.eye(5)
MU = np.array([0.08, 0.06, 0.10, 0.04, 0.07])
X = RNG.multivariate_normal(MU / 252, COV / 2520, 600)


def objective(w, g=2.0):
    return MU @ w - g / 2 * w @ COV @ w


@pytest.mark.parametrize("rules", [al.Constraints(5), al.Constraints(5).group([0, 1], 0.3), al.Constraints(5).turnover(np.full(5, 0.2), 0.1), al.Constraints(5).box(0.05, 0.5)])
def test_mean_variance_is_best(rules):
    w = al.mean_variance(MU, COV, 2.0, rules)
    assert w.sum() == pytest.approx(1, abs=1e-6) and (w >= rules.lo - 1e-7).all() and (w <= rules.hi + 1e-7).all()
    for mask, cap in rules.groups:
        assert w[mask].sum() <= cap + 1e-6
    if rules.held is not None:
        assert np.abs(w - rules.held).sum() <= rules.limit + 1e-6
    others = [rules.project(RNG.dirichlet(np.ones(5))) for _ in range(500)]
    assert objective(w) >= max(map(objective, others)) - 1e-7


def test_other_portfolios():
    base = al.Constraints(5)
    others = [base.project(RNG.dirichlet(np.ones(5))) for _ in range(500)]
    vol = lambda w: math.sqrt(w @ COV @ w)
    assert vol(al.minimum_variance(COV)) <= min(map(vol, others)) + 1e-7
    ms = al.max_sharpe(MU, COV)
    assert MU @ ms / vol(ms) >= max(MU @ w / vol(w) for w in others) - 1e-5
    assert al.max_sharpe(-MU, COV) is None
    rp = al.risk_parity(COV)
    share = rp * (COV @ rp)
    assert np.allclose(share / share.sum(), 0.2, atol=1e-6)
    h = al.hierarchical(X)
    assert h.sum() == pytest.approx(1) and (h > 0).all()
    tail = lambda w: np.sort(-(X @ w))[-30:].mean()
    assert tail(al.min_cvar(X)) <= min(map(tail, others)) + 1e-4
    post, _ = al.black_litterman(COV, np.full(5, 0.2), np.eye(5)[:1], [0.5])
    prior = al.implied_returns(COV, np.full(5, 0.2))
    assert abs(post[0] - 0.5) < abs(prior[0] - 0.5)
    f = al.frontier(MU, COV, 10)
    assert f["vol"].is_monotonic_increasing and (f["ret"].diff().dropna() >= -1e-6).all()


def test_covariances():
    for m in ("sample", "shrinkage", "ewma", "robust", "blend"):
        c = al.covariance(X, m)
        assert np.allclose(c, c.T) and np.linalg.eigvalsh(c).min() > 0
    assert np.allclose(np.diag(al.denoised(COV, 600)), np.diag(COV))
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    assert np.linalg.eigvalsh(al.nearest_psd(bad)).min() > 0
    assert al.clip_and_normalise(np.array([0.9, 0.1, 0.0])).sum() == pytest.approx(1)


def test_distributions_and_tests():
    assert st.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-8)
    assert st.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert st.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-5)
    walk, noise = np.cumsum(RNG.normal(size=500)), RNG.normal(size=500)
    # Tests of 5 % err on some draws: most of twenty must be right.
    draws = [np.random.default_rng(k).normal(size=500) for k in range(20)]
    for right in ([st.adf(d)[2] for d in draws], [not st.adf(np.cumsum(d))[2] for d in draws], [st.kpss(d)[1] for d in draws], [not st.kpss(np.cumsum(d))[1] for d in draws]):
        assert sum(right) >= 16
    y = np.roll(noise, 1) + 0.1 * RNG.normal(size=500)
    assert st.granger(noise, y)[2] < 1e-6 and st.granger(RNG.normal(size=500), RNG.normal(size=500))[2] > 1e-4
    assert st.cointegration(walk, 2 * walk + noise)[1]
    g = np.array([[1.0, 0.99, 0], [0.99, 1.0, 0], [0, 0, 1.0]])
    assert len(st.drop_inflated(g, ["a", "b", "c"])) == 2


@pytest.mark.parametrize("name", sorted(fc.MODELS))
def test_models_learn(name):
    x = RNG.normal(size=(400, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * RNG.normal(size=400)
    p = fc.MODELS[name]().fit(x[:300], y[:300]).predict(x[300:])
    assert np.corrcoef(p, y[300:])[0, 1] > 0.8


def test_views_and_covariance_ahead():
    from loomspan.operators import research as rs

    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.01, (500, 3)) @ np.array([[1, 0.2, 0], [0, 1, 0.3], [0, 0, 1]])
    cov, market = np.cov(x.T) * 252, np.full(3, 1 / 3)
    none = rs.view_weights(cov, market, np.eye(3)[:1], [2.5 * cov[0] @ market], rules=None)
    more = rs.view_weights(cov, market, np.eye(3)[:1], [2.5 * cov[0] @ market + 0.05])
    assert more[0] > none[0] and abs(more.sum() - 1) < 1e-9
    ahead = rs.forward_covariance(x, np.sqrt(np.diag(cov)))
    past = rs.forward_covariance(x, np.zeros(3), blend=0.0)
    assert np.linalg.eigvalsh(ahead).min() > -1e-12 and np.allclose(ahead, past, rtol=0.2)


def test_numbers_of_strings_with_a_common_prefix(spark):
    from pyspark.sql import functions as F

    from loomspan.operators import panels as pn

    rows = spark.range(5000).select(F.concat(F.lit("customer-000000"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"), (F.col("id") % 2).alias("k"))
    place, cuts = pn.cuts_of(rows, "id", 50)
    sizes = [r["count"] for r in rows.groupBy(F.size(F.filter(cuts, lambda c: c < place)).alias("b")).count().collect()]
    assert len(sizes) == 50 and max(sizes) < 3 * 5000 / 50
    got = {r["id"]: r["_no"] for r in pn.numbered(rows.repartition(7), "id", ["k"]).collect()}
    assert all(got[f"customer-000000{i:08d}"] == i // 2 for i in range(5000))
