"""Regressions, distributions, bootstraps, transforms, agents and pooled models against numpy and plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import special as sp
from loomspan.operators import forecasts as fc
from loomspan.operators import linear as ln
from loomspan.operators import panels as pn
from loomspan.operators import plugins as pl
from loomspan.operators import pooled as po
from loomspan.operators import ranks as rk
from loomspan.operators import resampling as bs
from loomspan.operators import research as rs
from loomspan.operators import stats as st
from loomspan.operators import studies as sd
from loomspan.operators import transforms as tf

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def panel(spark):
    """(asset, dt, y, x1 to x4): four assets of 420 days; x4 says little."""
    days = pd.date_range("2020-01-01", periods=420)
    rows = []
    for a in "ABCD":
        x = RNG.normal(size=(420, 4)) * [1, 3, 0.5, 1] + [0, 5, 0, 0]
        y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + x[:, 2] + 0.3 * RNG.normal(size=420) + ord(a) / 100
        rows += [(a, d.date(), float(t), *map(float, v)) for d, t, v in zip(days, y, x, strict=True)]
    return spark.createDataFrame(rows, "asset string, dt date, y double, x1 double, x2 double, x3 double, x4 double").cache()


XS = ["x1", "x2", "x3", "x4"]


def test_distributions(spark):
    z = [0.0, 0.3, -1.96, 5.5, 9.0]
    d = spark.createDataFrame([(x, float(df)) for x in z for df in (3, 30, 2400)], "z double, df double")
    got = d.select("z", "df", sp.normal_two_sided(F.col("z")).alias("n"), sp.t_two_sided(F.col("z"), F.col("df")).alias("t"), sp.f_upper(F.abs("z") + 0.1, F.lit(4), F.col("df")).alias("f")).collect()
    for r in got:
        assert r["n"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12)
        assert r["t"] == pytest.approx(st.t_two_sided(r["z"], r["df"]), abs=1e-9)
        assert r["f"] == pytest.approx(st.f_upper(abs(r["z"]) + 0.1, 4, r["df"]), abs=1e-9)


def test_least_squares_and_robust_errors(spark, panel):
    got = {(r["asset"], r["term"]): r for r in ln.factor_regression(panel, XS[:3], y="y").collect()}
    for a, g in panel.toPandas().groupby("asset"):
        x = np.column_stack([np.ones(len(g)), g[XS[:3]].to_numpy()])
        beta, *_ = np.linalg.lstsq(x, g["y"].to_numpy(), rcond=None)
        e = g["y"].to_numpy() - x @ beta
        inv = np.linalg.inv(x.T @ x)
        se = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv) * len(g) / (len(g) - 4))
        for i, t in enumerate(["const", *XS[:3]]):
            assert got[a, t]["beta"] == pytest.approx(beta[i]) and got[a, t]["se"] == pytest.approx(se[i])
    # A column that others explain gets 0, and the rest is as without it.
    twice = panel.withColumn("x5", 2 * F.col("x1") + 1)
    b = {r["asset"]: r["beta"] for r in ln.least_squares(twice, "y", ["x1", "x2", "x5"], ["asset"]).collect()}
    c = {r["asset"]: r["beta"] for r in ln.least_squares(panel, "y", ["x1", "x2"], ["asset"]).collect()}
    for a in b:
        assert b[a][3] == 0 and b[a][:3] == pytest.approx(c[a])


def test_inflation_selection(spark):
    base = RNG.normal(size=(300, 3))
    wide = np.column_stack([base, base[:, 0] + 0.05 * RNG.normal(size=300), base.sum(1) + 0.1 * RNG.normal(size=300)])
    names = list("abcde")
    days = pd.date_range("2021-01-01", periods=300)
    rows = spark.createDataFrame([(d.date(), n, float(v)) for d, row in zip(days, wide, strict=True) for n, v in zip(names, row, strict=True)], "dt date, asset string, r double")
    got = {r["asset"]: r["dropped"] for r in ln.inflation_selection(rows, names).collect()}
    assert sorted(n for n, k in got.items() if k is None) == sorted(st.drop_inflated(wide.T @ wide, names))
    vif = {r["asset"]: r["vif"] for r in ln.variance_inflation(rows, names).collect()}
    assert [vif[n] for n in names] == pytest.approx(st.inflation(wide.T @ wide))


def test_walk_forward_is_that_of_its_rows(spark, panel):
    new = {(r["asset"], r["dt"]): r["p"] for r in ln.walk_forward(panel, XS, every_months=2, horizon=7).collect()}
    old = {}
    for a, g in panel.toPandas().sort_values("dt").groupby("asset"):
        g = g.reset_index(drop=True)
        period = g["dt"].map(lambda d: (d.year * 12 + d.month - 1) // 2)
        for p in sorted(set(period)):
            now = g[period == p]
            seen = g.iloc[: max(0, now.index[0] - 7)]
            if len(seen) >= 100:
                m = fc.Linear().fit(seen[XS].to_numpy(), seen["y"].to_numpy())
                old |= {(a, d): v for d, v in zip(now["dt"], m.predict(now[XS].to_numpy()), strict=True)}
    assert new.keys() == old.keys() and len(new) > 1000
    assert all(new[k] == pytest.approx(old[k], abs=1e-9) for k in new)
    forest = sd.walk_forward(panel.where("asset = 'A'"), XS, "random_forest", every_months=6, horizon=7)  # the path that sees rows
    assert forest.count() > 200


def test_states_have_models_of_their_own(spark, panel):
    on = F.dayofmonth("dt") % 3 == 0
    flipped = panel.withColumn("on", on).withColumn("y", F.when(on, -F.col("y")).otherwise(F.col("y")))
    got = ln.walk_forward(flipped, XS[:3], least=50, l2=0.0, state="on", least_state=60).join(flipped, ["asset", "dt"]).where("dt > '2020-12-01'")
    assert got.agg(F.corr("p", "y")).first()[0] > 0.8
    few = ln.walk_forward(flipped, XS[:3], least=50, l2=0.0, state="on", least_state=10_000)
    pooled = ln.walk_forward(flipped, XS[:3], least=50, l2=0.0)
    assert few.exceptAll(pooled).count() == 0


def test_transforms_see_train_rows_alone(spark, panel):
    rows = pn.rows_of_split(panel, pn.expanding_splits(spark, 400, 2, 200, 60, 5))
    train, by = rows.where("role = 'train'"), ["asset", "fold"]
    changed = rows.withColumns({x: F.when(F.col("role") == "test", F.col(x) * 100 - 7).otherwise(F.col(x)) for x in [*XS, "y"]}).where("role = 'train'")
    for fit in (lambda t: tf.fit_components(t, XS, by, 2), lambda t: tf.fit_top_k(t, XS, by, 2)):
        assert fit(train).exceptAll(fit(changed)).count() == 0
    one = train.where("asset = 'A' and fold = 0").toPandas()
    z = (one[XS] - one[XS].mean()) / one[XS].std(ddof=0)
    values, vectors = np.linalg.eigh(np.corrcoef(z.T))
    got = tf.apply_components(rows, tf.fit_components(train, XS, by, 2), XS, by).where("asset = 'A' and fold = 0 and role = 'train'").orderBy("dt").collect()
    for k in (0, 1):
        want = z.to_numpy() @ vectors[:, -1 - k]
        assert abs(np.corrcoef([r["x"][k] for r in got], want)[0, 1]) == pytest.approx(1)
    assert sum(got[0]["x"][k] is not None for k in (0, 1)) == 2 and values.sum() == pytest.approx(4)
    chosen = tf.fit_top_k(train, XS, by, 2).where("chosen").groupBy("feature").count().collect()
    assert "x4" not in {r["feature"] for r in chosen}
    both = [tf.transformed_forecasts(panel, pn.expanding_splits(spark, 400, 2, 200, 60, 5), XS, kind, 3) for kind in ("components", "top_k")]
    assert all(f.agg(F.corr("p", "y")).first()[0] > 0.5 for f in both)


def test_bootstraps(spark, panel):
    r = panel.select("asset", "dt", (F.col("y") / 1000).alias("r")).where("asset < 'C'")
    whole = bs.block_bootstrap(r, "total", reps=3, block=500)  # a block of the whole series draws it as it is
    real = {x["asset"]: x["t"] for x in r.groupBy("asset").agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("t")).collect()}
    assert all(x["value"] == pytest.approx(real[x["asset"]]) for x in whole.collect())
    fall = bs.block_bootstrap(r, "max_drawdown", reps=2, block=500).collect()
    g = r.where("asset = 'A'").orderBy("dt").toPandas()["r"].add(1).cumprod()
    assert next(x["value"] for x in fall if x["asset"] == "A") == pytest.approx((g / g.cummax() - 1).min())
    a, b = (bs.block_bootstrap(r.repartition(n), "mean", reps=50, block=10, circular=True) for n in (2, 5))
    assert {(x["asset"], x["rep"], round(x["value"], 12)) for x in a.collect()} == {(x["asset"], x["rep"], round(x["value"], 12)) for x in b.collect()}
    means = bs.block_bootstrap(r, "mean", reps=400, block=1).where("asset = 'A'").agg(F.avg("value"), F.stddev("value")).first()
    x = r.where("asset = 'A'").toPandas()["r"]
    assert means[0] == pytest.approx(x.mean(), abs=4 * x.std() / math.sqrt(420 * 400)) and means[1] == pytest.approx(x.std() / math.sqrt(420), rel=0.15)


def test_ranks(spark):
    rows = [([3.0, 1.0, 3.0, 2.0, 3.0], [1.0, 2.0, 5.0, 5.0, 9.0]), ([1.0, 1.0], [2.0, 3.0])]
    got = spark.createDataFrame(rows, "x array<double>, y array<double>").select(rk.array_ranks(F.col("x")).alias("r"), rk.array_correlation(rk.array_ranks(F.col("x")), rk.array_ranks(F.col("y"))).alias("c")).collect()
    assert got[0]["r"] == [4.0, 1.0, 4.0, 2.0, 4.0] and got[1]["c"] is None
    assert got[0]["c"] == pytest.approx(pd.Series(rows[0][0]).rank().corr(pd.Series(rows[0][1]).rank()))


def test_adaptive_agent_is_the_loop(spark):
    ics = [None if k % 11 == 3 else float(v) for k, v in enumerate(RNG.normal(0, 0.2, 80))]
    days = pd.date_range("2020-01-01", periods=80)
    got = rs.adapted(spark.createDataFrame([("a", d.date(), v) for d, v in zip(days, ics, strict=True)], "agent string, dt date, ic double")).orderBy("dt").collect()
    c, b, seen = 0.6, 0.5, []
    for r, v in zip(got, ics, strict=True):
        last = [x for x in seen[-10:] if x is not None]
        recent = float(np.mean(last)) if last else 0.0
        c = min(c + 0.05, 0.95) if recent > 0.05 else max(c - 0.1, 0.1) if recent < -0.05 else c + (0.6 - c) * 0.1
        if len(seen) >= 5 and (m := np.mean([x or 0.0 for x in seen[-5:]])):
            b = min(b + 0.05, 0.9) if m > 0 else max(b - 0.05, 0.1)
        assert (r["confidence"], r["blend"]) == (pytest.approx(c), pytest.approx(b))
        seen.append(v)


def test_market_states(spark):
    rows = [(30.0, None, "defensive"), (20.0, -0.6, "defensive"), (10.0, -0.6, "balanced"), (10.0, 0.1, "risk_on"), (None, None, "balanced"), (25.0, -0.5, "balanced")]
    got = spark.createDataFrame(rows, "level double, spread double, want string").select("want", rs.market_state(F.col("level"), F.col("spread")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_registered_parts(spark, panel):
    pl.register(pl.SCORES, "worst", lambda y, p: -F.max(F.abs(y - p)))
    try:
        with pytest.raises(ValueError):
            pl.register(pl.SCORES, "worst", None)
        got = pl.scored(panel.withColumn("p", F.col("y") + 1), ["asset"], ["worst", "neg_mse"]).collect()
        assert all(r["worst"] == pytest.approx(-1) and r["neg_mse"] == pytest.approx(-1) for r in got)
    finally:
        del pl.SCORES["worst"]


def test_pooled_models(spark, panel, tmp_path):
    splits = pn.expanding_splits(spark, 400, 2, 200, 60, 5)
    oof = po.cross_validate(panel, splits, ["linear", "random_forest"], XS)
    assert all(r["ic"] > 0.7 for r in pl.scored(oof, ["model"], ["ic"]).collect())
    found = po.search(panel, splits, XS, [{"model": "ridge", "regParam": 10.0}, {"model": "ridge", "regParam": 1e-4}]).first()
    assert found["candidate"] == 1
    train, test = panel.where("dt < '2020-12-01'"), panel.where("dt >= '2020-12-01'")
    imp = po.permutation_importance(po.pipeline("linear", XS).fit(train), test, XS, 2).orderBy("place").collect()
    assert imp[-1]["feature"] == "x4" and imp[0]["drop"] > 10 * abs(imp[-1]["drop"])
    copies = po.shuffled(test, XS, 2)
    same = copies.groupBy("asset", "feature", "rep").agg(F.sum("x1").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums = {r["asset"]: r["s"] for r in test.groupBy("asset").agg(F.sum("x1").alias("s")).collect()}
    assert all(r["s"] == pytest.approx(sums[r["asset"]]) for r in same)  # values move, none is lost
    stack = po.fit_stack(train, splits.where("fold = 0"), ["linear", "decision_tree"], XS)
    stack.save(spark, str(tmp_path / "models"), "both")
    a, b = (m.transform(test).select("asset", "dt", F.round("p", 9).alias("p")) for m in (stack, po.Stack.load(spark, str(tmp_path / "models"), "both")))
    assert a.exceptAll(b).count() == 0 and a.join(test, ["asset", "dt"]).agg(F.corr("p", "y")).first()[0] > 0.8
    curve = po.learning_curve(panel, "ridge", XS, (0.1, 1.0)).orderBy("share").collect()
    assert curve[0]["n"] < curve[1]["n"] and curve[1]["test_rmse"] < 1
