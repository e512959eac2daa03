"""Queries that fit and apply forecast models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import forecasts as fc
from loomspan.operators import metrics as mt
from loomspan.operators import panels as pn
from loomspan.operators import returns as rt
from loomspan.operators import windows as wd
from loomspan.plans.series_queries import W
from loomspan.plans.views import prices

FEATURES = ["mom_21d", "mom_63d", "rel_strength", "vol_21d"]


_D = f"over ({W} rows between 13 preceding and current row)"
#: The features of `features` and the RSI by name, rows with a missing feature left out.
LONG = f"""
ft as (select dt, asset, px / lag(px, 21) over ({W}) - 1 mom_21d, px / lag(px, 63) over ({W}) - 1 mom_63d, px / first_value(px) over ({W}) gx,
  px - lag(px) over ({W}) d from prices),
vl as (select dt, asset, case when count(r) over w >= 10 then stddev_samp(r) over w end vol_21d from rets window w as ({W} rows between 20 preceding and current row)),
rs as (select dt, asset, case when count(d) {_D} >= 14 and avg(greatest(-d, 0)) {_D} > 0 then 1.0 end rsi_14 from ft),
ok as (select dt, asset, rsi_14 from ft join vl using (dt, asset) join rs using (dt, asset) where mom_63d is not null and vol_21d is not null),
lng as (select asset || '_' || f feature from ok, (select unnest(['mom_21d', 'mom_63d', 'rel_strength', 'vol_21d']) f) union all select asset || '_rsi_14' from ok where rsi_14 is not null)
""".strip()


def features(s, d) -> DataFrame:
    """(dt, asset, features...) without missing values."""
    p = prices(s, d)
    r = wd.rolling_volatility(rt.simple_returns(p, (1,)).select("asset", "dt", F.col("ret_1d").alias("r")), (21,))
    out = rt.momentum(p, (21, 63)).drop("px").join(rt.relative_strength(p).drop("px"), ["dt", "asset"]).join(r.select("asset", "dt", "vol_21d"), ["dt", "asset"])
    return out.dropna()


def labelled(s, d, horizon: int = 5) -> DataFrame:
    return pn.label_table(features(s, d), prices(s, d), horizon)


def oof(s, d, models=("ridge", "random_forest", "boosted")) -> DataFrame:
    return fc.cross_validate(labelled(s, d), pn.expanding_splits(s, 1500, 3, 300, 63), list(models), FEATURES)


def scores(s, d) -> DataFrame:
    return oof(s, d).groupBy("model", "asset").agg(F.count("y").alias("n"), F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"))


def register_all() -> None:
    register("cross_validation", lambda s, d: mt.prediction_metrics(oof(s, d), "model"))
    register("model_zoo", lambda s, d: mt.prediction_metrics(fc.cross_validate(labelled(s, d), pn.expanding_splits(s, 1500, 1, 300, 63), list(fc.MODELS), FEATURES), "model"))
    register("cv_weights", lambda s, d: pn.model_weights(scores(s, d)))
    register("bayesian_weights", lambda s, d: pn.bayesian_weights(scores(s, d).select("model", "asset", "n", F.lit(4).alias("k"), (F.col("rmse") * F.col("rmse")).alias("mse"))))
    register("weighted_ensemble", lambda s, d: pn.weighted_ensemble(oof(s, d), pn.model_weights(scores(s, d))))
    register("feature_importance", lambda s, d: fc.importance(labelled(s, d), "random_forest", FEATURES))
    register("permutation_importance", lambda s, d: fc.importance(labelled(s, d), "ridge", FEATURES, 10))
    register("learning_curve", lambda s, d: fc.learning_curve(labelled(s, d), "ridge", FEATURES))
    register("mutual_information", lambda s, d: fc.mutual_information(labelled(s, d), FEATURES))

    def scored(s, d):
        f = labelled(s, d)
        return fc.fit_predict(f.where("dt < '1998-01-01'"), f.where("dt >= '1998-01-01'").drop("y"), "ridge", FEATURES)

    register("asset_scoring", scored)

    def pca(s, d):
        out, shares = fc.principal_components(features(s, d), FEATURES)
        from pyspark.ml.functions import vector_to_array

        return out.select("dt", "asset", F.abs(vector_to_array("pca")[0]).alias("first_component"), F.lit(len(shares)).alias("kept"))

    register("principal_components", pca)

    def longf(s, d):
        rsi = wd.rsi_simple(prices(s, d)).select("dt", "asset", F.col("rsi").alias("rsi_14"))
        return pn.features_long(features(s, d).join(rsi, ["dt", "asset"]), [*FEATURES, "rsi_14"])

    own = "regexp_matches(feature, '_ret_|_vol_|_mom_|_rsi_')"
    rule = {"all": "true", "macro_only": f"not {own}", "mom_vol": "regexp_matches(feature, '_mom_|_vol_')", "macro_mom": f"(not {own} or contains(feature, '_mom_'))", "technical": "regexp_matches(feature, '_rsi_|_macd|_bb_|_ma_')"}
    for name, where in rule.items():
        query = lambda s, d, name=name: pn.feature_set(longf(s, d), name).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        register(f"feature_set_{name}", query, f"with {LONG} select feature, count(*) n from lng where {where} group by 1")
