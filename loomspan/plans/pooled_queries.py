"""Queries on models that are trained over panels pooled from all assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import metrics as mt
from loomspan.operators import panels as pn
from loomspan.operators import pooled as po
from loomspan.operators import plugins as pl
from loomspan.plans.linear_queries import LABELLED
from loomspan.plans.model_queries import FEATURES, labelled
from loomspan.plans.sql_parts import list_gram_sql, sweep_sql
from loomspan.sources import artefacts as af
from loomspan.sources.scratch import scratch

CUT = "1998-01-01"


def splits(s, folds=3):
    return pn.expanding_splits(s, 1500, folds, 300, 63)


def parts(s, d):
    """Labelled rows before and from a date on."""
    rows = po.kept(labelled(s, d))
    return rows.where(F.col("dt") < CUT), rows.where(F.col("dt") >= CUT)


def stored(s, d):
    """Test rows scored by a model that was written, made the latest and read again."""
    train, test = parts(s, d)
    folder = scratch(s)
    af.save_model(s, po.pipeline("linear", FEATURES).fit(train), folder, "returns", parameters={"model": "linear"})
    return af.load_model(s, folder, "returns").transform(test).select("asset", "dt", "y", "p")


def stacked(s, d):
    train, test = parts(s, d)
    return po.fit_stack(train, pn.expanding_splits(s, 900, 2, 300, 126), ["ridge", "decision_tree", "random_forest"], FEATURES).transform(test)


def importance(s, d):
    train, test = parts(s, d)
    return po.permutation_importance(po.pipeline("random_forest", FEATURES).fit(train), test, FEATURES)


CELLS = ", ".join(FEATURES)
#: Least squares with a constant for each asset: columns less their asset's mean, swept by fold.
WITHIN = f"""
mn as (select asset, fold, {', '.join(f'avg({c}) m_{c}' for c in FEATURES)}, avg(y) m_y from tr group by 1, 2),
cx as (select fold, row_number() over () as row, unnest([0, 1, 2, 3, 4]) i, unnest([{', '.join(f'{c} - m_{c}' for c in FEATURES)}, y - m_y]) v from tr join mn using (asset, fold)),
{list_gram_sql('cg', 'cx', 'fold')},
{sweep_sql('cs', 'cg', 'fold', 0, 4)},
cb as (select fold, {', '.join(f'max(v) filter (i = {i}) b{i}' for i in range(4))} from cs where j = 4 group by 1)""".strip()
SCORE = "m_y + " + " + ".join(f"b{i} * ({c} - m_{c})" for i, c in enumerate(FEATURES))


def register_all() -> None:
    models = ["linear", "lasso", "decision_tree", "random_forest", "gradient_boosting"]
    register("pooled_cross_validation", lambda s, d: pl.scored(po.cross_validate(labelled(s, d), splits(s, 2), models, FEATURES), ["model"], list(pl.SCORES)))
    sql = f"""with recursive {LABELLED},
tr as (select lt.*, fold from lt join (select f fold, 300 + f * 63 until from range(3) t(f)) on i < until),
te as (select lt.*, fold from lt join (select f fold, 305 + f * 63 a from range(3) t(f)) on i >= a and i < a + 63),
{WITHIN}
select 'linear' model, te.asset, te.fold, te.dt, y, {SCORE} p from te join mn using (asset, fold) join cb using (fold)"""
    register("pooled_linear_forecasts", lambda s, d: po.cross_validate(labelled(s, d), splits(s), ["linear"], FEATURES), sql, "y p")
    sql = f"""with recursive {LABELLED}, tr as (select *, 0 fold from lt where dt < date '{CUT}'), te as (select *, 0 fold from lt where dt >= date '{CUT}'),
{WITHIN}
select te.asset, te.dt, y, {SCORE} p from te join mn using (asset, fold) join cb using (fold)"""
    register("stored_model_forecasts", stored, sql, "y p")
    register("stacked_forecasts", lambda s, d: mt.prediction_metrics(stacked(s, d), "asset"))
    register("pooled_importance", importance)
    register("pooled_learning_curve", lambda s, d: po.learning_curve(labelled(s, d), "ridge", FEATURES))
    grid = [{"model": "ridge", "regParam": r} for r in (1e-4, 1e-2)] + [{"model": "decision_tree", "maxDepth": n} for n in (2, 5)]
    register("pooled_search", lambda s, d: po.search(labelled(s, d), splits(s, 2), FEATURES, grid))
