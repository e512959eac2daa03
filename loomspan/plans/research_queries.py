"""Queries on set operations, lookups, registries, reports and strategies that follow forecasts or agents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import agents as ag
from loomspan.operators import backtest as bt
from loomspan.operators import metrics as mt
from loomspan.operators import research as rs
from loomspan.operators import returns as rt
from loomspan.operators import studies as sd
from loomspan.plans.model_queries import FEATURES, labelled
from loomspan.plans.panel_queries import AG, agent_signals
from loomspan.plans.series_queries import W
from loomspan.plans.views import macro, market, nodes, prices, returns, table

CLASSES = {"metal": ["BRASS", "STEEL"], "trade": ["PROMO", "ECONOMY"], "plain": ["STANDARD"]}
NAMES = {"mom": "momentum", "vol": "volatility"}
PERSONAS = {"Customer": ("buyer", "{} buys and complains."), "Supplier": ("seller", "{} sells and explains.")}


def registry(s, d):
    """(target, model, fold, rmse, ic): order priorities as models, states as targets, years as folds."""
    o = table(s, d, "orders")
    key = [F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("fold")]
    price = F.col("o_totalprice").cast("decimal(18,4)")
    mean = (F.sum(price).cast("double") / F.count(F.lit(1))).alias("rmse")
    return o.groupBy(*key).agg(mean, (F.count(F.lit(1)) / 1000).alias("ic"))


REGISTRY = """reg as (select o_orderstatus target, o_orderpriority model, year(o_orderdate) fold,
  cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) rmse, count(*) / 1000 ic from orders group by 1, 2, 3)"""


def swarm_returns(s, d):
    """Daily returns of the agents' own weights, set again each day."""
    targets = rs.signal_targets(ag.ensemble(agent_signals(s, d)))
    return bt.daily_asof_returns(returns(s, d), targets)


def lags(s, d):
    """Feature names from the parts' types and sizes: some with a lag."""
    base = F.when(F.col("p_size") % 2 == 0, "mom").when(F.col("p_size") % 3 == 0, "vol").otherwise(F.lower("p_type"))
    name = F.when(F.col("p_size") < 40, F.concat(base, F.lit("_lag"), "p_size")).otherwise(base)
    return table(s, d, "part").select(name.alias("feature"))


LAGS = """fe as (select p_size, case when p_size % 2 = 0 then 'mom' when p_size % 3 = 0 then 'vol' else lower(p_type) end base from part),
fn as (select base || case when p_size < 40 then '_lag' || p_size else '' end feature,
  case base when 'mom' then 'momentum' when 'vol' then 'volatility' else base end || case when p_size < 40 then ' (lag ' || p_size || ')' else '' end shown from fe)"""


def register_all() -> None:
    both = "o_orderstatus, o_orderpriority"
    orders = lambda s, d: table(s, d, "orders")
    count = lambda: F.count(F.lit(1)).alias("n")
    register("totals_cube", lambda s, d: orders(s, d).cube("o_orderstatus", "o_orderpriority").agg(count()), f"select {both}, count(*) n from orders group by cube({both})")
    sets = lambda: [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    grouped = lambda s, d: orders(s, d).groupingSets(sets(), "o_orderstatus", "o_orderpriority").agg(count())
    register("totals_grouping_sets", grouped, f"select {both}, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
    register("dates_in_both", lambda s, d: prices(s, d).select("dt").intersect(macro(s, d).select("dt")), "select dt from prices intersect select dt from macro")
    register("dates_without_macro", lambda s, d: prices(s, d).select("dt").exceptAll(macro(s, d).select("dt")), "select dt from prices except all select dt from macro")
    register("distinct_states", lambda s, d: orders(s, d).select("o_orderstatus", "o_orderpriority").distinct(), f"select distinct {both} from orders")

    # Lookups.
    case = " ".join(f"when asset in ({', '.join(map(repr, a))}) then '{n}'" for n, a in CLASSES.items())
    classes = lambda s, d: prices(s, d).groupBy(rs.class_of(F.col("asset"), CLASSES).alias("class")).agg(count(), F.countDistinct("asset").alias("assets"))
    register("asset_classes", classes, f"select case {case} else 'Unknown' end as class, count(*) n, count(distinct asset) assets from prices group by 1")
    shown = lambda s, d: lags(s, d).groupBy("feature", rs.display_name(F.col("feature"), NAMES).alias("shown")).agg(count())
    register("feature_names", shown, f"with {LAGS} select feature, shown, count(*) n from fn group by 1, 2")

    def profiles(s, d):
        stance, bio = rs.persona(F.col("labels")[1], F.col("name"), PERSONAS, ("neutral", "{} watches."))
        return nodes(s, d).select("id", stance.alias("stance"), bio.alias("bio"))

    kind = "case labels[2] when 'Customer' then '{}' when 'Supplier' then '{}' else '{}' end"
    bio = "name || " + kind.format(" buys and complains.", " sells and explains.", " watches.")
    register("agent_profiles", profiles, f"select id, {kind.format('buyer', 'seller', 'neutral')} stance, {bio} bio from nodes")

    def truncated(s, d):
        m = market(returns(s, d))
        rates = macro(s, d).where("series = '5-LOW'").select("dt", F.col("value").alias("level"))
        return rs.by_position(m, rates).select("position", "dt", "b", "level")

    pos = "a as (select row_number() over (order by dt) - 1 as position, dt, b from mkt), l as (select row_number() over (order by dt) - 1 as position, value as level from macro where series = '5-LOW')"
    register("joined_by_position", truncated, f"with {pos} select position, dt, b, level from a join l using (position)", "b level")

    # Reports and registries.
    part = "select '{}' source, {} as name, count(*) n, min(dt) first_dt, max(dt) last_dt, avg(case when {v} is null then 1.0 else 0.0 end) * 100 null_pct, count(*) filter ({v} <= 0) not_positive from {t} group by 2"
    sql = part.format("prices", "asset", v="px", t="prices") + " union all " + part.format("macro", "series", v="value", t="macro")
    register("combined_quality", lambda s, d: rs.quality({"prices": (prices(s, d), "asset", "px"), "macro": (macro(s, d), "series", "value")}), sql, "null_pct")
    register("registry_models", lambda s, d: rs.compare_models(registry(s, d), "F", ["rmse", "ic"]), f"with {REGISTRY} select model, avg(rmse) rmse_mean, avg(ic) ic_mean from reg where target = 'F' group by 1", "rmse_mean ic_mean")
    register("registry_best", lambda s, d: rs.best_models(registry(s, d), "rmse"), f"with {REGISTRY}, m as (select target, model, avg(rmse) score from reg group by 1, 2) select target, arg_min(model, (score, model)) model, min(score) score from m group by 1", "score")

    # Strategies.
    up = "tg as (select dt, asset, case when sum(greatest(ensemble, 0)) over (partition by dt) > 0 then greatest(ensemble, 0) / sum(greatest(ensemble, 0)) over (partition by dt) else 1.0::double / count(*) over (partition by dt) end weight from en)"
    sp = "sp as (select dt since, lead(dt) over (order by dt) until from (select distinct dt from tg))"
    j = "j as (select r.dt, r.r, t.weight w from rets r join sp on r.dt >= since and (until is null or r.dt < until) join tg t on t.dt = since and t.asset = r.asset), gs as (select dt, sum(w * r) g from j group by 1)"
    own = "select 'agents' strategy, dt, min(g) - sum(abs(w - w * (1 + r) / (1 + g))) * 10 / 1e4 r, sum(abs(w - w * (1 + r) / (1 + g))) turnover from j join gs using (dt) group by dt"
    register("swarm_only_backtest", swarm_returns, f"with {AG}, {up}, {sp}, {j} {own}", "r turnover")

    def optimised(s, d):
        r = returns(s, d)
        p = sd.walk_forward(labelled(s, d), FEATURES, horizon=21)
        targets = rs.forecast_targets(p, r, bt.schedule(prices(s, d), 63, 756))
        return mt.arithmetic(bt.strategy_returns(prices(s, d), targets).select("strategy", "dt", "r"), "strategy")

    register("optimised_forecast_backtest", optimised)
