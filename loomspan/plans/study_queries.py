"""Queries of the studies: reports, comparisons, searches and forecast backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import agents as ag
from loomspan.operators import allocation as al
from loomspan.operators import backtest as bt
from loomspan.operators import forecasts as fc
from loomspan.operators import metrics as mt
from loomspan.operators import panels as pn
from loomspan.operators import studies as sd
from loomspan.plans.model_queries import FEATURES, features, labelled, oof
from loomspan.plans.panel_queries import AGR, NET, THREE, agent_signals
from loomspan.plans.risk_queries import PANEL, arithmetic_sql, named_weights, panel
from loomspan.plans.series_queries import W
from loomspan.plans.views import macro, prices, returns

ASSETS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def rates(s, d):
    return macro(s, d).where("series = '3-MEDIUM'").select("dt", (F.col("value") / 100000).alias("rate"))


def register_all() -> None:
    ex = "with rt as (select dt, value / 100000 rate from macro where series = '3-MEDIUM'), d as (select distinct dt from rets), j as (select d.dt, rate from d left join rt using (dt)), k as (select dt, coalesce(last_value(rate ignore nulls) over (order by dt), first_value(rate ignore nulls) over (order by dt rows between current row and unbounded following)) rate from j) select asset, dt, r, r - rate / 100 / 252 excess from rets join k using (dt)"
    register("excess_returns", lambda s, d: sd.excess_returns(returns(s, d), rates(s, d)), ex, "r excess")
    lead = f"with m as (select series, date_trunc('month', dt) mo, arg_max(value, dt) v from macro group by 1, 2), c as (select *, v / lag(v) over (partition by series order by mo) - 1 chg from m), r as (select asset, date_trunc('month', dt) mo, sum(r) s from rets group by 1, 2), a as (select *, lead(s) over (partition by asset order by mo) ahead from r) select asset, series, corr(chg, ahead) corr, count(*) n from a join c using (mo) where chg is not null and ahead is not null group by 1, 2"
    register("lead_correlation", lambda s, d: sd.lead_correlation(returns(s, d), macro(s, d)), lead, "corr")
    register("quality_report", lambda s, d: sd.quality_report(prices(s, d), ["asset", "dt"], ["px"]), "select 'px' as column, count(*) filter (px is null) nulls, count(*) filter (isinf(px)) infinite, count(*) filter (px = 0) zeros, min(px) = max(px) constant, count(*) as rows from prices")
    from loomspan.plans.risk_queries import KURT, SKEW

    k = lambda q: q.replace("(r)", "(e)").replace("r*", "e*").replace("*r)", "*e)").replace("(r", "(e")
    rd = f"with {PANEL}, q as (select *, y - p e from panel), c as (select *, e - avg(e) over (partition by asset) x, lag(e) over ({W}) l from q), z as (select *, lag(x) over ({W}) lx from c) select asset, avg(e) mean, stddev_samp(e) std, {k(SKEW)} skew, {k(KURT)} kurtosis, count(e) / 6.0 * (({k(SKEW)})**2 + ({k(KURT)})**2 / 4) jb, sum((e - l) ** 2) / sum(e * e) dw, sum(x * lx) / sum(x * x) rho_1 from z group by 1"
    register("residual_diagnostics", lambda s, d: sd.residual_diagnostics(panel(s, d)), rd, "mean std skew kurtosis jb dw rho_1")
    hd = f"with p as (select dt, asset, coalesce(lag(px, 1) over ({W}) / lag(px, 21) over ({W}) - 1, 0) p, lead(px, 5) over ({W}) / px - 1 h5, lead(px, 21) over ({W}) / px - 1 h21, lead(px, 63) over ({W}) / px - 1 h63 from prices), u as (select p, 5 h, h5 y from p union all select p, 21, h21 from p union all select p, 63, h63 from p) select h horizon, corr(p, y) pearson, avg(case when sign(p) = sign(y) then 1.0 else 0 end) hit, count(*) n from u where y is not null group by 1"

    def momentum(s, d):
        from loomspan.operators.windows import window_signal

        return window_signal(prices(s, d)).select("dt", "asset", F.col("signal").alias("p"))

    register("horizon_decay", lambda s, d: sd.horizon_decay(momentum(s, d), prices(s, d)), hd, "pearson hit")
    register("forecast_comparison", lambda s, d: sd.forecast_comparison(oof(s, d), "ridge"))
    register("random_portfolios", lambda s, d: sd.random_portfolios(s, ASSETS, *sd.moments(returns(s, d), ASSETS)).select("id", "ret", "vol", "sharpe"))
    register("efficient_frontier", lambda s, d: sd.frontier(s, *sd.moments(returns(s, d), ASSETS)))
    vw = f"with {PANEL}, l as (select asset, arg_max(p, dt) q from panel group by 1) select asset, q, (1 - 0.6::double) / 0.6 omega from l"
    register("forecast_views", lambda s, d: sd.views(panel(s, d), s.createDataFrame([(a, 0.6) for a in ASSETS], "asset string, confidence double")), vw, "q omega")
    grid = [{"model": "linear", "l2": x} for x in (0.1, 1.0, 10.0)] + [{"model": "boosted", "trees": n, "depth": 2} for n in (10, 30)]
    register("random_search", lambda s, d: sd.random_search(labelled(s, d), pn.expanding_splits(s, 1500, 3, 300, 63), FEATURES, grid))
    register("ic_weighted_ensemble", lambda s, d: pn.weighted_ensemble(o := oof(s, d), sd.ic_weights(o).select([F.col(c).alias(c) for c in ("model", "asset", "weight")])))
    register("prediction_intervals", lambda s, d: sd.intervals(oof(s, d, ("ridge",))))
    register("forecast_backtest", lambda s, d: mt.arithmetic(sd.forecast_backtest(labelled(s, d), prices(s, d), FEATURES).select("strategy", "dt", "r"), "strategy"))

    def integrated(s, d):
        return sd.integrated_targets(pn.label_table(features(s, d), prices(s, d)), returns(s, d), FEATURES, ag.agreement(agent_signals(s, d)))

    register("integrated_backtest", lambda s, d: mt.arithmetic(bt.strategy_returns(prices(s, d), integrated(s, d)).select("strategy", "dt", "r"), "strategy"))
    def experiments(s, d):
        f, p, r = features(s, d), prices(s, d), returns(s, d)
        parts = [sd.run_experiment(f"linear_{kind}", f, p, r, FEATURES, kind) for kind in ("none", "components", "top_k")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    register("experiments", experiments)
    register("rank_consensus", lambda s, d: sd.rank_consensus(fc.importance(labelled(s, d), "ridge", FEATURES).select(F.col("asset").alias("model"), "feature", "value")))

    def strategies(s, d):
        p = prices(s, d)
        dates = bt.schedule(p, offset=252)
        targets = bt.equal_targets(p, dates).unionByName(bt.inverse_vol_targets(returns(s, d), dates))
        return mt.arithmetic(bt.strategy_returns(p, targets).select("strategy", "dt", "r"), "strategy")

    two = f"with {THREE.strip().replace('tg as', 'tg3 as')}, tg as (select * from tg3 where strategy <> 'sixty_forty'), {NET.strip()}, m as (with {arithmetic_sql('net', 'strategy')})"
    fv = f"{two}, x as (select arg_max(strategy, sharpe) winner, max(sharpe) filter (strategy = 'equal_weight') base_sharpe, max(sharpe) filter (strategy = 'inverse_vol') other_sharpe from m) select *, other_sharpe - base_sharpe delta, case when other_sharpe - base_sharpe > 0.1 then 'positive' when other_sharpe > base_sharpe then 'slightly positive' when other_sharpe - base_sharpe > -0.1 then 'neutral' else 'negative' end verdict from x"
    register("feedback_verdict", lambda s, d: bt.verdict(strategies(s, d), "equal_weight", "inverse_vol"), fv, "base_sharpe other_sharpe delta")
    ne = f"{two} select 'untried_model' as rule, unnest(['svr', 'mlp']) detail union all select 'reduce_risk', strategy from m where max_drawdown < -0.2 union all select 'low_sharpe', strategy from m where sharpe < 0.5"
    register("next_experiments", lambda s, d: sd.suggestions(strategies(s, d), s.createDataFrame([("ridge",), ("lasso",)], "model string"), ["ridge", "lasso", "svr", "mlp"]), ne)
    ap = f"with {AGR}, a as (select p.dt, p.asset, p.px, agr.agreement from prices p asof left join agr on p.dt >= agr.dt) select dt, asset, px, coalesce(0.3 + 0.7 * greatest(0, least(1, agreement)), 1.0) scale from a"
    register("risk_scale_asof", lambda s, d: pn.asof(prices(s, d), ag.agreement(agent_signals(s, d)), "agreement").select("dt", "asset", "px", F.coalesce(ag.risk_scale(F.col("agreement")), F.lit(1.0)).alias("scale")), ap, "px scale")
    mg = f"with l as (select dt, arg_max(value, dt) as value from macro where series = '1-URGENT' group by dt), q as (select p.*, l.value from prices p asof left join l on p.dt >= l.dt) select dt, asset, px, case when coalesce(value, 20.0) > 260000 then 'crisis' when coalesce(value, 20.0) < 240000 then 'calm' else 'normal' end regime from q"
    register("market_regime", lambda s, d: pn.asof(prices(s, d), macro(s, d).where("series = '1-URGENT'").select("dt", "value"), "value").select("dt", "asset", "px", ag.regime(F.coalesce("value", F.lit(20.0)), F.lit(1.0), 260000.0, 240000.0).alias("regime")), mg, "px")
    register("data_freshness", lambda s, d: macro(s, d).groupBy("series").agg(F.max("dt").alias("last_dt")).withColumn("days_behind", F.datediff(F.max("last_dt").over(Window.partitionBy()), "last_dt").cast("long")), "select series, max(dt) last_dt, (select max(dt) from macro) - max(dt) days_behind from macro group by 1")

    # Reports over graph and logs.
    from loomspan.operators import actions as ac
    from loomspan.operators import graph as gr
    from loomspan.plans.views import actions, edges, nodes, table

    inc = "inc as (select src id, dst other, name, fact from edges union all select dst, src, name, fact from edges where src <> dst)"
    register("entity_summary", lambda s, d: gr.entity_summary(nodes(s, d), edges(s, d), "canada"), f"with {inc}, n as (select id, name from nodes where lower(name) = 'canada' order by id limit 1) select n.id, n.name, coalesce(string_agg(distinct fact, '; ' order by fact), '') facts, count(fact) edges from n left join inc using (id) group by n.id, n.name")
    ctx = "select 'label' part, labels[2] item, count(*) n from nodes group by 2 union all select 'relation', name, count(*) from edges group by 2 union all (select 'fact', fact, 100 from edges where contains(lower(fact || ' ' || name), 'urgent') order by 2 limit 30)"
    register("report_context", lambda s, d: gr.context(nodes(s, d), edges(s, d), "urgent"), ctx)

    def enriched(s, d):
        c = table(s, d, "customer").select("c_custkey", "c_name")
        n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        a = actions(s, d)
        return ac.enriched(a, [(["purchase"], F.col("agent_id"), c, "c_custkey", "c_name"), (["view", "click"], F.col("event_id") % 40, n, "n_nationkey", "n_name")]).select("event_id", "action_type", "c_name_", "n_name_")

    register("enriched_actions", enriched, "select event_id, action_type, c_name c_name_, n_name n_name_ from actions left join customer on action_type = 'purchase' and c_custkey = agent_id left join nation on action_type in ('view', 'click') and n_nationkey = event_id % 40")
    reg = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created"))
    tq = "with t as (select o_orderkey task_id, o_orderpriority kind, case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'running' end status, o_orderdate created from orders)"
    register("task_list", lambda s, d: ac.tasks(reg(s, d), "1-URGENT").limit(50).select("task_id", "status"), f"{tq} select task_id, status from t where kind = '1-URGENT' order by created desc, task_id desc limit 50")
    register("task_expiry", lambda s, d: ac.unexpired(reg(s, d), F.lit("1997-01-01 00:00:00").cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"{tq} select status, count(*) n from t where not (status in ('completed', 'failed') and created < timestamp '1997-01-01' - interval 24 hours) group by 1")
    register("activity_rules", lambda s, d: ag.activity_rules(nodes(s, d).select("id", F.lower(F.col("labels")[1]).alias("kind")), F.when(F.col("kind") == "nation", "organization").otherwise(F.col("kind"))).select("id", "posts", "comments", "influence", F.size("hours").cast("long").alias("hours")), "select id, case when labels[2] = 'Nation' then 0.2 else 0.5 end::double posts, case when labels[2] = 'Nation' then 0.1 else 1.0 end::double as comments, case when labels[2] = 'Nation' then 3.0 else 1.0 end::double influence, cast(case when labels[2] = 'Nation' then 9 else 17 end as bigint) as hours from nodes", "posts comments influence")
