"""Queries through files that are written and read again, and on rules that take their rows from graph and log tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.functions import text as tx
from loomspan.operators import agents as ag
from loomspan.operators import allocation as al
from loomspan.operators import backtest as bt
from loomspan.operators import graph as gr
from loomspan.operators import stats as st
from loomspan.operators import studies as sd
from loomspan.plans.linear_queries import ASSETS, market_level
from loomspan.plans.panel_queries import EQUAL, NET, RB, equal
from loomspan.plans.risk_queries import COV, named_weights
from loomspan.plans.sql_parts import normal_tail_sql
from loomspan.plans.views import actions, nodes, prices, returns, table
from loomspan.sources import files as fs
from loomspan.sources.scratch import scratch


# ---- files ----------------------------------------------------------------------------------------------------------------


def csv_panel(s, d):
    """Prices as a wide CSV and back."""
    folder = scratch(s)
    wide = prices(s, d).groupBy(F.col("dt").alias(fs.WIDE_DATE)).pivot("asset", ASSETS).agg(F.first("px"))
    wide.write.option("header", True).csv(f"{folder}/prices.csv")
    return fs.wide_csv(s, f"{folder}/prices.csv", ASSETS)


def action_files(s, d):
    """Actions as JSON lines, a log a platform, and back."""
    folder = scratch(s)
    rows = actions(s, d).select(F.col("round_num").alias("round"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "platform", "agent_id", "action_type")
    for platform in ("twitter", "reddit"):
        fs.write_lines(rows.where(F.col("platform") == platform), f"{folder}/{platform}/actions.jsonl")
    return fs.all_actions(s, folder)


def partitioned(s, d):
    """Prices by asset in folders, and one asset's back: the others' folders are not read."""
    folder = scratch(s)
    fs.write_panel(prices(s, d), f"{folder}/prices")
    return s.read.parquet(f"{folder}/prices").where(F.col("asset") == "PROMO").select("dt", "asset", "px")


def result_files(s, d):
    """Metrics of assets as two result files of differing columns, united, and the best ones above a floor."""
    folder = scratch(s)
    m = returns(s, d).groupBy(F.col("asset").alias("experiment")).agg((F.avg("r") / F.stddev_samp("r") * 252**0.5).alias("sharpe"), (F.avg("r") * 252).alias("ann_return"))
    first = F.col("experiment") < "M"
    m.where(first).withColumn("description", F.concat(F.lit("of\n"), "experiment")).coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{folder}/a.csv")
    m.where(~first).drop("ann_return").withColumn("desc", F.col("experiment")).coalesce(1).write.option("header", True).csv(f"{folder}/b.csv")
    got = fs.results(s, [f"{folder}/a.csv", f"{folder}/b.csv"])
    return fs.top_results(got, 4).where(F.col("sharpe") >= 0.0).select("experiment", "sharpe", "ann_return", "description")


def file_queries() -> None:
    register("csv_round_trip", csv_panel, "select dt, asset, px from prices", "px")
    timeline = lambda s, d: action_files(s, d).groupBy("platform", "action_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("agent_id").alias("agents"), F.max("round").cast("long").alias("last_round"), F.min("timestamp").alias("first"))
    sql = "select platform, action_type, count(*) n, count(distinct agent_id) agents, max(round_num)::bigint last_round, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) as first from actions group by 1, 2"
    register("jsonl_round_trip", timeline, sql)
    register("partitioned_round_trip", partitioned, "select dt, asset, px from prices where asset = 'PROMO'", "px")
    sql = """with m as (select asset experiment, avg(r) / stddev_samp(r) * sqrt(252) sharpe, avg(r) * 252 ann_return from rets group by 1),
u as (select experiment, sharpe, case when experiment < 'M' then ann_return end ann_return, case when experiment < 'M' then 'of' || chr(10) || experiment else experiment end description from m)
select * from (select * from u order by sharpe desc, experiment limit 4) where sharpe >= 0"""
    register("result_files_round_trip", result_files, sql, "sharpe ann_return")


# ---- rules ----------------------------------------------------------------------------------------------------------------


def people(s, d):
    """(agent_id, kind, influence, hours, rate): customers as agents, with kinds of events that they answer."""
    c = table(s, d, "customer")
    kinds = F.array(*map(F.lit, ["view", "click", "purchase", "none"]))
    k = F.col("c_custkey")
    return c.select(k.alias("agent_id"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"), (k * 7 % 101).cast("double").alias("influence"), F.sequence((k % 12).cast("int"), (k % 12 + 9).cast("int")).alias("hours"), (k % 10 / 10).alias("rate"))


def rules() -> None:
    posts = lambda s, d: table(s, d, "events").select(F.col("event_id").alias("post_id"), F.col("event_type").alias("kind"))
    who = """ag as (select c_custkey agent_id, ['view', 'click', 'purchase', 'none'][c_custkey % 4 + 1] kind, (c_custkey * 7 % 101)::double influence,
  range(c_custkey % 12, c_custkey % 12 + 10) as hours, c_custkey % 10 / 10.0 rate from customer)"""
    sql = f"""with {who},
a as (select *, row_number() over (partition by kind order by agent_id) - 1 j, count(*) over (partition by kind) n from ag),
p as (select event_id post_id, event_type kind, row_number() over (partition by event_type order by event_id) - 1 i from events),
z as (select distinct kind, n from a)
select post_id, p.kind, coalesce(a.agent_id, (select arg_max(agent_id, (influence, agent_id)) from ag)) agent_id
from p left join z on z.kind = p.kind left join a on a.kind = p.kind and a.j = p.i % z.n"""
    register("assigned_posts", lambda s, d: ag.assign_posts(posts(s, d), people(s, d).select("agent_id", "kind", "influence")), sql)

    sql = f"""with {who}, q as (select *, ('0x' || substr(md5(agent_id || ':20:0'), 1, 8))::bigint / 4294967296.0 draw from ag where list_contains(hours, 20))
select agent_id from q where draw < rate * 1.5 order by draw, agent_id limit 40"""
    register("active_agents", lambda s, d: ag.active_agents(people(s, d), 20, 40).select("agent_id"), sql)

    user = "regexp_replace(regexp_replace(lower(name), ' ', '_', 'g'), '[^a-z0-9_]', '', 'g') || '_' || (('0x' || substr(md5(name), 1, 8))::bigint % 900 + 100)"
    register("usernames", lambda s, d: nodes(s, d).select("id", tx.username(F.col("name")).alias("username")), f"select id, {user} username from nodes")

    kinds = lambda s, d: nodes(s, d).groupBy(F.length("name").alias("size")).agg(F.array_sort(F.collect_set(F.col("labels")[1])).alias("types"))
    sql = """with t as (select length(name) size, list(distinct labels[2] order by labels[2]) types from nodes group by 1)
select size, array_to_string(list_concat(list_filter(types, lambda x: x not in ('Person', 'Customer'))[1:1], ['Person', 'Customer']), '|') types from t"""
    register("entity_types", lambda s, d: kinds(s, d).select(F.col("size").cast("long").alias("size"), F.array_join(gr.valid_types(F.col("types"), ("Person", "Customer"), 3), "|").alias("types")), sql)

    tilt = lambda: F.when(F.col("asset") == "PROMO", 0.02).otherwise(0.01)
    sql = """with lv as (select dt, value / 7500 as level from macro where series = '1-URGENT'),
sp as (select h.dt, (h.value - m.value) / 50000 spread from macro h join macro m on m.dt = h.dt and h.series = '2-HIGH' and m.series = '3-MEDIUM'),
q as (select p.dt, p.asset, lv.level, sp.spread, case when p.asset = 'PROMO' then 0.02 else 0.01 end tilt from prices p asof left join lv on p.dt >= lv.dt asof left join sp on p.dt >= sp.dt)
select dt, asset, case when level > 22 or spread < 0 then -tilt else tilt end signal from q"""
    register("macro_agent", lambda s, d: market_level(s, d).select("dt", "asset", sd.macro_signal(F.col("level"), F.col("spread"), 22.0, tilt()).alias("signal")), sql, "signal")

    def crossing(s, d):
        net = bt.cost_sweep(bt.strategy_returns(*equal(s, d)))
        by = net.groupBy("bps").agg((F.avg("r") / F.stddev_samp("r") * 252**0.5).alias("sharpe"))
        w = Window.partitionBy()  # a row a cost level
        return st.break_even(by.withColumn("_half", (F.max("sharpe").over(w) + F.min("sharpe").over(w)) / 2), F.col("_half"))

    sql = f"""with {RB}, {EQUAL}, {NET.strip()},
sw as (select bps, r + cost - turnover * bps / 1e4 r from net, (select unnest([0,5,10,15,20,30,40,50]::double[]) bps)),
sh as (select bps, avg(r) / stddev_samp(r) * sqrt(252) s from sw group by 1),
ld as (select bps, s, lead(bps) over (order by bps) b2, lead(s) over (order by bps) s2, (max(s) over () + min(s) over ()) / 2 h from sh)
select bps + (s - h) / (s - s2) * (b2 - bps) break_even_bps from ld where s >= h and s2 < h order by bps limit 1"""
    register("break_even_cost", crossing, sql, "break_even_bps")

    # Weightings side by side, and the distribution of returns against the normal one.
    mu = lambda r: r.groupBy("asset").agg((F.avg("r") * 252).alias("mu"))
    stats = """mu as (select asset, avg(r) * 252 mu, stddev_samp(r) * sqrt(252) s from rets group by 1),
q as (select wts.*, sw, v, weight * sw / v share, mu, s from wts join sw using (name, asset) join pv using (name) join mu using (asset))"""
    sql = f"""with {COV}, {stats}
select name, sum(weight * mu) ret, sqrt(min(v)) vol, sum(weight * mu) / sqrt(min(v)) sharpe, sum(weight * s) / sqrt(min(v)) diversification,
  exp(-sum(case when share > 0 then share * ln(share) else 0 end)) effective_bets, sum(weight * weight) herfindahl, max(weight) max_weight,
  1 / sum(weight * weight) effective_n, count(*) filter (weight > 1e-6) held from q group by 1"""
    register("strategy_table", lambda s, d: sd.strategy_table(named_weights(r := returns(s, d)), mu(r), al.covariance_long(r)), sql, "ret vol sharpe diversification effective_bets herfindahl max_weight effective_n")

    sql = f"""with z as (select asset, (r - avg(r) over (partition by asset)) / stddev_samp(r) over (partition by asset) z, row_number() over (partition by asset order by r) i, count(*) over (partition by asset) n from rets),
c as (select asset, i, n, case when z > 0 then 1 - {normal_tail_sql('z')} / 2 else {normal_tail_sql('z')} / 2 end f from z),
d as (select asset, min(n) n, max(greatest(i / n::double - f, f - (i - 1) / n::double)) statistic from c group by 1),
l as (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * statistic as lambda_ from d)
select asset, n, statistic, greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * lambda_ * lambda_))))) p_value from l"""
    register("normality_test", lambda s, d: sd.normality(returns(s, d)), sql, "statistic p_value")


def register_all() -> None:
    file_queries()
    rules()
