"""Queries that align, fill, reshape and split panels, and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import agents as ag
from loomspan.operators import backtest as bt
from loomspan.operators import panels as pn
from loomspan.operators.allocation import allocate
from loomspan.plans.risk_queries import ARITHMETIC_DOUBLES, arithmetic_sql
from loomspan.plans.series_queries import W
from loomspan.plans.views import macro, market, prices, returns

CAL = "cal as (select dt, row_number() over (order by dt) - 1 i from (select distinct dt from prices))"
GRID = "span as (select asset, min(dt) a, max(dt) b from prices group by 1), grid as (select asset, cast(unnest(generate_series(a, b, interval 1 day)) as date) dt from span), cells as (select grid.asset, grid.dt, px from grid left join prices using (asset, dt) where dayofweek(grid.dt) between 1 and 5)"


def grid(s, d):
    return pn.reindex(prices(s, d))


def known(s, d):
    """Macro as it becomes known, 40 days late: the right side of as-of joins by series."""
    return macro(s, d).select("series", F.date_add("dt", 40).alias("dt"), "value")


def read_by(s, d):
    """Each price row with each series' name: the left side."""
    names = macro(s, d).select("series").distinct()
    return prices(s, d).join(F.broadcast(names))


def newest(s, d):
    """The mean over the series of a date: a right side without keys."""
    return macro(s, d).groupBy("dt").agg(F.avg("value").alias("value"))


KNOWN = "known as (select series, dt + 40 dt, value from macro), lf as (select * from prices, (select distinct series from macro))"
NEWEST = "newest as (select dt, avg(value) as value from macro group by 1)"


def scenarios(s):
    rows = [("first", "1995-01-01", "1995-12-31"), ("second", "1996-03-01", "1996-09-30"), ("third", "1997-06-01", "1998-06-01"), ("none", "2020-01-01", "2020-02-01")]
    return s.createDataFrame(rows, "scenario string, a string, b string").select("scenario", F.to_date("a").alias("start"), F.to_date("b").alias("stop"))


SCEN = "scen(scenario, start_, stop_) as (values ('first', date '1995-01-01', date '1995-12-31'), ('second', date '1996-03-01', date '1996-09-30'), ('third', date '1997-06-01', date '1998-06-01'), ('none', date '2020-01-01', date '2020-02-01'))"
RB = f"{CAL}, rb as (select dt from cal where i >= 756 and (i - 756) % 21 = 0)"
#: Targets of equal weights; prices carried forward; holdings with drift, up to the next target date; returns with cost.
EQUAL = "tg as (select 'equal_weight' strategy, p.dt, asset, 1.0::double / count(*) over (partition by p.dt) weight from prices p join rb using (dt))"
HELD = """
pf as (select a.asset, c.dt, last_value(p.px ignore nulls) over (partition by a.asset order by c.dt) px
  from (select asset, min(dt) f from prices group by 1) a join cal c on c.dt >= a.f left join prices p on p.asset = a.asset and p.dt = c.dt),
sp as (select strategy, dt since, lead(dt) over (partition by strategy order by dt) until from (select distinct strategy, dt from tg)),
h as (select sp.strategy, c.dt, sp.since, tg.asset, tg.weight target, pf.px, coalesce(c.dt = sp.until, false) closing
  from sp join cal c on c.dt >= sp.since and (sp.until is null or c.dt <= sp.until)
  join tg on tg.strategy = sp.strategy and tg.dt = sp.since join pf on pf.asset = tg.asset and pf.dt = c.dt),
vv as (select *, target * px / first_value(px) over (partition by strategy, since, asset order by dt) value from h),
dr as (select *, value / nullif(sum(value) over (partition by strategy, since, dt), 0) weight, lag(value) over (partition by strategy, since, asset order by dt) before from vv)
"""
NET = f"""
{HELD.strip()},
ch as (select strategy, dt, asset, sum(case when dt = since then target else 0 end) - sum(case when closing then coalesce(weight, 0) else 0 end) moved,
  bool_or(closing or dt = since) rebalanced, sum(case when dt > since then value end) now_, sum(case when dt > since then before end) was from dr group by 1, 2, 3),
gr as (select strategy, dt, coalesce(sum(now_) / nullif(sum(was), 0) - 1, 0) gross, coalesce(sum(abs(moved)) filter (rebalanced), 0) turnover from ch group by 1, 2),
net as (select strategy, dt, gross - turnover * 10 / 1e4 r, turnover, turnover * 10 / 1e4 cost from gr)
"""
#: The three strategies of the report, rebalanced from the 252nd date on.
THREE = f"""
{CAL}, rb as (select dt from cal where i >= 252 and (i - 252) % 21 = 0),
vol as (select asset, dt, stddev_samp(r) over ({W} rows between 252 preceding and 1 preceding) s from rets),
fw as (select p.dt, asset, case asset when 'ECONOMY' then 0.6 when 'STANDARD' then 0.4 else 0 end w from prices p join rb using (dt)),
tg as (select 'equal_weight' strategy, p.dt, asset, 1.0::double / count(*) over (partition by p.dt) weight from prices p join rb using (dt)
  union all select 'sixty_forty', dt, asset, case when sum(w) over (partition by dt) > 0 then w / sum(w) over (partition by dt) else 1.0::double / count(*) over (partition by dt) end from fw
  union all select 'inverse_vol', dt, asset, (1 / s) / sum(1 / s) over (partition by dt) from vol join rb using (dt) where s > 0)
"""


def equal(s, d):
    p = prices(s, d)
    return p, bt.equal_targets(p, bt.schedule(p))


def report(s, d):
    """Metrics of three strategies, net of cost: the flagship."""
    p, r = prices(s, d), returns(s, d)
    dates = bt.schedule(p, offset=252)
    targets = bt.equal_targets(p, dates).unionByName(bt.fixed_targets(p, dates, {"ECONOMY": 0.6, "STANDARD": 0.4})).unionByName(bt.inverse_vol_targets(r, dates))
    return bt.compare(bt.strategy_returns(p, targets).select("strategy", "dt", "r"))


def agent_signals(s, d):
    agents = s.createDataFrame([("fast", "momentum", 21, 0.8), ("slow", "momentum", 63, 0.6), ("against", "contrarian", 21, 0.5)], "agent string, kind string, rows int, confidence double")
    p = prices(s, d)
    return ag.signals(p, agents, bt.schedule(p, offset=252))


AG = f"{CAL}, rb as (select dt from cal where i >= 252 and (i - 252) % 21 = 0), lagd as (select dt, asset, coalesce(lag(px, 1) over ({W}) / lag(px, 21) over ({W}) - 1, 0) s21, coalesce(lag(px, 1) over ({W}) / lag(px, 63) over ({W}) - 1, 0) s63 from prices), sg as (select dt, asset, agent, confidence, confidence * case agent when 'fast' then s21 when 'slow' then s63 else -s21 end signal from lagd join rb using (dt), (values ('fast', 0.8::double), ('slow', 0.6::double), ('against', 0.5::double)) a(agent, confidence)), en as (select dt, asset, sum(confidence * signal) / sum(confidence) ensemble from sg group by 1, 2)"
AGR = f"{AG}, cr as (select dt, agent, case when stddev_pop(signal) > 1e-12 and stddev_pop(ensemble) > 1e-12 then corr(signal, ensemble) end c from sg join en using (dt, asset) group by 1, 2), agr as (select dt, coalesce(avg(c), 0) agreement from cr group by 1)"


def register_all() -> None:
    register("align_outer", lambda s, d: pn.align([prices(s, d).where("asset = 'PROMO'").select("dt", "px"), macro(s, d).where("series = '5-LOW'").select("dt", "value")], "outer"), "select coalesce(a.dt, b.dt) dt, px, value from (select dt, px from prices where asset = 'PROMO') a full join (select dt, value from macro where series = '5-LOW') b on a.dt = b.dt", "px value")
    ao = "select l.dt, l.asset, l.px, l.series, k.value from lf l asof left join known k on l.series = k.series and l.dt {} k.dt"
    register("asof_join", lambda s, d: pn.asof(read_by(s, d), known(s, d), "value", by=["series"]), f"with {KNOWN} {ao.format('>=')}", "px value")
    register("asof_join_strict", lambda s, d: pn.asof(read_by(s, d), known(s, d), "value", by=["series"], strict=True), f"with {KNOWN} {ao.format('>')}", "px value")
    register("asof_dates", lambda s, d: pn.asof(prices(s, d), newest(s, d), "value", strict=True), f"with {NEWEST} select p.dt, p.asset, p.px, n.value from prices p asof left join newest n on p.dt > n.dt", "px value")
    register("nearest_join", lambda s, d: pn.nearest(prices(s, d), newest(s, d), "value"), f"with {NEWEST}, q as (select p.*, b.dt bd, b.value bv, a.dt ad, a.value av from prices p asof left join newest b on p.dt >= b.dt asof left join newest a on p.dt <= a.dt) select dt, asset, px, case when ad is null or (bd is not null and dt - bd <= ad - dt) then bv else av end as value from q", "px value")
    register("calendar_reindex", grid, f"with {GRID} select * from cells", "px")
    lim = lambda n: f"last_value(px ignore nulls) over ({W} rows between {n} preceding and current row)"
    register("fill_forward_limited", lambda s, d: pn.fill_forward(grid(s, d), limit=2), f"with {GRID} select asset, dt, {lim(2)} px from cells", "px")
    register("fill_both_ways", lambda s, d: pn.fill_both(grid(s, d)), f"with {GRID} select asset, dt, coalesce({lim('unbounded')}, first_value(px ignore nulls) over ({W} rows between current row and unbounded following)) px from cells", "px")
    ip = f"with {GRID}, k as (select *, row_number() over ({W}) i from cells), n as (select *, last_value(px ignore nulls) over ({W}) a, first_value(px ignore nulls) over ({W} rows between current row and unbounded following) b, max(case when px is not null then i end) over ({W}) ia, min(case when px is not null then i end) over ({W} rows between current row and unbounded following) ib from k) select asset, dt, coalesce(px, case when i - ia <= 5 then a + (b - a) * (i - ia) / (ib - ia) end) px from n"
    register("interpolate", lambda s, d: pn.interpolate(grid(s, d)), ip, "px")
    pm = "with d as (select distinct dt from prices), g as (select d.dt, s.series, m.value from d cross join (select distinct series from macro) s left join macro m on m.dt = d.dt and m.series = s.series), f as (select dt, 'macro_' || series series, last_value(value ignore nulls) over (partition by series order by dt rows between 5 preceding and current row) as value from g) select p.dt, p.asset, p.px, f.series, f.value from prices p join f using (dt)"
    register("price_macro_join", lambda s, d: pn.price_macro(prices(s, d), macro(s, d)), pm, "px value")
    register("null_share_filter", lambda s, d: pn.null_share(grid(s, d), "dt", "px", 0.5), f"with {GRID}, k as (select dt from cells group by 1 having avg(case when px is null then 1.0 else 0 end) <= 0.5) select dt, asset, px from cells join k using (dt) where px is not null", "px")
    register("outliers_z", lambda s, d: pn.outliers_z(returns(s, d)), "with q as (select asset, avg(r) m, stddev_samp(r) s from rets group by 1) select asset, dt, r, coalesce(abs(r - m) / s > 3, false) outlier from rets join q using (asset)", "r")
    register("outliers_iqr", lambda s, d: pn.outliers_iqr(returns(s, d)), "with q as (select asset, quantile_cont(r, 0.25) a, quantile_cont(r, 0.75) b from rets group by 1) select asset, dt, r, r < a - 1.5 * (b - a) or r > b + 1.5 * (b - a) outlier from rets join q using (asset)", "r")
    al = "select asset, dt, r, case when stddev_samp(r) over w > 0 then greatest(-3.0, least(3.0, (r - avg(r) over w) / stddev_samp(r) over w)) else 0 end z, (rank() over (partition by dt order by r) + (count(*) over (partition by dt, r) - 1) / 2.0) / count(*) over w as rank, case when max(r) over w > min(r) over w then 2 * (r - min(r) over w) / (max(r) over w - min(r) over w) - 1 else 0 end minmax from rets window w as (partition by dt)"
    register("alpha_signals", lambda s, d: pn.alpha_signals(returns(s, d), "r"), al, "r z rank minmax")
    cs = lambda s, d: returns(s, d).select(F.lit("a").alias("name"), "dt", "asset", F.col("r").alias("value")).unionByName(returns(s, d).select(F.lit("b").alias("name"), "dt", "asset", (-2 * F.col("r")).alias("value")))
    register("combine_signals", lambda s, d: pn.combine_signals(cs(s, d), {"a": 3.0}), "select dt, asset, (3 * r + 1 * (-2 * r)) / 4 signal from rets", "signal")
    register("monthly_returns", lambda s, d: pn.monthly(returns(s, d)), (mon := "with g as (select asset, date_trunc('month', dt)::date as month, exp(sum(ln(1 + r))) - 1 ret from rets group by 1, 2), s as (select asset, min(month) a, max(month) b from g group by 1), c as (select asset, unnest(generate_series(a, b, interval 1 month))::date as month from s), m as (select c.asset, c.month, coalesce(ret, 0) ret from c left join g using (asset, month))") + " select * from m", "ret")
    cells = ", ".join(f"max(ret) filter (month(month) = {k}) m{k}" for k in range(1, 13))
    register("month_table", lambda s, d: pn.month_table(returns(s, d)), f"{mon} select asset, year(month)::int as year, {cells}, exp(sum(ln(1 + ret))) - 1 ytd from m group by 1, 2", " ".join(f"m{k}" for k in range(1, 13)) + " ytd")
    register("rebalance_dates", lambda s, d: bt.schedule(prices(s, d)), f"with {CAL} select dt, i from cal where i >= 756 and (i - 756) % 21 = 0")
    kinds = {
        "expanding": ("range(5)", "0", "756 + i * 63", "761 + i * 63", "least(824 + i * 63, n)", {}),
        "walk_forward": ("range(400)", "i * 21", "i * 21 + 756", "i * 21 + 761", "i * 21 + 782", {}),
        "purged": ("range(5)", "0", "(i + 1) * (n // 6) - 5", "(i + 1) * (n // 6)", "(i + 2) * (n // 6)", {}),
        "blocking": ("range(5)", "greatest(0, (i + 1) * (n // 6) - 300)", "(i + 1) * (n // 6)", "(i + 1) * (n // 6)", "(i + 2) * (n // 6)", {"window": 300}),
    }
    for kind, (folds, a, b, t, u, sizes) in kinds.items():
        whole = "u <= n" if kind == "walk_forward" else "t < n"
        sql = f"""with c as (select list(dt order by dt) as dts, count(*) n from (select distinct dt from prices)),
f as (select i, n, dts, {a} a, {b} b, {t} t, {u} u from c, {folds} r(i))
select i fold, a::bigint train_start, b::bigint train_end, t::bigint test_start, u::bigint test_end, dts[a + 1] train_from, dts[b] train_to,
  dts[t + 1] test_from, dts[least(u, n)] test_to from f where a < b and {whole}"""
        register(f"{kind}_splits", lambda s, d, kind=kind, sizes=sizes: pn.calendar_splits(prices(s, d), kind, **sizes), sql)
    register("split_rows", lambda s, d: pn.rows_of_split(returns(s, d), pn.blocking_splits(s, 600)).groupBy("asset", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r")), f"with q as (select *, row_number() over ({W}) - 1 i from rets), sp as (select f fold, 0 a, (f + 1) * 100 b, (f + 1) * 100 c, (f + 2) * 100 d from range(5) t(f)), j as (select asset, fold, case when i >= c and i < d then 'test' else 'train' end role, r from q join sp on (i >= a and i < b) or (i >= c and i < d)) select asset, fold, role, count(*) n, avg(r) mean_r from j group by all", "mean_r")
    register("label_table", lambda s, d: pn.label_table(prices(s, d), prices(s, d)), f"select * from (select dt, asset, px, lead(px, 21) over ({W}) / px - 1 y from prices) where y is not null", "px y")

    # Backtests.
    register("drifted_weights", lambda s, d: bt.drifted(*equal(s, d)), f"with {RB}, {EQUAL}, {HELD.strip()} select strategy, dt, since, asset, target, weight, value from dr where not closing", "target weight value")
    register("equal_weight_backtest", lambda s, d: bt.strategy_returns(*equal(s, d)), f"with {RB}, {EQUAL}, {NET.strip()} select * from net", "r turnover cost")
    register("cost_sweep", lambda s, d: bt.cost_sweep(bt.strategy_returns(*equal(s, d))), f"with {RB}, {EQUAL}, {NET.strip()} select strategy, dt, bps, r + cost - turnover * bps / 1e4 r from net, (select unnest([0,5,10,15,20,30,40,50]::double[]) bps)", "bps r")
    register("strategy_report", report, f"with {THREE.strip()}, {NET.strip()}, {arithmetic_sql('net', 'strategy')}", ARITHMETIC_DOUBLES)
    nd = f"with {RB}, tg as (select p.dt, asset, 1.0 / count(*) over (partition by p.dt) weight from prices p join rb using (dt)), sp as (select dt since, lead(dt) over (order by dt) until, lag(dt) over (order by dt) p from (select distinct dt from tg)), g as (select r.dt, sum(r.r * t.weight) g from rets r join sp on r.dt > since and (until is null or r.dt <= until) join tg t on t.dt = since and t.asset = r.asset group by 1), ds as (select d.dt, since, until from (select distinct dt from rets) d join sp on d.dt > since and (until is null or d.dt <= until)), gg as (select dt, coalesce(g, 0) g from ds left join g using (dt)), tn as (select coalesce(a.dt, b.dt) dt, sum(abs(coalesce(a.weight, 0) - coalesce(b.wo, 0))) t from tg a full join (select sp.since dt, tg.asset, tg.weight wo from sp join tg on tg.dt = sp.p) b on a.dt = b.dt and a.asset = b.asset group by 1) select 'equal_weight' strategy, gg.dt, g - coalesce(t, 0) * 10 / 1e4 r from gg left join tn using (dt)"
    register("no_drift_backtest", lambda s, d: bt.no_drift_returns(returns(s, d), equal(s, d)[1]), nd, "r")
    da = f"with {RB}, tg as (select p.dt, asset, 1.0 / count(*) over (partition by p.dt) weight from prices p join rb using (dt)), sp as (select dt since, lead(dt) over (order by dt) until from (select distinct dt from tg)), j as (select r.dt, r.r, t.weight w from rets r join sp on r.dt >= since and (until is null or r.dt < until) join tg t on t.dt = since and t.asset = r.asset), g as (select dt, sum(w * r) g from j group by 1) select 'equal_weight' strategy, dt, min(g) - sum(abs(w - w * (1 + r) / (1 + g))) * 10 / 1e4 r, sum(abs(w - w * (1 + r) / (1 + g))) turnover from j join g using (dt) group by dt"
    register("daily_asof_backtest", lambda s, d: bt.daily_asof_returns(returns(s, d), equal(s, d)[1]), da, "r turnover")
    hr = f"with {RB}, f as (select dt, asset, lead(px, 21) over ({W}) / px - 1 f from prices), tg as (select p.dt, asset, 1.0 / count(*) over (partition by p.dt) weight from prices p join rb using (dt)), q as (select tg.*, f, abs(weight - coalesce(lag(weight) over (partition by asset order by tg.dt), 0)) d from tg join f using (dt, asset)) select 'equal_weight' strategy, dt, sum(weight * f) r, sum(d) turnover from q group by dt having sum(weight * f) is not null"
    register("holding_returns", lambda s, d: bt.holding_returns(*equal(s, d)), hr, "r turnover")
    sx = f"with {SCEN}, j as (select * from rets join scen on dt between start_ and stop_), g as (select *, exp(sum(ln(1 + r)) over (partition by scenario, asset order by dt)) g from j), t as (select *, g / max(g) over (partition by scenario, asset order by dt) - 1 dd from g) select scenario, asset, count(r) n, exp(sum(ln(1 + r))) - 1 total_return, stddev_samp(r) * sqrt(252) volatility, min(dd) max_drawdown, min(r) worst_day from t group by 1, 2"
    register("stress_windows", lambda s, d: bt.stress(returns(s, d), scenarios(s)), sx, "total_return volatility max_drawdown worst_day")
    rg = "with v as (select dt, case when count(b) over w >= 63 then stddev_samp(b) over w end v from mkt window w as (order by dt rows between 62 preceding and current row)), e as (select quantile_cont(v, 0.75) e from v), g as (select dt, case when v > e then 'high' when v is not null then 'normal' end regime from v, e) select asset, regime, count(r) n, avg(r) * 252 annual_return, stddev_samp(r) * sqrt(252) volatility from rets join g using (dt) where regime is not null group by 1, 2 having count(r) > 5"
    register("regime_split", lambda s, d: bt.regime_split(r := returns(s, d), market(r)), rg, "annual_return volatility")
    register("allocation_strategies", lambda s, d: allocate(returns(s, d), bt.schedule(prices(s, d), 252, 504)))
    register("rolling_mean_variance_backtest", lambda s, d: bt.strategy_returns(prices(s, d), allocate(returns(s, d), bt.schedule(prices(s, d), 63, 504), ["mean_variance"])))
    register("turnover_limited_backtest", lambda s, d: bt.turnover_limited(prices(s, d), [None, 0.1, 0.5], every=63))

    # Agents.
    register("agent_signals", agent_signals, f"with {AG} select * from sg", "confidence signal")
    register("agent_ensemble", lambda s, d: ag.ensemble(agent_signals(s, d)), f"with {AG} select * from en", "ensemble")
    register("agreement", lambda s, d: ag.agreement(agent_signals(s, d)), f"with {AGR} select * from agr", "agreement")
    register("position_scale", lambda s, d: ag.agreement(agent_signals(s, d)).withColumns({"scale": ag.position_scale(F.col("agreement")), "bridge": ag.risk_scale(F.col("agreement"))}), f"with {AGR} select dt, agreement, case when agreement >= 0.3 then 1.0 when agreement <= 0.1 then 0.5 else 0.5 + (agreement - 0.1) / 0.2 * 0.5 end scale, 0.3 + 0.7 * greatest(0, least(1, agreement)) bridge from agr", "agreement scale bridge")
    ow = "with w as (select dt, asset, px / sum(px) over (partition by dt) weight, 0.6::double scale from prices)"
    over = lambda s, d: prices(s, d).select("dt", "asset", (F.col("px") / F.sum("px").over(Window.partitionBy("dt"))).alias("weight"), F.lit(0.6).alias("scale"))
    register("blend_to_equal", lambda s, d: ag.blend_to_equal(over(s, d)), f"{ow} select dt, asset, scale * weight + (1 - scale) / count(*) over (partition by dt) weight, scale from w", "weight scale")
    register("redistribute_to_cash", lambda s, d: ag.redistribute(over(s, d), ["ECONOMY"]), f"{ow}, q as (select *, weight * scale + coalesce(case when asset = 'ECONOMY' then sum(weight) over (partition by dt) * (1 - scale) end, 0) m from w) select dt, asset, m / sum(m) over (partition by dt) weight, scale from q", "weight scale")
    tc = f"with {AGR}, rows_ as (select agr.agreement, mkt.b r from agr join mkt using (dt)), e as (select quantile_cont(agreement, 0.33) a, quantile_cont(agreement, 0.67) b, corr(agreement, r) c from rows_), q as (select case when agreement <= a then 'low' when agreement <= b then 'mid' else 'high' end tercile, r, c from rows_, e) select tercile, count(*) n, avg(r) mean_r, min(c) corr from q group by 1"
    register("agreement_terciles", lambda s, d: ag.agreement_terciles(ag.agreement(agent_signals(s, d)).join(market(returns(s, d)), "dt").select("agreement", F.col("b").alias("r"))), tc, "mean_r corr")
    register("level_distribution", lambda s, d: ag.distribution(macro(s, d), "series", "value"), "select series, count(*) n, avg(value) mean, min(value) lo, max(value) hi, count(*)::double / (select count(*) from macro) share from macro group by 1", "mean lo hi share")
