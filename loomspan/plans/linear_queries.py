"""Queries on regressions from moment matrices, bootstraps, ranks, fitted transforms, pluggable parts and agents with state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import backtest as bt
from loomspan.operators import linear as ln
from loomspan.operators import metrics as mt
from loomspan.operators import panels as pn
from loomspan.operators import plugins as pl
from loomspan.operators import ranks as rk
from loomspan.operators import research as rs
from loomspan.operators import resampling as bs
from loomspan.operators import returns as rt
from loomspan.operators import stats as st
from loomspan.operators import transforms as tf
from loomspan.operators import windows as wd
from loomspan.plans.model_queries import FEATURES, labelled
from loomspan.plans.panel_queries import CAL, EQUAL, HELD, RB, equal
from loomspan.plans.risk_queries import PAIRS, PANEL, panel
from loomspan.plans.series_queries import W
from loomspan.plans.sql_parts import LABEL, adf_sql, boot_sql, f_tail_sql, gram_sql, interval_sql, list_gram_sql, normal_tail_sql, sweep_sql, t_tail_sql
from loomspan.plans.views import macro, market, prices, returns

ASSETS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
#: `labelled` with its label 5 rows ahead.
LABELLED = f"""
fa as (select dt, asset, px, px / lag(px, 21) over ({W}) - 1 mom_21d, px / lag(px, 63) over ({W}) - 1 mom_63d,
  px / first_value(px) over ({W}) grown, lead(px, 5) over ({W}) / px - 1 y from prices),
fb as (select *, grown / avg(grown) over (partition by dt) rel_strength from fa),
fv as (select dt, asset, case when count(r) over w >= 10 then stddev_samp(r) over w * sqrt(252) end vol_21d from rets window w as ({W} rows between 20 preceding and current row)),
lt as (select dt, asset, mom_21d, mom_63d, rel_strength, vol_21d, y, row_number() over ({W}) - 1 i,
  floor((year(dt) * 12 + month(dt) - 1) / 3)::bigint m
  from fb join fv using (dt, asset) where mom_63d is not null and rel_strength is not null and vol_21d is not null and y is not null)
""".strip()


# ---- regressions ----------------------------------------------------------------------------------------------------------


def factor_rows(s, d):
    """Returns with the market's, and small less large assets'."""
    r = returns(s, d)
    wide = r.groupBy("dt").pivot("asset", ["SMALL", "LARGE"]).agg(F.first("r")).select("dt", (F.col("SMALL") - F.col("LARGE")).alias("SMB"))
    return r.join(wide, "dt").join(market(r).withColumnRenamed("b", "MKT"), "dt")


FACTORS = f"""
smb as (select dt, max(r) filter (asset = 'SMALL') - max(r) filter (asset = 'LARGE') smb from rets group by 1),
fr as (select asset, dt as row, r, smb, b mkt from rets join smb using (dt) join mkt using (dt) where smb is not null),
fx as (select asset, row, unnest([0, 1, 2, 3]) i, unnest([1.0, smb, mkt, r]) v from fr),
{gram_sql('fg', 'fx', 'asset')},
{sweep_sql('fs', 'fg', 'asset', 0, 3)},
beta as (select asset, i, v b from fs where j = 3 and i < 3),
res as (select asset, row, r - sum(v * b) e from fx join beta using (asset, i) join fr using (asset, row) group by asset, row, r),
mid as (select asset, x.i, z.i j, sum(x.v * z.v * e * e) v from fx x join fx z using (asset, row) join res using (asset, row) where x.i < 3 and z.i < 3 group by all),
cnt as (select asset, count(*) n, var_pop(r) * count(*) sst from fr group by 1),
err as (select p.asset, p.i, sum(p.v * mid.v * q.v) s from fs p join mid on mid.asset = p.asset and mid.i = p.j join fs q on q.asset = p.asset and q.i = mid.j and q.j = p.i where p.i < 3 and p.j < 3 group by 1, 2),
fin as (select asset, i, b as beta, sqrt(greatest(0, s * n / (n - 3))) se, n, 1 - fs.v / sst r2
  from beta join err using (asset, i) join cnt using (asset) join (select asset, v from fs where i = 3 and j = 3) fs using (asset)),
ft as (select *, beta / se t from fin)
""".strip()


def regressions() -> None:
    sql = f"""with recursive {FACTORS}
select asset, ['const', 'SMB', 'MKT'][i + 1] term, beta, se, t, {t_tail_sql('t', 'n - 3')} p_value, r2, 1 - (1 - r2) * (n - 1) / (n - 3) adj_r2 from ft"""
    register("factor_regression", lambda s, d: ln.factor_regression(factor_rows(s, d), ["SMB", "MKT"]), sql, "beta se t p_value r2 adj_r2")

    n = len(ASSETS)
    sql = f"""with recursive full_ as (select dt from rets group by 1 having count(*) = {n}),
vx as (select 1 k, dt as row, dense_rank() over (order by asset) - 1 i, asset, r v from rets join full_ using (dt)),
{gram_sql('vg', 'vx', 'k')},
{sweep_sql('vs', 'vg', 'k', 0, n)}
select distinct asset, vg.v * vs.v vif from vg join vs using (i, j) join vx using (i) where vg.i = vg.j"""
    register("variance_inflation", lambda s, d: ln.variance_inflation(returns(s, d), ASSETS), sql, "vif")
    register("inflation_selection", lambda s, d: ln.inflation_selection(returns(s, d), ASSETS, 1.002))

    sql = f"""with {PAIRS},
m as (select a, b, avg(ra) mx, avg(rb) my, avg(ra * ra) xx, avg(rb * rb) yy, stddev_pop(ra) sx, stddev_pop(rb) sy, count(*) n from pairs group by 1, 2),
u as (select a, b, row_number() over (partition by a, b order by dt) i, n, floor(n ** (1 / 3.0) + 1e-9) l,
  xx / sx ** 3 * (ra - mx) - yy / sy ** 3 * (rb - my) - mx / sx ** 3 / 2 * (ra * ra - xx) + my / sy ** 3 / 2 * (rb * rb - yy) u
  from pairs join m using (a, b)),
c as (select p.a, p.b, q.i - p.i k, sum(p.u * q.u) / min(p.n) c, min(p.l) l from u p join u q on q.a = p.a and q.b = p.b and q.i between p.i and p.i + p.l group by 1, 2, 3),
v as (select a, b, sum(case when k = 0 then c else 2 * (1 - k / (l + 1)) * c end) v from c group by 1, 2),
z as (select a, b, mx / sx - my / sy diff, sqrt(greatest(0, v) / n) se, (mx / sx - my / sy) / sqrt(greatest(0, v) / n) z from m join v using (a, b))
select *, {normal_tail_sql('z')} p_value from z"""
    register("sharpe_difference", lambda s, d: ln.sharpe_difference(wd.pairs(returns(s, d))), sql, "diff se z p_value")

    # A model of each quarter, of all rows whose labels were known before it.
    cells = "mom_21d, mom_63d, rel_strength, vol_21d"
    models = f"""{LABELLED},
ahead as (select asset, i, i as row, m, lead(m, 5) over (partition by asset order by i) since, {cells}, y from lt),
wx as (select asset, row, since, unnest([0, 1, 2, 3, 4, 5]) i, unnest([1.0, {cells}, y]) v from ahead where since is not null),
w0 as (select asset, since, p.i, q.i j, sum(p.v * q.v) v from wx p join wx q using (asset, row, since) group by all),
wg as (select pm.asset, pm.m, w0.i, w0.j, sum(w0.v) v from (select distinct asset, m from lt) pm join w0 on w0.asset = pm.asset and w0.since < pm.m group by all),
wn as (select asset, m, v n from wg where i = 0 and j = 0 and v >= 100),
wk as (select asset, m, i, j, v from wg join wn using (asset, m)),
{sweep_sql('wc', 'wk', 'asset, m', 0, 1)},
wr as (select asset, m, i, j, case when i = j and i between 1 and 4 then v * (1 + 1.0 / n) else v end v from wc join wn using (asset, m)),
{sweep_sql('ws', 'wr', 'asset, m', 1, 5)}"""
    score = "sum(case x.i when 0 then b.v else b.v * x.v end)"
    sql = f"""with recursive {models},
xs as (select asset, dt, m, unnest([0, 1, 2, 3, 4]) i, unnest([1.0, {cells}]) v from lt)
select x.asset, x.dt, {score} p from xs x join ws b on b.asset = x.asset and b.m = x.m and b.i = x.i and b.j = 5 group by 1, 2"""
    register("walk_forward_forecasts", lambda s, d: ln.walk_forward(labelled(s, d), FEATURES, horizon=5), sql, "p")

    def in_states(s, d):
        level = macro(s, d).where("series = '1-URGENT'").select("dt", "value")
        return pn.asof(labelled(s, d), level, "value").withColumn("high", F.col("value") > 150000)

    part = lambda name, where: f"""
{name} as (select pm.asset, pm.m, count(*) n, avg(y) ym, avg(mom_21d) xm, avg(vol_21d) zm, covar_pop(mom_21d, y) xy, covar_pop(vol_21d, y) zy,
  covar_pop(mom_21d, vol_21d) xz, var_pop(mom_21d) xx, var_pop(vol_21d) zz
  from (select distinct asset, m from st) pm join st on st.asset = pm.asset and st.since < pm.m where {where} group by 1, 2),
{name}b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) b2 from {name}),
{name}c as (select asset, m, n, ym - b1 * xm - b2 * zm b0, b1, b2 from {name}b)""".strip()  # noqa: E731
    sql = f"""with {LABELLED},
lv as (select dt, value from macro where series = '1-URGENT'),
st as (select lt.*, lead(m, 5) over (partition by asset order by i) since, lv.value > 150000 high from lt asof left join lv on lt.dt >= lv.dt),
{part('al', 'true')}, {part('hi', 'high')}, {part('lo', 'not high')},
pk as (select st.*, al.b0 a0, al.b1 a1, al.b2 a2, case when st.high then hi.n else lo.n end own, case when st.high then hi.b0 else lo.b0 end o0,
  case when st.high then hi.b1 else lo.b1 end o1, case when st.high then hi.b2 else lo.b2 end o2
  from st join alc al using (asset, m) left join hic hi using (asset, m) left join loc lo using (asset, m) where al.n >= 100)
select asset, dt, case when own > 100 then o0 + o1 * mom_21d + o2 * vol_21d else a0 + a1 * mom_21d + a2 * vol_21d end p from pk"""
    register("regime_conditional_forecasts", lambda s, d: ln.walk_forward(in_states(s, d), ["mom_21d", "vol_21d"], horizon=5, l2=0.0, state="high"), sql, "p")


# ---- tests of series --------------------------------------------------------------------------------------------------------

LEVELS = f"sr as materialized (select asset, row_number() over ({W}) - 1 j, px x from prices)"
KPSS = """
ke as materialized (select asset, j, x - avg(x) over (partition by asset) e, count(*) over (partition by asset) n from sr),
k0 as (select asset, min(n) n, sum(e * e) e2 from ke group by 1),
kc as (select p.asset, p.j - q.j k, sum(p.e * q.e) c from ke p join ke q on q.asset = p.asset and p.j - q.j between 1 and floor(p.n ** (2 / 9.0)) group by 1, 2),
kl as materialized (select asset, n, e2, floor(1.1447 * ((sum(k * c / (n / 2)) / (e2 / n + sum(c / (n / 2)))) ** 2) ** (1 / 3.0) * n ** (1 / 3.0))::bigint l from kc join k0 using (asset) group by asset, n, e2),
kv as (select p.asset, p.j - q.j k, sum(p.e * q.e) c from ke p join kl using (asset) join ke q on q.asset = p.asset and p.j - q.j between 1 and least(l, p.n - 1) group by 1, 2),
kw as (select asset, n, e2 / n + coalesce(sum(2 * (1 - k / (l + 1.0)) * c / n), 0) v from kl left join kv using (asset) group by asset, n, e2),
ku as (select asset, sum(t * t) s from (select asset, sum(e) over (partition by asset order by j) t from ke) group by 1),
kp as (select asset, s / (n * n * v) kpss from kw join ku using (asset))""".strip()
GRANGER = f"""
gs as materialized (select a, b, row_number() over (partition by a, b order by dt) - 1 t, count(*) over (partition by a, b) len, ra, rb from pairs),
gk as (select a, b, unnest(range(1, 6)) k, min(len) len from gs group by a, b),
gr as materialized (select gs.*, k, 2 * k + 1 upto from gs join gk using (a, b) where t >= k and gk.len - k > 3 * k + 1),
gl as materialized (select a, b, k, upto, t, lag_, t - lag_ at_ from gr, (select unnest(range(1, 6)) lag_) where lag_ <= k),
gx as materialized (
  select a, b, k, upto, t as row, unnest([0, {LABEL}]) i, unnest([1.0, rb]) v from gr
  union all select a, b, k, upto, t, lag_, rb from gl join (select a, b, t at_, rb, ra from gs) using (a, b, at_)
  union all select a, b, k, upto, t, k + lag_, ra from gl join (select a, b, t at_, rb, ra from gs) using (a, b, at_)),
{list_gram_sql('gg', 'gx', 'a, b, k, upto')},
{sweep_sql('gw', 'gg', 'a, b, k, upto', 0, 'upto')},
gt as (select a, b, k, max(v) filter (step = 1 + k) small, max(v) filter (step = 1 + 2 * k) full_, min(len) - 3 * k - 1 df from gw_steps join gk using (a, b, k) where i = {LABEL} and j = {LABEL} group by a, b, k),
gf as (select a, b, k, df, (small - full_) / k / (full_ / df) f from gt),
gp as (select a, b, k, f, {f_tail_sql('f', 'k', 'df')} p from gf),
gb as (select a, b, arg_min(f, p) f, arg_min(k, p) as lag, min(p) p_value from gp group by 1, 2),
cu as materialized (select a, b, t j, sum(ra) over (partition by a, b order by t) x, sum(rb) over (partition by a, b order by t) y from gs),
cl as (select a, b, regr_slope(y, x) slope, regr_intercept(y, x) base from cu group by 1, 2),
ce as materialized (select a, b, j, y - base - slope * x x from cu join cl using (a, b))""".strip()


def series_tests() -> None:
    sql = f"""with recursive {LEVELS}, {KPSS}, {adf_sql('u', 'sr', 'asset')}
select asset, n, adf, lags, adf < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 adf_stationary, kpss, kpss < 0.463 kpss_stationary from u_adf join kp using (asset)"""
    register("stationarity_report", lambda s, d: st.stationarity_report(prices(s, d)), sql, "adf kpss")
    sql = f"""with recursive {PAIRS}, {GRANGER}, {adf_sql('c', 'ce', 'a, b')}
select a, b, f, lag, p_value, adf coint, adf < -3.33613 - 6.1101 / n - 6.823 / n ** 2 cointegrated from gb join c_adf using (a, b)"""
    register("pair_tests", lambda s, d: st.pair_tests(wd.pairs(returns(s, d))), sql, "f p_value coint")


# ---- bootstraps and ranks -------------------------------------------------------------------------------------------------


def resamples() -> None:
    sharpe = "case when stddev_samp(r) > 1e-12 then avg(r) / stddev_samp(r) * sqrt(252) else 0 end"
    doubles = "mean lo hi"
    boot = lambda **k: lambda s, d: st.interval(bs.block_bootstrap(returns(s, d), **k))
    register("bootstrap_interval", boot(reps=1000, block=1), interval_sql(sharpe, boot_sql(1000, 1)), doubles)
    register("block_bootstrap_sharpe", boot(reps=1000), interval_sql(sharpe, boot_sql(1000, 21)), doubles)
    register("circular_bootstrap", boot(name="total", reps=500, circular=True), interval_sql("exp(sum(ln(1 + r))) - 1", boot_sql(500, 21, True)), doubles)
    names = ["terminal", "annual_return", "volatility", "max_drawdown"]
    quantiles = [f"quantile_cont({c}, {q}) {c}_q{int(q * 100)}" for c in names for q in (0.01, 0.05, 0.5)]
    paths = """
gg as (select *, exp(sum(ln(1 + r)) over (partition by asset, rep order by t)) g from yy),
dd as (select *, g / max(g) over (partition by asset, rep order by t) - 1 dd from gg),
pp as (select asset, rep, arg_max(g, t) terminal, avg(r) * 252 annual_return, stddev_pop(r) * sqrt(252) volatility, min(dd) max_drawdown from dd group by 1, 2)"""
    sql = f"with {boot_sql(200, 21, length=252)}, {paths.strip()} select asset, {', '.join(f'avg({c}) {c}_mean' for c in names)}, {', '.join(quantiles)} from pp group by 1"
    register("monte_carlo_stress", lambda s, d: bs.monte_carlo_stress(returns(s, d), reps=200), sql, " ".join([f"{c}_mean" for c in names] + [q.split()[-1] for q in quantiles]))

    rank = lambda c: f"rank() over (partition by asset, i order by {c}) + (count(*) over (partition by asset, i, {c}) - 1) / 2.0"
    sql = f"""with {PANEL},
q as (select *, row_number() over ({W}) i from panel),
f as (select x.asset, x.dt, x.i, z.p, z.y from q x join q z on z.asset = x.asset and z.i between x.i - 63 and x.i - 1),
k as (select asset, dt, i, {rank('p')} rp, {rank('y')} ry from f)
select asset, dt, case when stddev_pop(rp) > 0 and stddev_pop(ry) > 0 then corr(rp, ry) end rank_ic from k group by 1, 2 having count(*) >= 10"""
    register("rolling_rank_ic", lambda s, d: rk.rolling_rank_ic(panel(s, d)), sql, "rank_ic")

    sql = f"""with {PAIRS},
d as (select a, b, ra - rb d from pairs where ra <> rb),
k as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 k, count(*) over (partition by a, b, abs(d)) t from d),
w as (select a, b, count(*) n, least(sum(case when d > 0 then k else 0 end), sum(case when d < 0 then k else 0 end)) w, sum(t * t - 1) ties from k group by 1, 2),
z as (select a, b, n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) z from w)
select *, {normal_tail_sql('z')} p_value from z"""
    register("signed_rank_tests", lambda s, d: rk.signed_rank(wd.pairs(returns(s, d))), sql, "w z p_value")


# ---- transforms -----------------------------------------------------------------------------------------------------------


def splits(s):
    return pn.expanding_splits(s, 1500, 3, 300, 63)


def train_rows(s, d):
    return pn.rows_of_split(labelled(s, d), splits(s)).where("role = 'train'")


def transforms() -> None:
    group = lambda c: f"floor((rank() over (partition by asset, fold, feature order by {c}) - 1) * 10 / count(*) over (partition by asset, fold, feature))"
    sql = f"""with {LABELLED},
tr as (select * from lt join (select f fold, 300 + f * 63 until from range(3) t(f)) on i < until),
lg as (unpivot (select asset, fold, y, mom_21d, mom_63d, rel_strength, vol_21d from tr) on mom_21d, mom_63d, rel_strength, vol_21d into name feature value v),
b as (select asset, fold, feature, {group('v')} a, {group('y')} b from lg),
j as (select asset, fold, feature, a, b, count(*)::double n from b group by all),
t as (select *, sum(n) over (partition by asset, fold, feature) t, sum(n) over (partition by asset, fold, feature, a) na, sum(n) over (partition by asset, fold, feature, b) nb from j),
mi as (select asset, fold, feature, sum(n / t * ln(n * t / (na * nb))) mi from t group by all),
pl as (select *, row_number() over (partition by asset, fold order by round(mi, 10) desc, feature) as place from mi)
select *, place <= 2 chosen from pl"""
    register("feature_selection", lambda s, d: tf.fit_top_k(train_rows(s, d), FEATURES, ["asset", "fold"], 2), sql, "mi")

    sql = f"""with {LABELLED},
tr as (select * from lt join (select f fold, 300 + f * 63 until from range(3) t(f)) on i < until),
lg as (unpivot (select asset, fold, mom_21d, mom_63d, rel_strength, vol_21d from tr) on mom_21d, mom_63d, rel_strength, vol_21d into name feature value v)
select asset, fold, feature, avg(v) mean, stddev_pop(v) std from lg group by all"""
    register("feature_scaling", lambda s, d: tf.fit_components(train_rows(s, d), FEATURES, ["asset", "fold"], 2).select("asset", "fold", "feature", "mean", "std"), sql, "mean std")
    forecasts = lambda kind: lambda s, d: mt.prediction_metrics(tf.transformed_forecasts(labelled(s, d), splits(s), FEATURES, kind, 2), "asset")
    register("component_forecasts", forecasts("components"))
    register("selected_forecasts", forecasts("top_k"))


# ---- pluggable parts ------------------------------------------------------------------------------------------------------


def traded(s, d):
    """(asset, vol, volume): annual volatility, and the mean daily value of an asset's lines."""
    from loomspan.plans.views import table

    value = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    days = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("asset"), F.to_date("l_shipdate").alias("dt")).agg(value.alias("v"))
    vol = returns(s, d).groupBy("asset").agg((F.stddev_samp("r") * 252**0.5).alias("vol"))
    return vol.join(days.groupBy("asset").agg(F.avg("v").alias("volume")), "asset")


def pluggable() -> None:
    names = list(pl.EXPECTED)
    w = f"({W} rows between 252 preceding and 1 preceding)"
    sql = f"""with {CAL}, rb as (select dt from cal where i >= 252 and (i - 252) % 21 = 0),
e as (select asset, dt, count(r) over w n, avg(r) over w * 252 mean, median(r) over w * 252 median, exp(avg(ln(1 + r)) over w * 252) - 1 geometric,
  avg(greatest(-0.02, least(0.02, r))) over w * 252 trimmed from rets window w as {w})
select dt, asset, {', '.join(names)} from e join rb using (dt) where n >= 20"""
    register("expected_return_models", lambda s, d: pl.expected_returns(returns(s, d), bt.schedule(prices(s, d), 21, 252), names), sql, " ".join(names))

    models = list(pl.COSTS)
    sql = f"""with {RB}, {EQUAL}, {HELD.strip()},
ld as (select p_type asset, cast(l_shipdate as date) dt, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) v from lineitem join part on l_partkey = p_partkey group by 1, 2),
mk as (select * from (select asset, stddev_samp(r) * sqrt(252) vol from rets group by 1) join (select asset, avg(v) volume from ld group by 1) using (asset)),
ch as (select strategy, dt, asset, abs(sum(case when dt = since then target else 0 end) - sum(case when closing then coalesce(weight, 0) else 0 end)) m,
  bool_or(closing or dt = since) on_, sum(case when dt > since then value end) now_, sum(case when dt > since then before end) was from dr group by 1, 2, 3),
pc as (select strategy, dt, coalesce(sum(now_) / nullif(sum(was), 0) - 1, 0) g, coalesce(sum(m * 10 / 1e4) filter (on_), 0) proportional,
  coalesce(sum(case when m > 1e-9 then 1e-5 else 0 end) filter (on_), 0) per_trade, coalesce(sum(0.1 * vol * sqrt(m * 1e6 / volume) * m) filter (on_), 0) impact
  from ch join mk using (asset) group by 1, 2),
al as (select *, proportional + per_trade + impact as "all" from pc)
select strategy, dt, model, g - cost r, cost from (unpivot (select strategy, dt, g, proportional::double proportional, per_trade::double per_trade, impact, "all" from al) on proportional, per_trade, impact, "all" into name model value cost)"""
    register("cost_models", lambda s, d: pl.priced_returns(*equal(s, d), traded(s, d), models), sql, "r cost")

    sql = f"""with {PANEL} select asset, -avg((y - p) ** 2) neg_mse, -avg(abs(y - p)) neg_mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(y)) r2, corr(y, p) ic,
  avg(case when sign(y) = sign(p) then 1.0 else 0 end) direction from panel group by 1"""
    register("model_scores", lambda s, d: pl.scored(panel(s, d), ["asset"], list(pl.SCORES)), sql, " ".join(pl.SCORES))


# ---- agents with state ----------------------------------------------------------------------------------------------------

CLASSES = {"equity": ["STANDARD", "SMALL", "LARGE"], "bond": ["ECONOMY", "MEDIUM"], "alt": ["PROMO"]}
TILTS = {"defensive": {"MEDIUM": 0.02, "PROMO": 0.015}, "risk_on": {"SMALL": 0.015, "LARGE": 0.01}}
#: Agents by name: the rows of their momentum.
LOOKBACKS = {"fast": 21, "slow": 63}


def market_level(s, d):
    """(dt, asset, level, spread): the latest known values of a volatility and of a yield spread, over each price row."""
    m = macro(s, d)
    level = m.where("series = '1-URGENT'").select("dt", (F.col("value") / 7500).alias("level"))
    wide = m.groupBy("dt").pivot("series", ["2-HIGH", "3-MEDIUM"]).agg(F.first("value"))
    spread = wide.select("dt", ((F.col("2-HIGH") - F.col("3-MEDIUM")) / 50000).alias("spread"))
    return pn.asof(pn.asof(prices(s, d), level, "level"), spread, "spread")


def agent_rounds(s, d):
    """(agent, dt, asset, momentum, actual): each agent's momentum on rebalance dates, and the return of the next 21 rows."""
    p, w = prices(s, d), Window.partitionBy("asset").orderBy("dt")
    rows = p.select("dt", "asset", (F.lead("px", 21).over(w) / F.col("px") - 1).alias("actual"), *[F.coalesce(F.lag("px", 1).over(w) / F.lag("px", n).over(w) - 1, F.lit(0.0)).alias(a) for a, n in LOOKBACKS.items()])
    rows = rows.join(F.broadcast(bt.schedule(p, 21, 252).select("dt")), "dt")
    return rows.unpivot(["dt", "asset", "actual"], list(LOOKBACKS), "agent", "momentum")


def adaptive_states(s, d):
    rounds = agent_rounds(s, d)
    record = rs.track_record(rounds.select("agent", "dt", "asset", F.col("momentum").alias("signal")), rounds.where("agent = 'fast'").select("dt", "asset", "actual"))
    return rs.adapted(record)


def agents() -> None:
    def regimes(s, d):
        rows = market_level(s, d).withColumn("state", rs.market_state(F.col("level"), F.col("spread")))
        return rows.select("dt", "asset", "state", rs.state_signal(F.col("state"), F.col("asset"), CLASSES, TILTS, 0.7).alias("signal"))

    sql = """with lv as (select dt, value / 7500 as level from macro where series = '1-URGENT'),
sp as (select h.dt, (h.value - m.value) / 50000 spread from macro h join macro m on m.dt = h.dt and h.series = '2-HIGH' and m.series = '3-MEDIUM'),
q as (select p.dt, p.asset, coalesce(lv.level, 20.0) as level, sp.spread from prices p asof left join lv on p.dt >= lv.dt asof left join sp on p.dt >= sp.dt),
a as (select *, case when level > 25 then 2 when level < 15 then 0 else 1 end base from q),
b as (select *, ['risk_on', 'balanced', 'defensive'][least(2, base + case when spread < -0.5 then 1 else 0 end) + 1] state from a),
k(state, class, w) as (values ('defensive', 'equity', -0.03), ('defensive', 'bond', 0.04), ('defensive', 'alt', 0.02), ('risk_on', 'equity', 0.04), ('risk_on', 'bond', -0.02),
  ('risk_on', 'alt', 0.01), ('balanced', 'equity', 0.01), ('balanced', 'bond', 0.01), ('balanced', 'alt', 0.005)),
t(state, asset, tilt) as (values ('defensive', 'MEDIUM', 0.02), ('defensive', 'PROMO', 0.015), ('risk_on', 'SMALL', 0.015), ('risk_on', 'LARGE', 0.01))
select dt, b.asset, b.state, (w + coalesce(tilt, 0)) * 0.7 signal from b
join k on k.state = b.state and k.class = case when b.asset in ('ECONOMY', 'MEDIUM') then 'bond' when b.asset = 'PROMO' then 'alt' else 'equity' end
left join t on t.state = b.state and t.asset = b.asset"""
    register("regime_agent", regimes, sql, "signal")

    states = f"""with recursive {CAL}, rb as (select dt from cal where i >= 252 and (i - 252) % 21 = 0),
mo as (select dt, asset, lead(px, 21) over ({W}) / px - 1 actual, coalesce(lag(px, 1) over ({W}) / lag(px, 21) over ({W}) - 1, 0) fast,
  coalesce(lag(px, 1) over ({W}) / lag(px, 63) over ({W}) - 1, 0) slow from prices),
ro as (select mo.*, a.agent, case a.agent when 'fast' then fast else slow end momentum from mo join rb using (dt), (values ('fast'), ('slow')) a(agent)),
re as (select agent, dt, case when stddev_pop(momentum) filter (actual is not null) > 1e-12 and stddev_pop(actual) > 1e-12 then corr(momentum, actual) end ic from ro group by 1, 2),
nu as (select *, row_number() over (partition by agent order by dt) i, coalesce(avg(ic) over (partition by agent order by dt rows between 10 preceding and 1 preceding), 0) recent,
  case when count(*) over (partition by agent order by dt rows between 5 preceding and 1 preceding) >= 5
    then avg(coalesce(ic, 0)) over (partition by agent order by dt rows between 5 preceding and 1 preceding) else 0 end better from re),
ad as (
  select agent, 0::bigint i, null::date dt, 0.6::double confidence, 0.5::double blend from (select distinct agent from nu)
  union all
  select nu.agent, nu.i, nu.dt,
    case when recent > 0.05 then least(confidence + 0.05, 0.95) when recent < -0.05 then greatest(confidence - 0.1, 0.1) else confidence + (0.6 - confidence) * 0.1 end,
    case when better > 1e-9 then least(blend + 0.05, 0.9) when better < -1e-9 then greatest(blend - 0.05, 0.1) else blend end
  from ad join nu on nu.agent = ad.agent and nu.i = ad.i + 1)"""
    register("adaptive_agent", adaptive_states, f"{states} select agent, dt, confidence, blend from ad where i > 0", "confidence blend")

    def signals(s, d):
        both = agent_rounds(s, d).join(adaptive_states(s, d), ["agent", "dt"])
        return both.select("agent", "dt", "asset", rs.blended_signal(F.col("momentum"), F.col("blend"), F.col("confidence")).alias("signal"))

    register("adaptive_signals", signals, f"{states} select ro.agent, ro.dt, asset, (2 * blend - 1) * momentum * confidence signal from ro join ad on ad.agent = ro.agent and ad.dt = ro.dt", "signal")


def register_all() -> None:
    for part in (regressions, series_tests, resamples, transforms, pluggable, agents):
        part()
