"""Queries on risk, forecasts' quality, tests and allocation."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import allocation as al
from loomspan.operators import metrics as mt
from loomspan.operators import stats as st
from loomspan.operators import windows as wd
from loomspan.plans.series_queries import W
from loomspan.plans.views import market, prices, returns

GROWN = f"g as (select *, exp(sum(ln(1 + r)) over ({W})) g from rets), dd as (select *, g / max(g) over ({W}) - 1 dd from g), v as (select asset, quantile_cont(r, 0.05) v from rets group by 1), t as (select dd.*, v.v from dd join v using (asset))"
SKEW = "(avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*avg(r)**3) / stddev_pop(r)**3"
KURT = "(avg(r*r*r*r) - 4*avg(r)*avg(r*r*r) + 6*avg(r)**2*avg(r*r) - 3*avg(r)**4) / var_pop(r)**2 - 3"
ARITHMETIC = f"select asset, avg(r) * 252 annual_return, stddev_samp(r) * sqrt(252) annual_volatility, avg(r) / stddev_samp(r) * sqrt(252) sharpe, avg(r) * 252 / (stddev_samp(r) filter (r < 0) * sqrt(252)) sortino, min(dd) max_drawdown, exp(sum(ln(1 + r))) - 1 total_return, min(v) var_95, avg(r) filter (r <= v) cvar_95, {SKEW} skew, {KURT} kurtosis, avg(case when r > 0 then 1.0 else 0 end) * 100 winning_pct, avg(r) * 252 / abs(min(dd)) calmar from t group by asset"
ARITHMETIC_DOUBLES = "annual_return annual_volatility sharpe sortino max_drawdown total_return var_95 cvar_95 skew kurtosis winning_pct calmar"
PAIRS = "pairs as (select x.dt, x.asset a, y.asset b, x.r ra, y.r rb from rets x join rets y on x.dt = y.dt and x.asset < y.asset)"
Z = -1.6448536269514722
PANEL = f"panel as (select * from (select asset, dt, r p, lead(r) over ({W}) y from rets) where y is not null)"


def arithmetic_sql(table: str, key: str) -> str:
    """The metrics of `table` (key, dt, r), to stand after its definition: CTEs and the final select."""
    named = {"asset": key, "rets": table}
    return re.sub(r"\b(asset|rets)\b", lambda m: named[m[0]], f"{GROWN} {ARITHMETIC}")


def panel(spark, sf_dir):
    """(asset, dt, p, y): yesterday's return as the forecast of the next row's."""
    w = Window.partitionBy("asset").orderBy("dt")
    return returns(spark, sf_dir).select("asset", "dt", F.col("r").alias("p"), F.lead("r").over(w).alias("y")).where(F.col("y").isNotNull())


def equal_weights(prices):
    n = F.count(F.lit(1)).over(Window.partitionBy("dt"))
    return prices.select("dt", "asset", (1 / n).alias("weight"))


def named_weights(returns):
    """(name, asset, weight): equal and by inverse volatility."""
    v = returns.groupBy("asset").agg((1 / F.stddev_samp("r")).alias("_i"))
    both = v.crossJoin(v.agg(F.sum("_i").alias("_t"), F.count(F.lit(1)).alias("_n")))
    return both.select(F.lit("inverse_vol").alias("name"), "asset", (F.col("_i") / F.col("_t")).alias("weight")).unionByName(both.select(F.lit("equal").alias("name"), "asset", (1 / F.col("_n")).alias("weight")))


COV = f"{PAIRS}, off as (select a, b, covar_samp(ra, rb) * 252 cov from pairs group by 1, 2), cov as (select a i, b j, cov from off union all select b, a, cov from off union all select asset, asset, var_samp(r) * 252 from rets group by asset), iv as (select asset, 1 / stddev_samp(r) i from rets group by 1), wts as (select 'inverse_vol' as name, asset, i / (select sum(i) from iv) weight from iv union all select 'equal', asset, 1.0 / (select count(*) from iv) from iv), sw as (select w.name, c.i asset, sum(c.cov * w.weight) sw from cov c join wts w on c.j = w.asset group by 1, 2), pv as (select wts.name, sum(weight * sw) v from wts join sw using (name, asset) group by 1)"


def register_all() -> None:
    geo = f"with {GROWN} select asset, exp(sum(ln(1 + r))) ** (252.0 / count(r)) - 1 annual_return, stddev_samp(r) * sqrt(252) annual_volatility, avg(r) / stddev_samp(r) * sqrt(252) sharpe, avg(r) / sqrt(avg(r * r) filter (r < 0)) * sqrt(252) sortino, sum(greatest(r, 0)) / sum(greatest(-r, 0)) omega, min(dd) max_drawdown, min(v) var_95, avg(r) filter (r <= v) cvar_95, avg(r) + ({Z}) * stddev_samp(r) parametric_var, avg(r) + (({Z}) + (({Z})**2 - 1) * ({SKEW}) / 6 + (({Z})**3 - 3 * ({Z})) * ({KURT}) / 24 - (2 * ({Z})**3 - 5 * ({Z})) * ({SKEW})**2 / 36) * stddev_samp(r) cornish_fisher_var, abs(quantile_cont(r, 0.95)) / abs(quantile_cont(r, 0.05)) tail_ratio, (exp(sum(ln(1 + r))) ** (252.0 / count(r)) - 1) / abs(min(dd)) calmar from t group by asset"
    register("risk_geometric", lambda s, d: mt.geometric(returns(s, d)), geo, "annual_return annual_volatility sharpe sortino omega max_drawdown var_95 cvar_95 parametric_var cornish_fisher_var tail_ratio calmar")
    register("risk_arithmetic", lambda s, d: mt.arithmetic(returns(s, d)), f"with {GROWN} {ARITHMETIC}", ARITHMETIC_DOUBLES)
    register("risk_periodic", lambda s, d: mt.periodic(returns(s, d)), f"with {GROWN} select asset, exp(sum(ln(1 + r))) ** (12.0 / count(r)) - 1 cagr, stddev_pop(r) * sqrt(12) volatility, avg(r) / stddev_pop(r) * sqrt(12) sharpe, min(dd) max_drawdown, avg(case when r > 0 then 1.0 else 0 end) win_rate from t group by asset", "cagr volatility sharpe max_drawdown win_rate")
    register("evaluate_oos", lambda s, d: mt.evaluate_oos(returns(s, d)), f"with {GROWN} select asset, avg(r) / stddev_samp(r) * sqrt(252) sharpe, avg(r) * 252 / (stddev_samp(r) filter (r < 0) * sqrt(252)) sortino, avg(r) * 252 annual_return, stddev_samp(r) * sqrt(252) annual_volatility, min(dd) max_drawdown, exp(sum(ln(1 + r))) - 1 total_return from t group by asset", "sharpe sortino annual_return annual_volatility max_drawdown total_return")
    register("wins_and_losses", lambda s, d: mt.wins_and_losses(returns(s, d)), "select asset, avg(case when r > 0 then 1.0 else 0 end) win_rate, avg(r) filter (r > 0) avg_win, avg(r) filter (r < 0) avg_loss, abs(avg(r) filter (r > 0) / avg(r) filter (r < 0)) win_loss_ratio from rets group by asset", "win_rate avg_win avg_loss win_loss_ratio")
    rel = "with j as (select asset, r, b, r - b d from rets join mkt using (dt)), q as (select asset, stddev_samp(d) * sqrt(252) tracking_error, avg(d) * 252 / (stddev_samp(d) * sqrt(252)) information_ratio, covar_samp(r, b) / var_samp(b) beta, avg(r) ar, avg(b) ab, exp(sum(ln(1 + r))) ** (252.0 / count(r)) - 1 gr, exp(sum(ln(1 + b))) ** (252.0 / count(b)) - 1 gb, avg(r) filter (b > 0) / avg(b) filter (b > 0) up_capture, avg(r) filter (b < 0) / avg(b) filter (b < 0) down_capture, avg(d) * 252 active_return from j group by asset) select asset, tracking_error, information_ratio, beta, up_capture, down_capture, active_return, (ar - beta * ab) * 252 alpha, gr - beta * gb jensen_alpha, gr / beta treynor, up_capture / down_capture capture_ratio from q"
    register("relative_metrics", lambda s, d: mt.relative(r := returns(s, d), market(r)), rel, "tracking_error information_ratio beta up_capture down_capture active_return alpha jensen_alpha treynor capture_ratio")
    dur = f"with g as (select *, round(sum(ln(1 + r)) over ({W}), 12) g from rets), t as (select *, max(g) over ({W}) top from g), f as (select *, sum(case when g < top then 0 else 1 end) over ({W}) n from t), e as (select asset, n, count(*) c from f where g < top group by 1, 2) select asset, max(c) max_duration from e group by 1"
    register("drawdown_duration", lambda s, d: mt.drawdown_duration(returns(s, d)), dur)
    register("stability", lambda s, d: mt.stability(returns(s, d)), f"with q as (select asset, sum(ln(1 + greatest(r, -0.9999))) over ({W}) y, row_number() over ({W}) t from rets) select asset, corr(t, y) ** 2 stability from q group by 1", "stability")
    tail = "with l as (select unnest([0.90, 0.95, 0.975, 0.99]::double[]) level), v as (select asset, level, case level when 0.9 then quantile_cont(r, 0.1) when 0.95 then quantile_cont(r, 0.05) when 0.975 then quantile_cont(r, 0.025) else quantile_cont(r, 0.01) end v from rets, l group by asset, level) select asset, level, min(v) var, avg(r) filter (r <= v) cvar from rets join v using (asset) group by asset, level"
    register("tail_risk", lambda s, d: mt.tail_risk(returns(s, d)), tail, "level var cvar")
    rk = lambda c: f"rank() over (partition by asset order by {c}) + (count(*) over (partition by asset, {c}) - 1) / 2.0"
    pm = f"with {PANEL}, q as (select *, y - p e, {rk('y')} ry, {rk('p')} rp from panel) select asset, avg(e * e) mse, sqrt(avg(e * e)) rmse, avg(abs(e)) mae, 1 - sum(e * e) / (var_pop(y) * count(y)) r2, avg(abs(e / y)) filter (y <> 0) * 100 mape, avg(case when sign(y) = sign(p) then 1.0 else 0 end) directional_accuracy, corr(ry, rp) rank_ic, corr(y, p) pearson_ic from q group by asset"
    register("prediction_metrics", lambda s, d: mt.prediction_metrics(panel(s, d)), pm, "mse rmse mae r2 mape directional_accuracy rank_ic pearson_ic")
    register("top_k_hits", lambda s, d: mt.top_k_hits(panel(s, d)), f"with {PANEL}, q as (select *, row_number() over (partition by dt order by y desc, asset) <= 3 ty, row_number() over (partition by dt order by p desc, asset) <= 3 tp from panel), h as (select dt, count(*) filter (ty and tp) / 3.0 h from q group by 1) select avg(h) hit_rate, count(*) dates from h", "hit_rate")
    register("decile_spread", lambda s, d: mt.decile_spread(panel(s, d)), f"with {PANEL}, q as (select *, row_number() over (partition by asset order by p, dt) i, count(*) over (partition by asset) n from panel), k as (select *, case when n < 10 then n // 2 else n // 10 end k from q) select asset, avg(y) filter (i > n - k) - avg(y) filter (i <= k) spread from k group by 1", "spread")
    register("calibration_bins", lambda s, d: mt.calibration(panel(s, d)), f"with {PANEL}, e as (select unnest(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) e from panel), d as (select list(distinct e) e from e), q as (select panel.*, len(list_filter(d.e, lambda x: p > x))::int bin from panel, d) select bin, count(*) n, avg(p) mean_p, avg(y) mean_y, stddev_samp(y) std_y, avg(p - y) bias from q group by 1", "mean_p mean_y std_y bias")
    register("prediction_summary", lambda s, d: mt.prediction_summary(panel(s, d)), f"with {PANEL} select asset, count(*) n, avg(p) mean_p, stddev_pop(p) std_p, avg(y) mean_y, stddev_pop(y) std_y, corr(p, y) corr, sqrt(avg((p - y) ** 2)) rmse, avg(p - y) bias from panel group by 1 having count(*) >= 5", "mean_p std_p mean_y std_y corr rmse bias")
    register("summary_statistics", lambda s, d: mt.summarize(returns(s, d), "r", "asset"), "select asset, count(r) n, avg(r) mean, stddev_samp(r) std, min(r) as min, quantile_cont(r, 0.25) q25, quantile_cont(r, 0.5) q50, quantile_cont(r, 0.75) q75, max(r) as max, skewness(r) skew, kurtosis(r) kurtosis, avg(case when r is null then 1.0 else 0 end) * 100 null_pct, avg(case when r = 0 then 1.0 else 0 end) * 100 zero_pct from rets group by 1", "mean std min q25 q50 q75 max skew kurtosis null_pct zero_pct")
    register("price_quality", lambda s, d: mt.price_quality(prices(s, d)), f"with q as (select *, px / lag(px) over ({W}) - 1 r from prices) select asset, count(px) n, min(dt) first_dt, max(dt) last_dt, count(*) filter (abs(r) > 0.1) extreme, max(abs(r)) max_abs_ret, count(*) filter (r = 0) zero_days, count(*) filter (px <= 0) nonpositive from q group by 1", "max_abs_ret")
    register("frame_validation", lambda s, d: mt.validate(prices(s, d), "px", ["asset", "dt"]), "with k as (select asset, dt, count(*) n from prices group by 1, 2) select (select count(*) from k where n > 1) repeated_keys, (select sum(n) from k)::bigint as rows, count(*) filter (px is null) nulls, count(*) filter (isinf(px) or isnan(px)) infinite from prices")
    register("return_validation", lambda s, d: mt.validate_returns(returns(s, d)), "select asset, count(*) filter (r <> 0) = 0 all_zero, min(r) = max(r) constant, count(*) filter (r > 1 or r < -0.5) > 0 extreme, avg(case when r is null then 1.0 else 0 end) > 0.1 sparse from rets group by 1")
    conc = "with w as (select dt, asset, px / sum(px) over (partition by dt) weight from prices), k as (select *, row_number() over (partition by dt order by weight desc, asset) i, count(*) over (partition by dt) n from w) select dt, sum(weight * weight) hhi, 1 / sum(weight * weight) effective_n, max(weight) max_weight, sum((2 * i - n - 1) * weight) / (min(n) * sum(weight)) gini from k group by 1"
    register("weight_concentration", lambda s, d: mt.concentration(prices(s, d).select("dt", "asset", (F.col("px") / F.sum("px").over(Window.partitionBy("dt"))).alias("weight"))), conc, "hhi effective_n max_weight gini")
    cost = f"with w as (select *, px / sum(px) over (partition by dt) weight from prices), t as (select dt, asset, weight wn, coalesce(lag(weight) over ({W}), 0) wo, abs(weight - coalesce(lag(weight) over ({W}), 0)) d from w), q as (select dt, d, d * 1e6 m, case when asset = 'PROMO' then 0 else 0.1 * 0.2 * sqrt(d * 1e6 / 5e6) * d * 1e6 end h from t) select dt, sum(d) * 10 / 1e4 fixed, sum(m) * 10 / 1e4 proportional, sum(h) / 1e6 impact, sum(d) turnover, 0.5 * sum(d) one_way_turnover, sum(d) * 10 / 1e4 + sum(h) / 1e6 composite from q group by 1"

    def trades(s, d):
        w = prices(s, d).withColumn("w_new", F.col("px") / F.sum("px").over(Window.partitionBy("dt")))
        old = F.coalesce(F.lag("w_new").over(Window.partitionBy("asset").orderBy("dt")), F.lit(0.0))
        return w.select("dt", old.alias("w_old"), "w_new", F.lit(1e6).alias("value"), F.lit(0.2).alias("vol"), F.when(F.col("asset") == "PROMO", 0.0).otherwise(5e6).alias("adv"))

    register("transaction_costs", lambda s, d: mt.prices_of_costs(trades(s, d)), cost, "fixed proportional impact turnover one_way_turnover composite")

    # Tests.
    register("jarque_bera", lambda s, d: st.jarque_bera(returns(s, d)), f"with q as (select asset, count(r) / 6.0 * (({SKEW})**2 + ({KURT})**2 / 4) jb from rets group by 1) select *, exp(-jb / 2) p_value from q", "jb p_value")
    acf = f"with c as (select asset, dt, r - avg(r) over (partition by asset) x from rets), l as (select asset, x, {', '.join(f'x * lag(x, {k}) over ({W}) l{k}' for k in range(1, 11))} from c), s as (select asset, count(x) n, sum(x * x) v, {', '.join(f'sum(l{k}) l{k}' for k in range(1, 11))} from l group by 1), rho as ({' union all '.join(f'select asset, n, {k} lag, l{k} / v rho from s' for k in range(1, 11))})"
    register("autocorrelation", lambda s, d: st.autocorrelation(returns(s, d)), f"{acf} select * from rho", "rho")
    register("ljung_box", lambda s, d: st.ljung_box(returns(s, d)), f"{acf} select asset, min(n) * (min(n) + 2) * sum(rho * rho / (n - lag)) q from rho group by 1", "q")
    runs = f"with q as (select *, r > 0 s, lag(r > 0) over ({W}) l from rets where r <> 0), g as (select asset, count(*) filter (l is null or s <> l) runs, count(*) filter (s)::double p, count(*) filter (not s)::double q from q group by 1), m as (select *, p + q n, 2 * p * q / (p + q) + 1 mean, 2 * p * q * (2 * p * q - p - q) / ((p + q) ** 2 * (p + q - 1)) var from g) select asset, runs, (runs - mean) / sqrt(var) z from m"
    register("runs_test", lambda s, d: st.runs_test(returns(s, d)), runs, "z")
    pt = f"with {PAIRS}, d as (select *, ra - rb d from pairs), t as (select a, b, count(d) n, avg(d) / (stddev_samp(d) / sqrt(count(d))) t from d group by 1, 2 having count(d) >= 10), k as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 k from d where d <> 0), w as (select a, b, least(sum(case when d > 0 then k else 0 end), sum(case when d < 0 then k else 0 end)) w from k group by 1, 2) select t.a, t.b, n, t, w from t left join w using (a, b)"
    register("paired_tests", lambda s, d: st.paired_t(wd.pairs(returns(s, d))), pt, "t w")
    dm = f"with {PAIRS}, d as (select a, b, dt, ra * ra - rb * rb d from pairs), c as (select *, d - avg(d) over (partition by a, b) x from d), l as (select *, x * lag(x) over (partition by a, b order by dt) c1 from c) select a, b, avg(d) / sqrt((sum(x * x) / count(d) + 2 * sum(c1) / count(d)) / count(d)) dm, count(d) n from l group by 1, 2"
    register("diebold_mariano", lambda s, d: st.diebold_mariano(wd.pairs(returns(s, d)), 2), dm, "dm")
    register("significance_stars", lambda s, d: st.jarque_bera(returns(s, d)).select("asset", st.stars(F.col("p_value")).alias("stars")), f"with q as (select asset, exp(-count(r) / 12.0 * (({SKEW})**2 + ({KURT})**2 / 4)) p from rets group by 1) select asset, case when p < 0.01 then '***' when p < 0.05 then '**' when p < 0.1 then '*' else '' end stars from q")

    # Covariances and weights.
    register("covariance_matrix", lambda s, d: al.covariance_long(returns(s, d)), f"with {COV} select * from cov", "cov")
    rt = f"with {COV} select name, asset, weight, sqrt(v) vol, sw / sqrt(v) marginal, weight * sw / sqrt(v) component, weight * sw / v share from wts join sw using (name, asset) join pv using (name)"
    register("risk_contribution", lambda s, d: al.risk_table(named_weights(r := returns(s, d)), al.covariance_long(r)), rt, "weight vol marginal component share")
    mu = lambda r: r.groupBy("asset").agg((F.avg("r") * 252).alias("mu"))
    ps = f"with {COV}, mu as (select asset, avg(r) * 252 mu, stddev_samp(r) * sqrt(252) s from rets group by 1), q as (select wts.*, sw, v, weight * sw / v share, mu, s from wts join sw using (name, asset) join pv using (name) join mu using (asset)) select name, sum(weight * mu) ret, sqrt(min(v)) vol, sum(weight * mu) / sqrt(min(v)) sharpe, sum(weight * s) / sqrt(min(v)) diversification, exp(-sum(case when share > 0 then share * ln(share) else 0 end)) effective_bets, sum(weight * weight) herfindahl from q group by 1"
    register("portfolio_stats", lambda s, d: al.portfolio_stats(named_weights(r := returns(s, d)), mu(r), al.covariance_long(r)), ps, "ret vol sharpe diversification effective_bets herfindahl")
    at = "with w as (select asset, avg(1.0 / n) pw from (select asset, count(*) over (partition by dt) n from prices) group by 1), m as (select asset, pw, avg(r) * 252 ar, 1.0 / (select count(distinct asset) from rets) bw from w join rets using (asset) group by asset, pw), q as (select *, (pw - bw) * (ar - (select sum(bw * ar) from m)) allocation from m) select coalesce(asset, 'TOTAL') asset, sum(pw) pw, sum(bw) bw, sum(allocation) allocation, 0.0::double selection, 0.0::double interaction from q group by rollup(asset)"
    register("return_attribution", lambda s, d: al.attribution(equal_weights(prices(s, d)), returns(s, d)), at, "pw bw allocation selection interaction")
    register("equal_weights", lambda s, d: equal_weights(prices(s, d)), "select dt, asset, 1.0 / count(*) over (partition by dt) weight from prices", "weight")
    imp = f"with {COV} select asset, 2.5 * sw implied from sw where name = 'equal'"
    register("implied_returns", lambda s, d: al.covariance_long(r := returns(s, d)).join(named_weights(r).where("name = 'equal'").withColumnRenamed("asset", "j"), "j").groupBy(F.col("i").alias("asset")).agg((2.5 * F.sum(F.col("cov") * F.col("weight"))).alias("implied")), imp, "implied")
    register("expected_returns", lambda s, d: panel(s, d).groupBy("asset").agg((F.avg("p") * 252 / 21).alias("mu")), f"with {PANEL} select asset, avg(p) * 252 / 21 mu from panel group by 1", "mu")
    register("expected_returns_shrunk", lambda s, d: panel(s, d).groupBy("asset").agg(((0.5 * F.avg("p") + 0.5 * F.avg("y")) * 252 / 21).alias("mu")), f"with {PANEL} select asset, (0.5 * avg(p) + 0.5 * avg(y)) * 252 / 21 mu from panel group by 1", "mu")
