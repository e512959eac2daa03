"""Queries over price and macro series: returns, rolling and expanding features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.operators import returns as rt
from loomspan.operators import windows as wd
from loomspan.plans.views import macro, market, prices, returns

#: A window over an asset's rows by date, for the oracle.
W = "partition by asset order by dt"
S = "partition by series order by dt"


def _rows(n: int, w: str = W) -> str:
    return f"over ({w} rows between {n - 1} preceding and current row)"


def _least(x: str, n: int, value: str, least: int | None = None, w: str = W) -> str:
    return f"case when count({x}) {_rows(n, w)} >= {max(n // 2, 1) if least is None else least} then {value} end"


def bars(spark, sf_dir):
    """(dt, asset, open, high, low, close) of extended prices by part type."""
    from loomspan.plans.views import table

    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset"))
    return line.join(part, "l_partkey").groupBy("dt", "asset").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"))


BARS = "bars as (select cast(l_shipdate as date) dt, p_type asset, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as open, max(l_extendedprice / l_quantity) high, min(l_extendedprice / l_quantity) low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as close from lineitem join part on l_partkey = p_partkey group by 1, 2)"


def register_all() -> None:
    register("daily_prices", prices, "select * from prices", "px")
    register("simple_returns", lambda s, d: rt.simple_returns(prices(s, d)), f"select *, {', '.join(f'px / lag(px, {h}) over ({W}) - 1 ret_{h}d' for h in (1, 5, 21, 63))} from prices", "px ret_1d ret_5d ret_21d ret_63d")
    register("momentum", lambda s, d: rt.momentum(prices(s, d)), f"select *, {', '.join(f'px / lag(px, {h}) over ({W}) - 1 mom_{h}d' for h in (21, 63, 126, 252))} from prices", "px mom_21d mom_63d mom_126d mom_252d")
    register("log_returns", lambda s, d: rt.log_returns(prices(s, d)), f"select *, ln(px / lag(px) over ({W})) log_ret from prices", "px log_ret")
    register("total_returns", lambda s, d: rt.total_returns(prices(s, d)), f"select *, coalesce(px / lag(px) over ({W}) - 1, 0.0) ret from prices", "px ret")
    register("forward_returns", lambda s, d: rt.forward_returns(prices(s, d)), f"select *, lead(px, 21) over ({W}) / px - 1 fwd from prices", "px fwd")
    register("base_100", lambda s, d: rt.base_100(prices(s, d)), f"select *, px / first_value(px) over ({W}) * 100 base100 from prices", "px base100")
    register("relative_strength", lambda s, d: rt.relative_strength(prices(s, d)), f"with g as (select *, px / first_value(px) over ({W}) g from prices) select dt, asset, px, g / avg(g) over (partition by dt) rel_strength from g", "px rel_strength")
    register("cumulative_growth", lambda s, d: rt.cumulative_growth(returns(s, d)), f"select asset, dt, r, exp(sum(ln(1 + r)) over ({W})) growth from rets", "r growth")
    register("buy_and_hold_weights", lambda s, d: rt.buy_and_hold_weights(prices(s, d)), f"with g as (select *, px / first_value(px) over ({W}) g from prices) select dt, asset, px, g / sum(g) over (partition by dt) weight from g", "px weight")
    z = _least("value", 63, f"case when stddev_samp(value) {_rows(63, S)} > 0 then (value - avg(value) {_rows(63, S)}) / stddev_samp(value) {_rows(63, S)} end", 31, S)
    register("macro_changes", lambda s, d: rt.macro_changes(macro(s, d)), f"select *, value - lag(value) over ({S}) diff, value / lag(value) over ({S}) - 1 pct, {z} zscore from macro", "value diff pct zscore")
    register("macro_surprise", lambda s, d: rt.macro_surprise(macro(s, d)), f"with q as (select *, {z} z from macro) select dt, series, value, case when z is null then null else greatest(-5.0, least(5.0, z)) end surprise from q", "value surprise")
    register("macro_lags", lambda s, d: rt.lagged(macro(s, d)), f"select *, {', '.join(f'lag(value, {k}) over ({S}) lag_{k}' for k in (1, 5, 21))} from macro", "value lag_1 lag_5 lag_21")
    register("winsorized_returns", lambda s, d: rt.winsorize(returns(s, d)), "with e as (select asset, quantile_cont(r, 0.01) lo, quantile_cont(r, 0.99) hi from rets group by 1) select asset, dt, greatest(lo, least(hi, r)) r from rets join e using (asset)", "r")
    register("regime_flags", lambda s, d: rt.regime_flags(macro(s, d), 160000.0, 120000.0), f"select *, case when value > 160000 then 1.0::double else 0.0 end is_high, case when value < 120000 then 1.0::double else 0.0 end is_low, case when value > lag(value, 21) over ({S}) then 1.0::double else 0.0 end is_rising from macro", "value is_high is_low is_rising")
    register("rolling_volatility", lambda s, d: wd.rolling_volatility(returns(s, d)), f"select asset, dt, r, {', '.join(_least('r', n, f'stddev_samp(r) {_rows(n)} * sqrt(252)') + f' vol_{n}d' for n in (21, 63, 126, 252))} from rets", "r vol_21d vol_63d vol_126d vol_252d")
    register("realized_variance", lambda s, d: wd.realized_variance(returns(s, d)), f"select asset, dt, r, {_least('r', 21, f'sum(r * r) {_rows(21)} * 252 / 21')} realized_var from rets", "r realized_var")
    gk = f"with {BARS}, g as (select *, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 k from bars) select dt, asset, open, high, low, close, {_least('k', 21, f'case when avg(k) {_rows(21)} >= 0 then sqrt(avg(k) {_rows(21)} * 252) end')} gk_vol from g"
    register("garman_klass", lambda s, d: wd.garman_klass(bars(s, d)), gk, "open high low close gk_vol")
    m, sd = (_least("px", 20, f"{f}(px) {_rows(20)}", 20) for f in ("avg", "stddev_samp"))
    register("bollinger_bands", lambda s, d: wd.bollinger(prices(s, d)), f"with q as (select *, {m} mid, {sd} s from prices) select dt, asset, px, mid, mid + 2 * s upper, mid - 2 * s lower, case when s <> 0 then (px - mid + 2 * s) / (4 * s) end pct_b, 4 * s / mid width from q", "px mid upper lower pct_b width")
    a, b = _least("px", 50, f"avg(px) {_rows(50)}"), _least("px", 200, f"avg(px) {_rows(200)}")
    register("ma_crossover", lambda s, d: wd.crossover(prices(s, d)), f"with q as (select *, {a} a, {b} b from prices) select dt, asset, px, a / b ma_ratio, case when a > b then 1.0::double else 0.0 end golden, (a - b) / px ma_spread from q", "px ma_ratio golden ma_spread")
    rsi = f"with q as (select *, px - lag(px) over ({W}) d from prices), u as (select *, case when d > 0 then d when d is not null then 0 end u, case when d < 0 then -d when d is not null then 0 end v from q) select dt, asset, px, case when count(v) {_rows(14)} >= 14 and avg(v) {_rows(14)} > 0 then 100 - 100 / (1 + avg(u) {_rows(14)} / avg(v) {_rows(14)}) end rsi from u"
    register("rsi_simple", lambda s, d: wd.rsi_simple(prices(s, d)), rsi, "px rsi")
    fold = lambda x, a: f"list_reduce(list({x}) over ({W}), lambda p, c: (1 - {a}) * p + {a} * c)"
    wil = f"with q as (select *, px - lag(px) over ({W}) d, row_number() over ({W}) i from prices), u as (select *, greatest(d, 0) u, greatest(-d, 0) v from q where d is not null), e as (select dt, asset, px, i, {fold('u', '(1.0 / 14)')} a, {fold('v', '(1.0 / 14)')} b from u) select p.dt, p.asset, p.px, case when e.i > 14 and b > 0 then 100 - 100 / (1 + a / b) end rsi from prices p left join e using (dt, asset)"
    register("rsi_wilder", lambda s, d: wd.rsi_wilder(prices(s, d)), wil, "px rsi")
    al = {n: f"(2.0 / {n + 1})" for n in (12, 26, 9)}
    mac = f"with e as (select *, row_number() over ({W}) i, {fold('px', al[12])} f, {fold('px', al[26])} s from prices), l as (select *, f - s line from e where i >= 26), g as (select *, {fold('line', al[9])} sig from l) select e.dt, e.asset, e.px, line macd, case when g.i >= 34 then sig end signal, case when g.i >= 34 then line - sig end hist from e left join g using (dt, asset)"
    register("macd", lambda s, d: wd.macd(prices(s, d)), mac.replace("e.px, line", "e.px, g.line").replace("then line - sig", "then g.line - g.sig").replace("then sig end", "then g.sig end"), "px macd signal hist")
    k = "pow(0.5, 1.0 / 63)"
    ew = f"with l as (select asset, dt, r, list(r) over ({W}) x, row_number() over ({W}) n from rets), w as (select *, list_transform(range(n), lambda i: pow({k}, n - 1 - i)) w from l where n >= 63), v as (select asset, dt, r, list_sum(w) s1, list_sum(list_transform(w, lambda a: a * a)) s2, list_dot_product(w, x) m1, list_dot_product(w, list_transform(x, lambda a: a * a)) m2 from w) select rets.asset, rets.dt, rets.r, sqrt(252 * (m2 / s1 - (m1 / s1) ** 2) * s1 * s1 / (s1 * s1 - s2)) ewma_vol from rets left join v using (asset, dt)"
    register("ewma_volatility", lambda s, d: wd.ewma_volatility(returns(s, d)), ew, "r ewma_vol")
    register("rolling_beta", lambda s, d: wd.rolling_beta(r := returns(s, d), market(r)), f"with j as (select * from rets join mkt using (dt)) select dt, asset, r, b, {_least('r', 63, f'covar_samp(r, b) {_rows(63)} / nullif(var_samp(b) {_rows(63)}, 0)')} beta from j", "r b beta")
    pair = "pairs as (select x.dt, x.asset a, y.asset b, x.r ra, y.r rb from rets x join rets y on x.dt = y.dt and x.asset < y.asset)"
    register("rolling_mean_correlation", lambda s, d: wd.rolling_mean_correlation(returns(s, d)), f"with {pair}, c as (select dt, {_least('ra', 63, f'corr(ra, rb) {_rows(63, 'partition by a, b order by dt')}', 63, 'partition by a, b order by dt')} c from pairs) select dt, avg(c) mean_corr from c group by dt having avg(c) is not null", "mean_corr")
    register("rolling_correlation_with_base", lambda s, d: wd.rolling_correlation_with(returns(s, d), "STANDARD"), f"with j as (select x.asset, x.dt, x.r, y.r b from rets x join rets y on x.dt = y.dt and y.asset = 'STANDARD' and x.asset <> 'STANDARD'), c as (select *, {_least('r', 63, f'corr(r, b) {_rows(63)}', 63)} corr from j) select * from c where corr is not null", "r b corr")
    register("dispersion", lambda s, d: wd.dispersion(returns(s, d)), "with q as (select dt, stddev_samp(r) dispersion from rets group by 1) select *, case when count(dispersion) over w >= 10 then avg(dispersion) over w end mean_dispersion from q window w as (order by dt rows between 20 preceding and current row)", "dispersion mean_dispersion")
    register("percentile_rank", lambda s, d: wd.percentile_rank(macro(s, d), "value", "series"), "select *, (rank() over (partition by series order by value) + (count(*) over (partition by series, value) - 1) / 2.0) / count(*) over (partition by series) pct_rank from macro", "value pct_rank")
    ex = lambda q: f"case when count(value) over ({S}) >= 63 then quantile_cont(value, {q}) over ({S} rows between unbounded preceding and current row) end"
    register("expanding_quantiles", lambda s, d: wd.expanding_quantiles(macro(s, d)), f"select *, {ex(0.25)} q_lo, {ex(0.75)} q_hi from macro", "value q_lo q_hi")
    register("rolling_median", lambda s, d: wd.rolling_median(macro(s, d)), f"select *, {_least('value', 252, f'quantile_cont(value, 0.5) {_rows(252, S)}', 63, S)} median from macro", "value median")
    grown = f"g as (select *, exp(sum(ln(1 + r)) over ({W})) g from rets)"
    register("drawdowns", lambda s, d: wd.drawdowns(returns(s, d)), f"with {grown} select asset, dt, r, g growth, g / max(g) over ({W}) - 1 drawdown from g", "r growth drawdown")
    eps = f"with g as (select *, round(sum(ln(1 + r)) over ({W}), 12) g, row_number() over ({W}) i, lead(dt) over ({W}) nx from rets), t as (select *, max(g) over ({W}) top from g), f as (select *, g < top down, exp(g - top) - 1 dd, sum(case when g < top then 0 else 1 end) over ({W}) n from t), e as (select asset, n, min(dt) as start, arg_min(dt, (dd, dt)) trough, arg_max((nx, i), i) last, min(dd) depth, count(*) duration, max(i) - arg_min(i, (dd, dt)) left_ from f where down group by asset, n) select asset, start, trough, last[1] recovered, depth, duration, case when last[1] is not null then left_ + 1 end recovery from e"
    register("drawdown_episodes", lambda s, d: wd.drawdown_episodes(returns(s, d)), eps, "depth")
    register("loss_spans", lambda s, d: wd.spans(returns(s, d).withColumn("down", F.col("r") < 0), "down", "asset"), f"with q as (select *, row_number() over ({W}) - 1 i from rets), f as (select *, i - row_number() over ({W}) run from q where r < 0) select asset, min(i) as first, max(i) as last, min(dt) from_dt, max(dt) to_dt from f group by asset, run")
    roll = f"with {grown}, q as (select *, count(r) {_rows(252)} n, avg(r) {_rows(252)} * 252 roll_ret, stddev_samp(r) {_rows(252)} * sqrt(252) roll_vol, g / max(g) {_rows(252)} - 1 roll_dd from g) select asset, dt, r, roll_ret, roll_vol, roll_ret / roll_vol roll_sharpe, roll_dd from q where n >= 252 and roll_vol > 1e-12"
    register("rolling_metrics", lambda s, d: wd.rolling_metrics(returns(s, d)), roll, "r roll_ret roll_vol roll_sharpe roll_dd")
    register("worst_window_drawdown", lambda s, d: wd.worst_drawdown_in_window(returns(s, d)), f"with l as (select asset, dt, r, list(r) {_rows(63)} x from rets), k as (select * from l where len(x) = 63), e as (select asset, dt, r, unnest(x) y, generate_subscripts(x, 1) p from k), g as (select asset, dt, r, p, exp(sum(ln(1 + y)) over (partition by asset, dt order by p)) g from e), t as (select *, g / max(g) over (partition by asset, dt order by p) - 1 dd from g) select asset, dt, r, min(dd) worst_dd from t group by asset, dt, r", "r worst_dd")
    register("signal_decay", lambda s, d: wd.signal_decay(macro(s, d).withColumn("value", F.when(F.dayofmonth("dt") % 3 == 0, F.col("value")))), f"with q as (select dt, series, case when day(dt) % 3 = 0 then value end as value, row_number() over ({S}) i from macro), a as (select *, last_value(value ignore nulls) over ({S}) v, max(case when value is not null then i end) over ({S}) j from q) select dt, series, value, v * exp(-ln(2) / 5 * (i - j)) decayed from a", "value decayed")
    register("prediction_turnover", lambda s, d: wd.prediction_turnover(returns(s, d).withColumnRenamed("r", "p")), f"with q as (select dt, abs(r - lag(r, 5) over ({W})) d from rets) select dt, avg(d) turnover, count(d) n from q group by 1 having count(d) >= 3", "turnover")
    register("recent_mean", lambda s, d: wd.recent_mean(returns(s, d), "r"), f"select asset, dt, r, avg(r) {_rows(10)} recent from rets", "r recent")
    register("momentum_signal", lambda s, d: wd.window_signal(prices(s, d)), f"select dt, asset, px, coalesce(lag(px, 1) over ({W}) / lag(px, 21) over ({W}) - 1, 0) signal from prices", "px signal")
    register("contrarian_signal", lambda s, d: wd.window_signal(prices(s, d), sign=-1), f"select dt, asset, px, coalesce(-(lag(px, 1) over ({W}) / lag(px, 21) over ({W}) - 1), 0) signal from prices", "px signal")
    iv = f"with q as (select *, case when count(r) over ({W} rows between 62 preceding and 1 preceding) >= 62 then stddev_samp(r) over ({W} rows between 62 preceding and 1 preceding) end s from rets), v as (select *, 1 / s iv from q where s > 0) select dt, asset, r, iv / sum(iv) over (partition by dt) - 1 / count(*) over (partition by dt) signal from v"
    register("inverse_vol_signal", lambda s, d: wd.inverse_vol_signal(returns(s, d)), iv, "r signal")
