"""Pieces of SQL that several queries' oracles share: sweeps of matrices kept as (keys, i, j, v), tails of distributions by
integration, draws of a bootstrap."""

from __future__ import annotations

from loomspan.plans.series_queries import W


def gram_sql(name: str, source: str, keys: str) -> str:
    """source: (keys, row, i, v). Sums of products of all pairs of columns i, j."""
    on = f"{keys}, row"
    return f"{name} as (select {keys}, a.i, b.i j, sum(a.v * b.v) v from {source} a join {source} b using ({on}) group by all)"


def sweep_sql(name: str, source: str, keys: str, first: int, last: int) -> str:
    """`name` is `source` (keys, i, j, v) after exchanging the pivots from first up to last, which is left out. A pivot whose column the
    others explain becomes 0."""
    return f"""
{name}_steps as materialized (
  select {first} step, {keys}, i, j, v, max(case when i = j then v end) over (partition by {keys}, j) d0 from {source}
  union all
  select step + 1, {keys}, i, j,
    case when d > 1e-10 * own then case when i = step and j = step then 1 / d when i = step then v / d when j = step then -v / d else v - down * across / d end
      when i = step or j = step then 0 else v end, d0
  from (
    select *, max(case when i = step and j = step then v end) over (partition by {keys}) d,
      max(case when i = step and j = step then d0 end) over (partition by {keys}) own,
      max(case when j = step then v end) over (partition by {keys}, i) down, max(case when i = step then v end) over (partition by {keys}, j) across
    from {name}_steps where step < {last})
),
{name} as (select {keys}, i, j, v from {name}_steps where step = {last})""".strip()


def _simpson(density: str, upper: str, steps: int) -> str:
    """The integral from 0 to `upper` of a density of x."""
    at = density.replace("@x", f"({upper}) * node_ / {steps}")
    weight = f"case when node_ = 0 or node_ = {steps} then 1 when node_ % 2 = 1 then 4 else 2 end"
    return f"({upper}) / {steps} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda node_: ({weight}) * {at}))"


def normal_tail_sql(z: str) -> str:
    inner = _simpson("exp(-0.5 * ((@x) ** 2))", f"least(abs({z}), 9)", 600)
    return f"greatest(0, 1 - 2 * {inner} / sqrt(2 * pi()))"


def t_tail_sql(t: str, df: str) -> str:
    inner = _simpson(f"(1 + (@x) ** 2 / ({df})) ** (-(({df}) + 1) / 2.0)", f"least(abs({t}), 14)", 1000)
    return f"greatest(0, 1 - 2 * {inner} * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()))"


def boot_sql(reps: int, block: int, circular: bool = False, length: int | None = None) -> str:
    """yy (asset, rep, t, r): the rows of each replicate in order, drawn one by one."""
    below = "n" if circular else "n - b + 1"
    mixed = lambda x: f"xor({x}, {x} >> 16)"
    return f"""
ss as (select asset, r, row_number() over ({W}) - 1 pos, count(*) over (partition by asset) n from rets),
sz as (select asset, min(n) n, least({block}, min(n)) b, {length or 'min(n)'} len from ss group by 1),
rp as (select sz.*, unnest(range({reps})) rep from sz),
sd as (select *, ('0x' || substr(md5('42:' || asset || ':' || rep), 1, 8))::bigint seed from rp),
bk as (select sd.*, unnest(range(0, cast(ceil(len / b) as bigint))) blk from sd),
x0 as (select *, (seed + (blk + 1) * 2654435761) % 4294967296 x from bk),
x1 as (select * replace ({mixed('x')} * 73244475 % 4294967296 as x) from x0),
x2 as (select * replace ({mixed('x')} * 73244475 % 4294967296 as x) from x1),
dw as (select *, {mixed('x')} % ({below}) start from x2),
od as (select asset, rep, blk, b, n, start, unnest(range(0, least(b, len - blk * b))) o from dw),
yy as (select od.asset, rep, blk * b + o t, r from od join ss on ss.asset = od.asset and ss.pos = (start + o) % od.n)""".strip()


def interval_sql(value: str, draws: str) -> str:
    """Mean and the middle 95 percent of a statistic of the replicates in yy."""
    q = f"select asset, rep, {value} as value from yy group by 1, 2"
    return f"with {draws}, vv as ({q}) select asset, avg(value) mean, quantile_cont(value, 0.025) lo, quantile_cont(value, 0.975) hi, count(value) reps from vv group by 1"


def list_gram_sql(name: str, source: str, keys: str) -> str:
    """As gram_sql, by inner products of the columns as lists: each pair of columns once, and its mirror image."""
    return f"""
{name}_cols as materialized (select {keys}, i, list(v::double order by row) v from {source} group by all),
{name}_half as materialized (select {keys}, a.i, b.i j, list_inner_product(a.v, b.v) v from {name}_cols a join {name}_cols b using ({keys}) where a.i <= b.i),
{name} as materialized (select * from {name}_half union all select {keys}, j, i, v from {name}_half where i < j)""".strip()


#: The column of the label in matrices whose numbers of columns differ by key.
LABEL = 999


def adf_sql(p: str, source: str, keys: str) -> str:
    """{p}_adf (keys, n, lags, adf): the unit-root statistic of series (keys, j, x), j from 0, with lags by information criterion."""
    wanted = lambda rows, most: f"{rows}_w as materialized (select {keys}, upto, j, k, j - k at_ from {rows} join {p}_lag using ({keys}) where k <= {most})"
    columns = lambda rows: f"""
  select {keys}, upto, j as row, unnest([0, 1, {LABEL}]) i, unnest([1.0, x, d]) v from {rows}
  union all
  select {keys}, w.upto, w.j, 1 + k, d from {rows}_w w join (select {keys}, j at_, d from {p}_d) using ({keys}, at_)""".strip()  # noqa: E731
    return f"""
{p}_n as materialized (select {keys}, count(*) n, least(floor(12 * (count(*) / 100.0) ** 0.25), count(*) // 2 - 2)::bigint most from {source} group by all),
{p}_d as materialized (select * from (select {keys}, j, x, lead(x) over (partition by {keys} order by j) - x d from {source}) where d is not null),
{p}_lag as materialized (select {keys}, unnest(range(1, most + 1)) k from {p}_n),
{p}_r1 as materialized (select {p}_d.*, most + 2 upto, most from {p}_d join {p}_n using ({keys}) where j >= most),
{wanted(f'{p}_r1', 'most')},
{p}_x1 as materialized ({columns(f'{p}_r1')}),
{list_gram_sql(f'{p}_g1', f'{p}_x1', f'{keys}, upto')},
{sweep_sql(f'{p}_s1', f'{p}_g1', f'{keys}, upto', 0, 'upto')},
{p}_aic as (select {keys}, s.step - 2 lags, (n - 1 - most) * ln(greatest(s.v, 1e-300) / (n - 1 - most)) + 2 * s.step aic
  from {p}_s1_steps s join {p}_n using ({keys}) where s.i = {LABEL} and s.j = {LABEL} and s.step >= 2),
{p}_best as materialized (select {keys}, arg_min(lags, (aic, lags)) lags from {p}_aic group by all),
{p}_r2 as materialized (select {p}_d.*, lags + 2 upto, lags from {p}_d join {p}_best using ({keys}) where j >= lags),
{wanted(f'{p}_r2', 'lags')},
{p}_x2 as materialized ({columns(f'{p}_r2')}),
{list_gram_sql(f'{p}_g2', f'{p}_x2', f'{keys}, upto')},
{sweep_sql(f'{p}_s2', f'{p}_g2', f'{keys}, upto', 0, 'upto')},
{p}_end as (select {keys}, max(v) filter (i = 1 and j = {LABEL}) beta, max(v) filter (i = 1 and j = 1) inverse, max(v) filter (i = {LABEL} and j = {LABEL}) sse from {p}_s2 group by all),
{p}_adf as (select {keys}, n, lags, beta / sqrt(sse / (n - 1 - lags - (lags + 2)) * inverse) adf from {p}_end join {p}_n using ({keys}) join {p}_best using ({keys}))""".strip()


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """The chance of a ratio above f, as an incomplete beta function, its variable the square of a sine."""
    a, b = f"({d2}) / 2.0", f"({d1}) / 2.0"
    inner = _simpson(f"2 * sin(@x) ** (2 * {a} - 1) * cos(@x) ** (2 * {b} - 1)", f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))", 4000)
    return f"{inner} * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
