"""Queries over actions, graph entities, documents and result files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.catalog import register
from loomspan.functions import text as tx
from loomspan.operators import actions as ac
from loomspan.operators import graph as gr
from loomspan.operators import metrics as mt
from loomspan.plans.views import actions, edges, macro, nodes, prices, table
from loomspan.sources import files as fs
from loomspan.streaming import events as ev

PROFILE = "select {k}, count(*) total, count(*) filter (platform = 'twitter') twitter, count(*) filter (platform = 'reddit') reddit, count(distinct {o}) {o}s, min(ts) first_ts, max(ts) last_ts from actions group by 1"
HIST = "select {k}, string_agg(action_type || '=' || n, ',' order by action_type) histogram from (select {k}, action_type, count(*) n from actions group by 1, 2) group by 1"


def vintages(s, d):
    """Revisions of order values: each order's value is known from its date, and again, changed, 30 days later."""
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("dt"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")
    first = o.groupBy("series", "dt").agg(F.min("value").alias("value")).withColumns({"known_from": F.date_add("dt", 1), "known_until": F.date_add("dt", 30)})
    last = o.groupBy("series", "dt").agg(F.max("value").alias("value")).withColumns({"known_from": F.date_add("dt", 30), "known_until": F.lit(None).cast("date")})
    return first.unionByName(last)


VINT = "vint as (select series, dt, value, known_from, known_until from (select o_orderpriority series, cast(o_orderdate as date) dt, min(cast(o_totalprice as double)) as value, cast(o_orderdate as date) + 1 known_from, cast(o_orderdate as date) + 30 known_until from orders group by all union all select o_orderpriority, cast(o_orderdate as date), max(cast(o_totalprice as double)), cast(o_orderdate as date) + 30, null from orders group by all))"


NORMAL = r"""
with t as (select doc_id, regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') t from documents),
j as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), chr(10)) t from t)
select doc_id, sha256(regexp_replace(t, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) digest from j
"""


#: Chunks of 500 characters with 50 shared ones: a chunk a step, of all documents at once.
_ENDS = ["。", "！", "？", ".\n", "!\n", "?\n", "\n\n", ". ", "! ", "? "]
_QUOTED = [", ".join(f"'{c}'" if c != "\n" else "chr(10)" for c in e) for e in _ENDS]
_FOUND = [f"strpos(reverse(w), reverse(concat({q})))" for q in _QUOTED]
_LAST = [f"case when {f} > 0 then length(w) - {f} - {len(e)} + 1 else -1 end" for f, e in zip(_FOUND, _ENDS, strict=True)]
_BREAKS = " ".join(f"when {x} > 150 then {x} + {len(e)}" for x, e in zip(_LAST, _ENDS, strict=True))
CHUNKS = f"""with recursive d as (select doc_id, text t, length(text) n from documents where regexp_matches(text, '\\S')),
c as (
  select doc_id, 0::bigint k, 0::bigint pos, case when n <= 500 then n else case {_BREAKS.replace('(w)', '(left(t, 500))')} else 500 end end::bigint till from d
  union all
  select doc_id, k + 1, pos, pos + case when pos + 500 >= n then n - pos else case {_BREAKS} else 500 end end
  from (select c.doc_id, k, n, greatest(till - 50, c.pos + 1) pos, substr(t, greatest(till - 50, c.pos + 1) + 1, 500) w from c join d using (doc_id) where till < n)),
p as (select doc_id, k, case when n <= 500 then t else regexp_replace(substr(t, pos + 1, till - pos), '^\\s+|\\s+$', '', 'g') end part from c join d using (doc_id))
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int chunk_no, sha256(part) digest from p where part <> ''"""


def register_all() -> None:
    names = "case action_type when 'follow' then 'FOLLOW' when 'mute' then 'MUTE' else upper(action_type) end"
    register("action_names", lambda s, d: actions(s, d).select("event_id", ac.named(F.col("action_type")).alias("action")), f"select event_id, {names} action from actions")
    register("action_arguments", lambda s, d: ac.arguments(actions(s, d), ["k", "missing"]).select("event_id", "k", "missing"), "select event_id, json_extract_string(args, '$.k') k, cast(null as varchar) missing from actions")
    kinds = {"click": "clicked on an item", "view": "viewed a page", "purchase": "made a purchase", "signup": "signed up", "login": "logged in", "logout": "logged out"}
    case = " ".join(f"when '{k}' then '{v}'" for k, v in kinds.items())
    register("action_sentences", lambda s, d: actions(s, d).select("event_id", ac.sentence(F.col("agent_id"), F.col("action_type"), F.col("value")).alias("sentence")), f"select event_id, 'Agent ' || agent_id || ' ' || case action_type {case} else 'performed ' || action_type end || ' (' || printf('%.2f', value) || ')' sentence from actions")
    for name, k, o in (("round_timeline", "round_num", "agent_id"), ("agent_activity", "agent_id", "round_num")):
        fn = ac.timeline if k == "round_num" else ac.agent_stats
        register(name, lambda s, d, fn=fn: fn(actions(s, d)), f"select * from ({PROFILE.format(k=k, o=o)}) join ({HIST.format(k=k)}) using ({k})")
    register("action_page", lambda s, d: ac.page(actions(s, d), [F.desc("ts"), F.desc("event_id")], 50, 100).select("event_id"), "select event_id from actions order by ts desc, event_id desc limit 100 offset 50")
    # Purchases as posts, newest first; views of an agent's round as the comments of one post, oldest first.
    posts = lambda s, d: ac.counted_page(actions(s, d), [F.desc("ts"), F.desc("event_id")], 20, 30, F.col("action_type") == "purchase").select("event_id", "agent_id", "total")
    sql = """with p as (select *, count(*) over () total from actions where action_type = 'purchase')
select event_id, agent_id, total from p order by ts desc, event_id desc limit 30 offset 20"""
    register("post_page", posts, sql)
    of = lambda: (F.col("action_type") == "view") & (F.col("agent_id") == 7)
    comments = lambda s, d: ac.counted_page(actions(s, d), ["ts", "event_id"], 2, 10, of()).select("event_id", "round_num", "total")
    sql = """with c as (select *, count(*) over () total from actions where action_type = 'view' and agent_id = 7)
select event_id, round_num, total from c order by ts, event_id limit 10 offset 2"""
    register("comment_page", comments, sql)
    register("merged_history", lambda s, d: ac.merged_history(actions(s, d)).select("event_id", "platform"), "select event_id, platform from actions order by ts desc, event_id desc limit 100")
    register("recent_actions", lambda s, d: ac.recent(actions(s, d)).select("platform", "event_id", "k"), "select platform, event_id, k from (select *, row_number() over (partition by platform order by ts desc, event_id desc) k from actions) where k <= 50")
    register("actions_since", lambda s, d: ac.since(actions(s, d), 500, ("signup",)).select("event_id", "agent_id", "action_type"), "select event_id, agent_id, action_type from actions where event_id > 500 and action_type <> 'signup'")
    register("micro_batches", lambda s, d: ac.micro_batches(actions(s, d)), "select platform, b batch, count(*) n, min(event_id) first_id, max(event_id) last_id, count(*) < 5 partial from (select *, (row_number() over (partition by platform order by event_id) - 1) // 5 b from actions) group by 1, 2")
    register("platform_progress", lambda s, d: ac.progress(actions(s, d), 29), "select platform, max(round_num) as round, count(*) actions, max(round_num) >= 29 done, (select bool_and(m >= 29) from (select max(round_num) m from actions group by platform)) all_done from actions group by 1")
    register("action_authors", lambda s, d: ac.owners(actions(s, d), table(s, d, "customer")).select("event_id", "author"), "select event_id, coalesce(nullif(c_name, ''), 'user_' || agent_id) author from actions left join customer on c_custkey = agent_id")
    register("tumbling_windows", lambda s, d: ev.tumbling(table(s, d, "events")), "select time_bucket(interval 1 hour, ts) start, time_bucket(interval 1 hour, ts) + interval 1 hour as end, event_type, count(*) n, sum(value) total from events group by all".replace("start,", "as start,"), "total")
    register("sliding_windows", lambda s, d: ev.tumbling(table(s, d, "events"), "2 hours", slide="1 hour"), "select b - interval 1 hour * k as start, b - interval 1 hour * k + interval 2 hours as end, event_type, count(*) n, sum(value) total from (select *, time_bucket(interval 1 hour, ts) b, unnest([0, 1]) k from events) group by all", "total")
    ses = "with q as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end f from events), g as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) s from q) select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) n from g group by user_id, s"
    register("session_windows", lambda s, d: ev.sessions(table(s, d, "events")), ses)

    # Graph.
    register("edges_with_names", lambda s, d: gr.with_names(edges(s, d), nodes(s, d)), "select e.*, coalesce(a.name, '') src_name, coalesce(b.name, '') dst_name from edges e left join nodes a on a.id = src left join nodes b on b.id = dst")
    inc = "inc as (select src id, 'outgoing' direction, dst other, name, fact from edges union all select dst, 'incoming', src, name, fact from edges where src <> dst)"
    register("node_edges", lambda s, d: gr.incidence(edges(s, d)), f"with {inc} select * from inc")
    ent = f"with {inc}, e as (select id, count(*) filter (direction = 'outgoing') n_out, count(*) filter (direction = 'incoming') n_in, count(distinct other) neighbours from inc group by 1) select n.id, n.name, labels[2] entity_type, coalesce(n_out, 0) n_out, coalesce(n_in, 0) n_in, coalesce(neighbours, 0) neighbours from nodes n left join e using (id)"
    register("entities", lambda s, d: gr.entities(nodes(s, d), edges(s, d)), ent)
    register("entities_by_type", lambda s, d: gr.entities(nodes(s, d), edges(s, d), ["Nation", "Region"]), ent + " where labels[2] in ('Nation', 'Region')")
    register("label_counts", lambda s, d: gr.label_counts(nodes(s, d)), "select labels[2] as label, count(*) n from nodes group by 1")
    register("relation_counts", lambda s, d: gr.relation_counts(edges(s, d)), "select name, count(*) n from edges group by 1")
    register("graph_info", lambda s, d: gr.info(nodes(s, d), edges(s, d)), "select (select count(*) from nodes) node_count, (select count(*) from edges) edge_count, (select string_agg(distinct l, ',' order by l) from (select unnest(labels) l from nodes)) labels")
    score = "case when contains(lower(t), 'order urgent') then 100 else case when contains(lower(t), 'order') then 10 else 0 end + case when contains(lower(t), 'urgent') then 10 else 0 end end"
    register("edge_search", lambda s, d: gr.search(edges(s, d), ["fact", "name"], "order urgent", ["fact"]).select("fact", "score"), f"select fact, {score} score from (select *, fact || ' ' || name t from edges) where {score} > 0 order by score desc, fact limit 10")
    add = "case when contains(lower(t), 'urgent') then 110 else 0 end"
    register("panorama_search", lambda s, d: gr.search(edges(s, d), ["fact", "name"], "urgent", ["fact"], 50, True).select("fact", "score"), f"select fact, {add} score from (select *, fact || ' ' || name t from edges) where {add} > 0 order by score desc, fact limit 50")
    register("temporal_split", lambda s, d: gr.temporal_split(edges(s, d), "1997-01-01").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("shown").alias("first_shown")), "with q as (select coalesce(invalid_at <= date '1997-01-01', false) old, * from edges) select case when old then 'historical' else 'active' end state, count(*) n, min(case when old then '[' || coalesce(valid_at::varchar, 'unknown') || ' - ' || invalid_at || '] ' || fact else fact end) first_shown from q group by 1")
    hit = "case when contains(lower(fact || ' ' || name), '{0}') then 100 else 0 end"
    top = " union all ".join(f"select {i} q, * from (select fact, row_number() over (order by {hit.format(q)} desc, fact, name) p from (select distinct fact, name from edges) where {hit.format(q)} > 0) where p <= 20" for i, q in enumerate(["urgent", "low", "order"]))
    ff = f"with t as ({top}), f as (select fact, min(q * 1000 + p) first_at from t group by 1) select fact, row_number() over (order by first_at) - 1 as position from f"
    register("first_facts", lambda s, d: gr.first_facts(edges(s, d), ["urgent", "low", "order"]), ff)
    register("node_pages", lambda s, d: gr.pages(nodes(s, d).select("id"), "id", 100, 2000), "select id, (row_number() over (order by id) - 1) // 100 page from (select id from nodes order by id limit 2000)")
    register("all_node_pages", lambda s, d: gr.pages(nodes(s, d).select("id"), "id", 100), "select id, (row_number() over (order by id) - 1) // 100 page from nodes")

    # Text.
    register("normalised_text", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(tx.normalised(F.col("text")), 256).alias("digest")), NORMAL)
    register("text_statistics", lambda s, d: tx.statistics(table(s, d, "documents")).select("doc_id", "chars", "lines", "words"), r"select doc_id, length(text) chars, length(text) - length(replace(text, chr(10), '')) + 1 as lines, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) words from documents")
    register("text_chunks", lambda s, d: tx.chunked(table(s, d, "documents")).select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("digest")), CHUNKS)
    register("joined_documents", lambda s, d: tx.documents_joined(nodes(s, d).select(F.col("labels")[1].alias("kind"), "id", "name"), "kind", "id", "name").select("kind", F.sha2("joined", 256).alias("digest"), F.length("joined").cast("long").alias("chars")), "with q as (select labels[2] kind, '=== doc ' || row_number() over (partition by labels[2] order by id) || ': ' || id || ' ===' || chr(10) || name t, row_number() over (partition by labels[2] order by id) i from nodes) select kind, sha256(string_agg(t, chr(10) || chr(10) order by i)) digest, length(string_agg(t, chr(10) || chr(10) order by i)) chars from q group by 1")
    def names(s, d):
        """Names as experiments have them, from the parts' types and sizes."""
        kind = F.element_at(F.array(*map(F.lit, ["lgbm", "xgb", "ridge", "plain", "svr"])), (F.col("p_size") % 5 + 1).cast("int"))
        tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("_maxw"), "p_size", F.lit("_tc"), F.col("p_size") % 7)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("_lambda"), "p_size")).otherwise("")
        return table(s, d, "part").select(F.concat("p_type", F.lit("_"), kind, tail).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))

    configs = lambda s, d: (lambda c: names(s, d).select("name", "n", *[v.alias(k) for k, v in c.items()]))(tx.experiment_config(F.col("name")))
    number = lambda pattern, other: f"coalesce(try_cast(nullif(regexp_extract(name, '{pattern}', 1), '') as double), {other})"
    sql = rf"""with e as (select p_type || '_' || ['lgbm', 'xgb', 'ridge', 'plain', 'svr'][p_size % 5 + 1]
    || case p_size % 3 when 0 then '_maxw' || p_size || '_tc' || p_size % 7 when 1 then '_lambda' || p_size else '' end as name from part)
select name, count(*) n, case when name like '%lgbm%' then 'lgbm' when name like '%xgb%' then 'xgb' when name like '%ridge%' then 'ridge'
  when name like '%svr%' then 'svr' else 'lgbm' end model, {number(r'maxw(\d+)', 35)} / 100 max_weight, {number(r'tc(\d+)', 10)} cost_bps,
  {number(r'(?:lambda|ra)(\d+)', 5)} aversion from e group by name"""
    register("experiment_names", configs, sql, "max_weight cost_bps aversion")

    # Sources and reports.
    register("as_known_on", lambda s, d: fs.as_known_on(vintages(s, d), "1996-06-01").select("series", "dt", "value"), f"with {VINT} select series, dt, value from vint where known_from <= date '1996-06-01' and (known_until is null or date '1996-06-01' < known_until)", "value")
    register("latest_revision", lambda s, d: fs.latest_revision(vintages(s, d), ["series", "dt"]).select("series", "dt", "value", "known_from"), f"with {VINT} select series, dt, arg_max(value, known_from) as value, max(known_from) known_from from vint group by 1, 2", "value")
    register("series_coverage", lambda s, d: mt.coverage(macro(s, d), "1995-01-01", "2001-08-01"), "select series, min(dt) first_dt, max(dt) last_dt, 0.0::double null_pct, min(dt) <= date '1995-01-31' and max(dt) >= date '2001-07-02' passed from macro group by 1", "null_pct")
    gaps = "with s as (select asset, min(dt) a, max(dt) b from prices group by 1), g as (select asset, unnest(generate_series(a, b, interval 1 day))::date dt from s), c as (select g.asset, g.dt, px from g left join prices using (asset, dt) where dayofweek(g.dt) between 1 and 5), n as (select *, row_number() over (partition by asset order by dt) i from c), k as (select asset, i - row_number() over (partition by asset order by dt) r from n where px is null), l as (select asset, max(n) gap from (select asset, r, count(*) n from k group by 1, 2) group by 1) select s.asset, coalesce(gap, 0) gap from s left join l using (asset)"

    def gap(s, d):
        from loomspan.operators.panels import reindex

        return mt.longest_gap(reindex(prices(s, d)), "px", "asset")

    register("longest_gap", gap, gaps)
    register("best_by_group", lambda s, d: macro(s, d).groupBy("series").agg(F.max_by("dt", F.struct("value", "dt")).alias("best_dt"), F.max("value").alias("best")), "select series, arg_max(dt, (value, dt)) best_dt, max(value) best from macro group by 1", "best")
    register("top_rows", lambda s, d: macro(s, d).orderBy(F.desc("value"), "dt", "series").limit(25), "select * from macro order by value desc, dt, series limit 25", "value")
    register("untried_priorities", lambda s, d: table(s, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct().join(table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("p")), "p", "left_anti"), "select distinct o_orderpriority p from orders where o_orderpriority not in (select o_orderpriority from orders where o_orderstatus = 'P')")
    register("totals_rollup", lambda s, d: table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "select o_orderstatus, o_orderpriority, count(*) n from orders group by rollup(o_orderstatus, o_orderpriority)")
    register("percent_format", lambda s, d: macro(s, d).groupBy("series").agg(F.count(F.lit(1)).alias("n")).withColumn("share", tx.percent(F.col("n") / F.sum("n").over(Window.partitionBy()))), "select series, count(*) n, printf('%.2f%%', count(*) * 100.0 / (select count(*) from macro)) as share from macro group by 1")
