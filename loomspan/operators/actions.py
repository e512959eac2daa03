"""Action logs: mapping, enrichment, timelines, agent statistics, paging and micro-batches by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.panels import numbered

#: Names of logged actions.
ACTION_NAMES = {
    "create_post": "CREATE_POST",
    "like_post": "LIKE_POST",
    "dislike_post": "DISLIKE_POST",
    "repost": "REPOST",
    "quote_post": "QUOTE_POST",
    "follow": "FOLLOW",
    "mute": "MUTE",
    "create_comment": "CREATE_COMMENT",
    "like_comment": "LIKE_COMMENT",
    "dislike_comment": "DISLIKE_COMMENT",
    "search_posts": "SEARCH_POSTS",
    "search_user": "SEARCH_USER",
    "trend": "TREND",
    "do_nothing": "DO_NOTHING",
    "interview": "INTERVIEW",
}


def named(action: Column, names: dict[str, str] = ACTION_NAMES) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(lookup, action), F.upper(action))


def arguments(actions: DataFrame, keys: list[str], column: str = "args") -> DataFrame:
    """Known keys of the JSON arguments as text columns; null where absent or not JSON."""
    return actions.withColumns({k: F.get_json_object(column, f"$.{k}") for k in keys})


def sentence(agent: Column, action: Column, value: Column) -> Column:
    """One line for each kind of action; a plain one for other kinds."""
    kinds = {"click": "clicked on an item", "view": "viewed a page", "purchase": "made a purchase", "signup": "signed up", "login": "logged in", "logout": "logged out"}
    out = F.concat(F.lit("performed "), action)
    for k, s in kinds.items():
        out = F.when(action == k, s).otherwise(out)
    return F.concat(F.lit("Agent "), agent.cast("string"), F.lit(" "), out, F.lit(" ("), F.format_string("%.2f", value), F.lit(")"))


def timeline(actions: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """A row a round: counts by platform, agents, kinds with counts, first and last time."""
    got = actions.where((F.col("round_num") >= start) & (F.lit(end is None) | (F.col("round_num") <= (end or 0))))
    return _profile(got, "round_num")


def agent_stats(actions: DataFrame) -> DataFrame:
    return _profile(actions, "agent_id")


def _profile(actions: DataFrame, key: str) -> DataFrame:
    other = "agent_id" if key == "round_num" else "round_num"
    kinds = actions.groupBy(key, "action_type").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("action_type", "n"))).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat(x["action_type"], F.lit("="), x["n"].cast("string"))), ",")
    base = actions.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("platform") == "twitter").alias("twitter"), F.count_if(F.col("platform") == "reddit").alias("reddit"), F.count_distinct(other).alias(f"{other}s"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return base.join(kinds.select(key, text.alias("histogram")), key)


def page(actions: DataFrame, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    return actions.orderBy(*order).offset(offset).limit(limit)


def counted_page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50, where: Column | None = None) -> DataFrame:
    """A page of the rows that a condition leaves, each with total, how many there are over all pages. A page behind the last is empty.

    The page is a bounded sort (the first offset + limit rows of each task), the total a count of one row that is broadcast."""
    left = rows if where is None else rows.where(where)
    return page(left, order, offset, limit).crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("total"))))


def merged_history(actions: DataFrame, limit: int = 100) -> DataFrame:
    """The newest rows of each platform, then the newest of those."""
    w = Window.partitionBy("platform").orderBy(F.desc("ts"), F.desc("event_id"))
    return actions.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k").orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def recent(actions: DataFrame, n: int = 50, key: str = "platform") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return actions.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def since(actions: DataFrame, high_water: int, skip=("refresh", "sign_up")) -> DataFrame:
    """Rows after an id, in its order, without kinds that only keep a session alive."""
    return actions.where((F.col("event_id") > high_water) & ~F.col("action_type").isin(*skip))


def micro_batches(actions: DataFrame, size: int = 5, key: str = "platform", ignore: str = "DO_NOTHING") -> DataFrame:
    """A row for each batch of `size` actions of a key in order, the last one maybe short: number, count, first and last id."""
    got = numbered(actions.where(F.col("action_type") != ignore), "event_id", [key]).withColumn("batch", F.floor(F.col("_no") / size).cast("long"))
    return got.groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), (F.count(F.lit(1)) < size).alias("partial"))


def progress(actions: DataFrame, last_round: int) -> DataFrame:
    """Rounds seen and whether the last one was, by platform; completed when all platforms are."""
    each = actions.groupBy("platform").agg(F.max("round_num").alias("round"), F.count(F.lit(1)).alias("actions")).withColumn("done", F.col("round") >= last_round)
    return each.withColumn("all_done", F.every("done").over(Window.partitionBy()))


def owners(actions: DataFrame, customers: DataFrame) -> DataFrame:
    """Each action with its user's name: the customer's, else a made-up one."""
    names = customers.select(F.col("c_custkey").alias("agent_id"), F.nullif(F.col("c_name"), F.lit("")).alias("_n"))
    return actions.join(names, "agent_id", "left").withColumn("author", F.coalesce("_n", F.concat(F.lit("user_"), F.col("agent_id").cast("string")))).drop("_n")


def enriched(actions: DataFrame, dims: list[tuple[list[str], Column, DataFrame, str, str]]) -> DataFrame:
    """Adds one column for each dimension (kinds, key, frame, frame's key, frame's column): its value for actions of these kinds.

    Each is one left join guarded by the kind, so actions of other kinds find no partner; dimensions pass through unduplicated."""
    out = actions
    for i, (kinds, key, frame, on, column) in enumerate(dims):
        side = frame.select(F.col(on).alias(f"_k{i}"), F.col(column).alias(f"{column}_"))
        out = out.withColumn(f"_g{i}", F.when(F.col("action_type").isin(kinds), key)).join(side, F.col(f"_g{i}") == F.col(f"_k{i}"), "left").drop(f"_g{i}", f"_k{i}")
    return out


def tasks(registry: DataFrame, kind: str | None = None) -> DataFrame:
    """registry: task_id, kind, status, created. Newest first."""
    got = registry.where(F.col("kind") == kind) if kind else registry
    return got.orderBy(F.desc("created"), F.desc("task_id"))


def unexpired(registry: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Without finished tasks (completed or failed) older than `hours`."""
    old = F.col("status").isin("completed", "failed") & (F.col("created") < now - F.make_interval(hours=F.lit(hours)))
    return registry.where(~old)
