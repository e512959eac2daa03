"""Graph entities: incidence, statistics, keyword retrieval and temporal splits over nodes (id, name, labels) and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.panels import numbered


def with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_name and dst_name, empty where the node is unknown."""
    n = nodes.select("id", "name")
    out = edges.join(n.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left")
    out = out.join(n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("src_name", "dst_name")})


def incidence(edges: DataFrame) -> DataFrame:
    """(id, direction, other, name, fact): each edge at both ends; a self-loop once, outgoing."""
    out = edges.select(F.col("src").alias("id"), F.lit("outgoing").alias("direction"), F.col("dst").alias("other"), "name", "fact")
    back = edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("id"), F.lit("incoming").alias("direction"), F.col("src").alias("other"), "name", "fact")
    return out.unionByName(back)


def own_labels() -> Column:
    return F.filter("labels", lambda x: ~x.isin("Entity", "Node"))


def entities(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes with a label of their own (of `types` if given): entity_type, edges in and out, distinct neighbours."""
    own = nodes.withColumn("_own", own_labels()).where(F.size("_own") > 0)
    wanted = F.filter("_own", lambda x: x.isin(types)) if types else F.col("_own")
    own = own.withColumn("_w", wanted).where(F.size("_w") > 0).select("id", "name", F.element_at("_w", 1).alias("entity_type"))
    ends = incidence(edges).groupBy("id").agg(F.count_if(F.col("direction") == "outgoing").alias("n_out"), F.count_if(F.col("direction") == "incoming").alias("n_in"), F.count_distinct("other").alias("neighbours"))
    out = own.join(ends, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_out", "n_in", "neighbours")})


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(own_labels()).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("_l"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return n.crossJoin(e).select("node_count", "edge_count", F.array_join("_l", ",").alias("labels"))


def keywords(query: str) -> list[str]:
    return [w for w in query.lower().replace(",", " ").replace("，", " ").split() if len(w) > 1]


def score(text: Column, query: str, additive: bool = False) -> Column:
    """100 for the whole query; else (or, additive, besides) 10 for each keyword contained."""
    t = F.lower(text)
    each = sum((F.when(t.contains(k), 10).otherwise(0) for k in keywords(query)), F.lit(0))
    whole = t.contains(query.lower())
    return F.when(whole, 100).otherwise(0) + each if additive else F.when(whole, 100).otherwise(each)


def search(rows: DataFrame, columns: list[str], query: str, order: list[str], limit: int = 10, additive: bool = False) -> DataFrame:
    """The best rows by keyword score, ties by `order`. A top-k: Spark keeps `limit` rows a task."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return rows.withColumn("score", score(text, query, additive)).where(F.col("score") > 0).orderBy(F.desc("score"), *order).limit(limit)


def temporal_split(edges: DataFrame, on: str) -> DataFrame:
    """Each fact as active, or historical with its validity before it, as of a date."""
    old = F.col("invalid_at").isNotNull() & (F.col("invalid_at") <= F.lit(on).cast("date"))
    span = F.concat(F.lit("["), F.coalesce(F.col("valid_at").cast("string"), F.lit("unknown")), F.lit(" - "), F.col("invalid_at").cast("string"), F.lit("] "), F.col("fact"))
    return edges.withColumns({"state": F.when(old, "historical").otherwise("active"), "shown": F.when(old, span).otherwise(F.col("fact"))})


def first_facts(edges: DataFrame, queries: list[str], per_query: int = 20) -> DataFrame:
    """Distinct facts over several queries in the order first seen: by query, then by score and fact."""
    out = None
    for i, q in enumerate(queries):
        top = search(edges.select("fact", "name").distinct(), ["fact", "name"], q, ["fact", "name"], per_query)
        top = top.withColumns({"_q": F.lit(i), "_p": F.row_number().over(Window.orderBy(F.desc("score"), "fact", "name"))})
        out = top if out is None else out.unionByName(top)
    first = out.groupBy("fact").agg(F.min(F.struct("_q", "_p")).alias("at"))
    return first.select("fact", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("position"))


def pages(rows: DataFrame, key: str, size: int = 100, most: int | None = None) -> DataFrame:
    """Rows numbered into cursor pages by key; at most `most` rows where a cap is wanted."""
    if most:
        first = rows.orderBy(key).limit(most)
        return first.withColumn("page", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("long"))
    return numbered(rows, key).withColumn("page", F.floor(F.col("_no") / size).cast("long")).drop("_no")


def entity_summary(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, name, facts, edges): the first node of a name, without regard to case, with the distinct facts around it."""
    node = nodes.where(F.lower("name") == name.lower()).orderBy("id").limit(1).select("id", "name")
    around = incidence(edges).join(F.broadcast(node.select("id")), "id").groupBy("id").agg(F.array_sort(F.collect_set("fact")).alias("_f"), F.count(F.lit(1)).alias("edges"))
    out = node.join(around, "id", "left")
    return out.select("id", "name", F.coalesce(F.array_join("_f", "; "), F.lit("")).alias("facts"), F.coalesce("edges", F.lit(0)).alias("edges"))


def context(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """(part, item, n): facts that match a query, label and relation counts, and the first own labels of nodes, for a report."""
    facts = search(edges, ["fact", "name"], query, ["fact"], limit).select(F.lit("fact").alias("part"), F.col("fact").alias("item"), F.col("score").cast("long").alias("n"))
    labels = label_counts(nodes).select(F.lit("label").alias("part"), F.col("label").alias("item"), "n")
    relations = relation_counts(edges).select(F.lit("relation").alias("part"), F.col("name").alias("item"), "n")
    return facts.unionByName(labels).unionByName(relations)


def valid_types(types: Column, needed: tuple[str, ...] = ("Person", "Organization"), most: int = 10) -> Column:
    """At most `most` distinct type names; the needed ones are there, in place of the last where there is no room."""
    own = F.array_except(F.array_distinct(F.filter(types, lambda t: t.isNotNull() & (F.length(t) > 0))), F.array(*map(F.lit, needed)))
    return F.concat(F.slice(own, 1, most - len(needed)), F.array(*map(F.lit, needed)))
