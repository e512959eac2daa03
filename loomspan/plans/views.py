"""Panels over the star schema: prices, macro, actions, graph nodes and edges. Each has a DataFrame form and the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.returns import simple_returns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, asset, px). Sums are decimal, so the value doesn't depend on the order of rows."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("dt"), ((1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("decimal(18,8)").alias("v"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset"))
    return line.join(part, "l_partkey").groupBy("dt", "asset").agg((100 * F.sum("v").cast("double") / F.count(F.lit(1))).alias("px"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, series, value)."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("dt"), F.col("o_orderpriority").alias("series"), F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    return orders.groupBy("dt", "series").agg((F.sum("v").cast("double") / F.count(F.lit(1))).alias("value"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, dt, r): one-row simple returns without the first row."""
    return simple_returns(prices(spark, sf_dir), (1,)).select("asset", "dt", F.col("ret_1d").alias("r")).where(F.col("r").isNotNull())


def market(returns: DataFrame) -> DataFrame:
    """(dt, b): the equal-weight return of each date."""
    return returns.groupBy("dt").agg(F.avg("r").alias("b"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events.select("event_id", F.col("user_id").alias("agent_id"), "ts", F.when(F.col("user_id") % 2 == 0, "twitter").otherwise("reddit").alias("platform"), day.alias("round_num"), F.col("event_type").alias("action_type"), "value", F.col("props").alias("args"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, labels)."""
    kinds = [("customer", "c_custkey", "c_name", "Customer"), ("supplier", "s_suppkey", "s_name", "Supplier"), ("nation", "n_nationkey", "n_name", "Nation"), ("region", "r_regionkey", "r_name", "Region")]
    out = None
    for name, key, label, kind in kinds:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind[0]}"), F.col(key).cast("string")).alias("id"), F.col(label).alias("name"), F.array(F.lit("Entity"), F.lit(kind)).alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, name, fact, valid_at, invalid_at)."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("date")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders = t("orders").select(key("C", "o_custkey").alias("src"), key("O", "o_orderkey").alias("dst"), F.lit("PLACED").alias("name"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("fact"), F.to_date("o_orderdate").alias("valid_at"), F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 30)).alias("invalid_at"))
    rows = [("customer", "C", "c_custkey", "N", "c_nationkey", "LIVES_IN"), ("supplier", "S", "s_suppkey", "N", "s_nationkey", "BASED_IN"), ("nation", "N", "n_nationkey", "R", "n_regionkey", "PART_OF")]
    out = orders
    for name, a, ka, b, kb, rel in rows:
        out = out.unionByName(t(name).select(key(a, ka).alias("src"), key(b, kb).alias("dst"), F.lit(rel).alias("name"), F.lit(rel.lower()).alias("fact"), none.alias("valid_at"), none.alias("invalid_at")))
    return out


#: The same views for the oracle, to stand after WITH.
SQL = """
prices as (select cast(l_shipdate as date) dt, p_type asset, 100 * cast(sum(cast((1 - l_discount) * (1 + l_tax) as decimal(18,8))) as double) / count(*) px from lineitem join part on l_partkey = p_partkey group by 1, 2),
macro as (select cast(o_orderdate as date) dt, o_orderpriority series, cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) as value from orders group by 1, 2),
rets as (select * from (select asset, dt, px / lag(px) over (partition by asset order by dt) - 1 r from prices) where r is not null),
mkt as (select dt, avg(r) b from rets group by dt),
actions as (select event_id, user_id agent_id, ts, case when user_id % 2 = 0 then 'twitter' else 'reddit' end platform, date_diff('day', date '2024-01-01', cast(ts as date)) round_num, event_type action_type, value, props args from events),
nodes as (select 'C' || c_custkey id, c_name as name, ['Entity', 'Customer'] labels from customer union all select 'S' || s_suppkey, s_name, ['Entity', 'Supplier'] from supplier union all select 'N' || n_nationkey, n_name, ['Entity', 'Nation'] from nation union all select 'R' || r_regionkey, r_name, ['Entity', 'Region'] from region),
edges as (select 'C' || o_custkey src, 'O' || o_orderkey dst, 'PLACED' as name, 'order ' || o_orderkey || ' ' || o_orderpriority fact, cast(o_orderdate as date) valid_at, case when o_orderstatus = 'F' then cast(o_orderdate as date) + 30 end invalid_at from orders union all select 'C' || c_custkey, 'N' || c_nationkey, 'LIVES_IN', 'lives_in', null, null from customer union all select 'S' || s_suppkey, 'N' || s_nationkey, 'BASED_IN', 'based_in', null, null from supplier union all select 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF', 'part_of', null, null from nation)
"""
