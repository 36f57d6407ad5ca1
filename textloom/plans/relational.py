"""Relational and event-time queries: joins, aggregates, windows, sets, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deltas, graph


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    x = _t(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


def region_revenue(spark: SparkSession, sf: str) -> DataFrame:
    j = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.countDistinct("c_custkey").alias("customers"))


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return _t(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def customers_without_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def tumbling_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return _t(spark, sf, "events").groupBy(w["start"].alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events with gaps of 30 minutes at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 1e6
    e = _t(spark, sf, "events").withColumn("new", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0))
    s = e.withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"))


def newest_events(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.keep_newest(_t(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


def user_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a purchase, those with an error, and how many are in either set, in both, and in the first alone."""
    e = _t(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == kind).select("user_id").distinct() for kind in ("purchase", "error"))
    both = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.exceptAll(b))]
    out = None
    for name, x in both:
        one = x.agg(F.count("*").alias("users")).select(F.lit(name).alias("op"), "users")
        out = one if out is None else out.union(one)
    return out


def image_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", T.image_tokens(F.col("p_size") * 20, F.col("p_size") * 30).alias("tokens"))


def touching_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of customers and of suppliers as facts (subject, object); those that touch nation 3, once each."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("s"), F.col("c_mktsegment").alias("o"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("s"), F.lit("supplier").alias("o"))
    return c.where("s = 3").union(s.where("s = 3")).dropDuplicates(["s", "o"])


def trade_rank(spark: SparkSession, sf: str) -> DataFrame:
    """PageRank of nations over edges from a customer's nation to the nations of suppliers of its orders' parts."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    s = _t(spark, sf, "lineitem").join(_t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("dst"))
    edges = o.join(s, "o_orderkey").select("src", "dst")
    return graph.pagerank(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("node")), edges, rounds=10).select("node", F.round("rank", 6).alias("rank"))


QUERIES = {f.__name__: f for f in (pricing_summary, region_revenue, top_orders, customers_without_orders, tumbling_stats, sessions, newest_events, user_sets, image_tokens, touching_facts, trade_rank)}



def _rank_sql(rounds: int = 10) -> str:
    """The rounds of PageRank one after the other; rank that leads nowhere goes to all alike."""
    steps = "".join(
        f""",
r{i + 1} as (select node, 0.15 * base + 0.85 * (coalesce(got, 0) + lost * base) as rank from base left join (select dst, sum(rank / n) as got from l join o using (src) join r{i} on node = src group by dst) on dst = node, (select coalesce(sum(rank), 0) as lost from r{i} where node not in (select src from o)))"""
        for i in range(rounds)
    )
    return f"""with l as (select distinct c_nationkey as src, s_nationkey as dst from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey),
o as (select src, count(*) as n from l group by src),
base as (select n_nationkey as node, 1.0::double / (select count(*) from nation) as base from nation),
r0 as (select node, base as rank from base){steps}
select node, round(rank, 6) as rank from r{rounds}"""


SQL = {
    "trade_rank": _rank_sql(),
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "region_revenue": "select r_name, round(sum(o_totalprice), 2) as revenue, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "top_orders": "select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3",
    "customers_without_orders": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "tumbling_stats": "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "sessions": "with g as (select user_id, event_id, ts, case when lag(ts) over w is null or epoch(ts) - epoch(lag(ts) over w) > 1800 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g) select user_id, session::bigint as session, count(*) as events, min(ts) as began from s group by user_id, session",
    "newest_events": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events) where i <= 5",
    "user_sets": "with a as (select distinct user_id from events where event_type = 'purchase'), b as (select distinct user_id from events where event_type = 'error') select 'union' as op, count(*) as users from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b)",
    "image_tokens": "select p_partkey, greatest((p_size * 20 * p_size * 30) // 750, 85)::bigint as tokens from part",
    "touching_facts": "select distinct s, o from (select c_nationkey as s, c_mktsegment as o from customer where c_nationkey = 3 union all select s_nationkey, 'supplier' from supplier where s_nationkey = 3)",
}
