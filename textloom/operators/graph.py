"""Knowledge graph of triples, and reference graphs ranked by personalised PageRank."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _checkpoints(spark: SparkSession) -> None:
    """Sees to it that the session has a folder for checkpoints that all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(base)


def normal_triples(triples: DataFrame) -> DataFrame:
    """Triples (subject, predicate, object, object_kind, confidence, source, ts) with ids: facts of equal parts share fact_id."""
    s, p = T.entity_id("subject"), T.predicate("predicate")
    o = F.when(F.col("object_kind") == "entity", T.entity_id("object")).otherwise(F.trim("object"))
    x = triples.withColumn("s", s).withColumn("p", p).withColumn("o", o).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(0.7)), F.lit(0.0)), F.lit(1.0)))
    return x.where("s <> '' and p <> '' and o <> ''").withColumn("fact_id", T.fact_id("s", "p", "object_kind", "o"))


def merge_facts(triples: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a fact: fact_id, s, p, o, object_kind, confidence (highest), sources (sorted), first and last ts."""
    x = normal_triples(triples).select("fact_id", "s", "p", "o", "object_kind", "confidence", F.array("source").alias("sources"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    x = x if known is None else x.unionByName(known)
    return x.groupBy("fact_id").agg(*(F.min_by(c, F.struct("first_ts", c)).alias(c) for c in ("s", "p", "o", "object_kind")), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def merge_entities(triples: DataFrame) -> DataFrame:
    """entity, name (as first written), aliases (sorted), first and last ts."""
    x = normal_triples(triples)
    seen = x.select(F.col("s").alias("entity"), F.trim("subject").alias("name"), "ts").union(x.where("object_kind = 'entity'").select("o", F.trim("object"), "ts"))
    return seen.groupBy("entity").agg(F.min_by("name", F.struct("ts", "name")).alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity for names (query_id, name): equal ids, or aliases of equal id; the rest by containment of words.

    Containment goes through single words (an inverted index), not through all pairs.
    """
    asked = names.select("query_id", T.entity_id("name").alias("want")).where("want <> ''")
    known = entities.select("entity", F.explode(F.array_union(F.array("entity"), F.transform("aliases", T.entity_id))).alias("want")).distinct()
    exact = asked.join(known, "want").select("query_id", "want", "entity").distinct()
    rest = asked.join(exact, ["query_id", "want"], "left_anti")
    by_word = known.select("entity", F.col("want").alias("have"), F.explode(F.array_distinct(F.split("want", " "))).alias("word"))
    near = rest.withColumn("word", F.explode(F.array_distinct(F.split("want", " ")))).join(by_word, "word").where("contains(have, want) or contains(want, have)")
    return exact.select("query_id", "entity").union(near.select("query_id", "entity")).distinct()


def facts_touching(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, fact_id, overlap (query entities that the fact touches), of facts with a query entity on either side."""
    s = asked.join(facts.select("fact_id", F.col("s").alias("entity")), "entity")
    o = asked.join(facts.where("object_kind = 'entity'").select("fact_id", F.col("o").alias("entity")), "entity")
    return s.union(o).dropDuplicates(["query_id", "fact_id", "entity"]).groupBy("query_id", "fact_id").agg(F.count("*").alias("overlap"))


def query_facts(names: DataFrame, facts: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """The best k facts of each query by confidence x recency (0.5 to 1 over the query's facts) x (1 + overlap / 4)."""
    hit = facts_touching(resolve(names, entities), facts).join(facts, "fact_id")
    w = Window.partitionBy("query_id")
    at = F.col("last_ts").cast("timestamp").cast("double")
    low, high = F.min(at).over(w), F.max(at).over(w)
    recency = F.when(high > low, 0.5 + 0.5 * (at - low) / (high - low)).otherwise(F.lit(1.0))
    scored = hit.withColumn("score", F.col("confidence") * recency * (1 + F.col("overlap") / 4))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "fact_id"))).where(F.col("rank") <= k).select("query_id", "fact_id", "s", "p", "o", F.round("score", 6).alias("score"), "rank")


def closure(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """node: everything reachable from roots (node) over edges (a, b). Each step adds only what is new and is cut off
    from the plan before it by a checkpoint; steps are bounded by the longest path, ``most``."""
    _checkpoints(edges.sparkSession)
    seen = front = roots.select("node").distinct().checkpoint()
    for _ in range(most):
        front = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.union(front).checkpoint()
    raise ValueError("paths are longer than allowed")


def pagerank(nodes: DataFrame, edges: DataFrame, restart: DataFrame | None = None, damping: float = 0.85, rounds: int = 30, cut: int = 5) -> DataFrame:
    """node, rank of a graph (nodes: node; edges: src, dst, taken once) with restart weights (node, weight).

    Rank of nodes without outgoing edges goes to the restart. Every ``cut`` rounds the ranks are checkpointed, so the
    plan stays short and a lost executor costs a few rounds. All rounds are joins and aggregates on node ids.
    """
    _checkpoints(nodes.sparkSession)
    links = edges.select("src", "dst").where("src <> dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    links = links.join(out, "src").checkpoint()
    base = nodes.select("node").distinct()
    base = base.withColumn("weight", F.lit(1.0)) if restart is None else base.join(restart, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = base.agg(F.sum("weight")).first()[0] or 1.0
    base = base.select("node", (F.col("weight") / total).alias("base")).join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").checkpoint()
    ranks = base.select("node", F.col("base").alias("rank"))
    for i in range(rounds):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        # One number a round: the rank that leads nowhere.
        lost = ranks.join(base.where("leads is null").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = base.join(given, base["node"] == given["dst"], "left").crossJoin(F.broadcast(lost)).select("node", (F.lit(1 - damping) * F.col("base") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("base"))).alias("rank"))
        if (i + 1) % cut == 0:
            ranks = ranks.checkpoint()
    return ranks
