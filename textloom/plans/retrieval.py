"""Retrieval queries: rows whose id divides by 50 (benchmark items, vectors, messages of conversations) ask all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import ENTITY_STOP
from ..operators import retrieval as R

def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(_t(spark, sf, "documents"), asked(spark, sf)).withColumn("score", F.round("score", 6))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_stats(_t(spark, sf, "documents"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_top_k(v, q).withColumn("score", F.round("score", 5))


def keyword_overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyword_overlap(_t(spark, sf, "documents"), asked(spark, sf)).withColumn("score", F.round("score", 6))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = _t(spark, sf, "documents"), asked(spark, sf)
    return R.rrf([R.bm25(docs, queries, 20), R.keyword_overlap(docs, queries, 20)]).withColumn("score", F.round("score", 6))


def retrieve_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", T.count_tokens("text").alias("tokens"))
    hits = R.bm25(_t(spark, sf, "documents"), asked(spark, sf), 20).join(docs, "doc_id")
    cut = R.budget_cut(hits.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], "tokens", 1000, 5)
    return cut.select("query_id", "doc_id", "rank", F.col("tokens").cast("long").alias("tokens"), F.col("used").cast("long").alias("used"))


def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "conversations").withColumn("tokens", T.count_tokens("text"))
    out = R.budget_cut(rows, ["conv_id"], [F.col("turn").desc()], "tokens", 300, 5)
    return out.select("conv_id", "turn", "rank", F.col("used").cast("long").alias("used"))


def entity_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    df = R.entity_edges(docs, ENTITY_STOP).groupBy("entity").agg(F.count("*").alias("df"))
    return df.crossJoin(n).select("entity", "df", F.round(F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.0)), 6).alias("idf"))


def hash_embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    return R.vector_top_k(R.hash_embedding(docs), R.hash_embedding(asked(spark, sf), "query_id"), 5, "doc_id")


def entity_graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.entity_scores(_t(spark, sf, "documents"), asked(spark, sf), ENTITY_STOP, 10).withColumn("score", F.round("score", 6))


def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    said = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "text")
    return R.retrieve(said.select("doc_id", "text"), said.where("conv_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), budget=300)


QUERIES = {
    "retrieve_hybrid": retrieve_hybrid,
    "bm25_topk": bm25_topk,
    "term_stats": term_stats,
    "cosine_topk": cosine_topk,
    "keyword_overlap_topk": keyword_overlap_topk,
    "hybrid_rrf": hybrid_rrf,
    "retrieve_budget": retrieve_budget,
    "budget_cut": budget_cut,
    "entity_idf": entity_idf,
    "hash_embedding_topk": hash_embedding_topk,
    "entity_graph_topk": entity_graph_topk,
}

_ASKED = "asked as (select item_id as query_id, text from benchmark where item_id % 50 = 0)"
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]'))"

#: BM25 of all matching documents: bm(query_id, doc_id, score).
_BM25 = rf"""{_ASKED},
q as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as term from asked),
w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from documents),
st as (select count(*) as n, avg(len(w)) as mean from w),
tf as (select doc_id, term, count(*) as tf, any_value(len) as len from (select doc_id, len(w) as len, unnest(w) as term from w) where term in (select term from q) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
bm as (select query_id, doc_id, sum((ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)))::decimal(20,10))::double as score from tf join df using (term) join q using (term), st group by query_id, doc_id having sum((ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)))::decimal(20,10)) > 0),
bmr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm)"""
_OVER = r"""ov as (select query_id, doc_id, len(list_filter(qw, lambda x: contains(lower(d.text), x))) / len(qw)::double as score from documents d, (select query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as qw from asked)),
ovr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ov where score > 0)"""
_STOP = ", ".join(f"'{w.lower()}'" for w in ENTITY_STOP)
#: The first 40 entities of each text: {0} is the key, {1} the table.
_ENTITIES = rf"""select distinct {{0}}, entity from (select {{0}}, unnest(list_slice(list_filter(list_transform(l, lambda x, i: case when list_position(l, x) = i then x end), lambda x: x is not null), 1, 40)) as entity from (
select {{0}}, list_transform(list_filter(regexp_extract_all(text, '[\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: strlen(w) >= 3 and regexp_matches(w, '^\p{{{{Lu}}}}') and lower(w) not in ({_STOP}) and not (regexp_full_match(w, '\p{{{{Lu}}}}+') and strlen(w) > 4)), lambda w: lower(w)) as l from {{1}}))"""

SQL = {
    "bm25_topk": f"with {_BM25} select query_id, doc_id, round(score, 6) as score, rank from bmr where rank <= 5",
    "term_stats": r"select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents) group by doc_id, term) group by term",
    "cosine_topk": "select query_id, doc_id, round(score, 5) as score, rank from (select q.vec_id as query_id, v.vec_id as doc_id, list_dot_product(q.embedding::double[], v.embedding::double[]) as score, row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], v.embedding::double[]) desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 50 = 0) where rank <= 5",
    "keyword_overlap_topk": f"with {_ASKED}, {_OVER} select query_id, doc_id, round(score, 6) as score, rank from ovr where rank <= 5",
    "hybrid_rrf": f"with {_BM25}, {_OVER}, u as (select query_id, doc_id, rank from bmr where rank <= 20 union all select query_id, doc_id, rank from ovr where rank <= 20), f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from u group by query_id, doc_id) select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 10",
    "retrieve_budget": f"with {_BM25}, tk as (select doc_id, {_TOKENS} as tokens from documents), c as (select query_id, doc_id, rank, tokens, sum(tokens) over (partition by query_id order by rank) as used from bmr join tk using (doc_id) where rank <= 20) select query_id, doc_id, rank, tokens::bigint as tokens, used::bigint as used from c where rank <= 5 and (rank = 1 or used <= 1000)",
    "budget_cut": f"with c as (select conv_id, turn, {_TOKENS} as tokens from conversations), r as (select *, row_number() over (partition by conv_id order by turn desc) as rank, sum(tokens) over (partition by conv_id order by turn desc rows unbounded preceding) as used from c) select conv_id, turn, rank, used::bigint as used from r where rank <= 5 and (rank = 1 or used <= 300)",
    "entity_idf": f"with e as ({_ENTITIES.format('doc_id', 'documents')}), n as (select count(*) as n from documents) select entity, count(*) as df, round(greatest(ln(any_value(n) / count(*)::double), 0), 6) as idf from e, n group by entity",
    "entity_graph_topk": f"""with {_ASKED}, e as ({_ENTITIES.format('doc_id', 'documents')}), a as ({_ENTITIES.format('query_id', 'asked')}), n as (select count(*) as n from documents),
idf as (select entity, greatest(ln(any_value(n) / count(*)::double), 0)::decimal(20,10) as idf from e, n group by entity),
th as (select query_id, doc_id, entity, idf from e join a using (entity) join idf using (entity)),
di as (select query_id, doc_id, sum(idf)::double as score, count(*) as hits from th group by all having sum(idf) > 0),
op as (select query_id from (select query_id, count(*) as n from a group by query_id) join (select query_id, max(hits) as most from di group by query_id) using (query_id) where most < (n + 1) // 2),
sp as (select query_id, doc_id as bridge from (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as i from di join op using (query_id)) where i <= 5),
ov as (select query_id, bridge, entity from sp join e on e.doc_id = bridge where not exists (select 1 from a where a.query_id = sp.query_id and a.entity = e.entity)),
nr as (select distinct ov.query_id, bridge, ov.entity, th.doc_id, th.entity as other, th.idf from ov join e on e.entity = ov.entity and e.doc_id <> bridge join th on th.query_id = ov.query_id and th.doc_id = e.doc_id
  where not exists (select 1 from th t where t.query_id = ov.query_id and t.doc_id = ov.bridge and t.entity = th.entity)),
al as (select query_id, doc_id, sum(score) as score from (select query_id, doc_id, score from di union all select query_id, doc_id, sum(idf)::double / 2 from nr group by all) group by all)
select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from al) where rank <= 10""",
}
