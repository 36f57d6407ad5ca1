"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, neardup, packing, phrases, pii, quality, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The remainder of crc32(doc_id) that training never sees.
_HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def _spans(col: str) -> Column:
    return F.concat_ws(",", F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_back(*warc.archive(_table(spark, sf_dir, "pages")))
    return found.drop("urlkey")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("row.doc_id", *count, F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.split(documents, _table(spark, sf_dir, "labels"), "toxic"))
    found = toxicity.score(documents, model)
    return found.select("doc_id", F.expr(_HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels"), "quality"))
    return found.select("doc_id", F.expr(_HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.neighbours(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=5, percent=85)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    found = langid.identify(documents, langid.training_text(documents, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base_labels", "template_labels"))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("containment")).alias("score"),
    )


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_pii": op2_pii,
        "op3_decontaminate": op3_decontaminate,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_fingerprints": op6_fingerprints,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_pack": op8_pack,
        "op9_language": op9_language,
        "op10_license_scan": op10_license_scan,
    }


_OP1_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, url from pages),
g as (select payload_digest, max(page_id) as answer from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, p.payload_digest,
  case when answer is not null and page_id is distinct from answer then 'revisit' else 'response' end as record_type,
  case when answer is not null and page_id is distinct from answer then answer end as refers_to
from p left join g on p.payload_digest = g.payload_digest and payload_bytes >= 1000
"""

#: Windows of ten words are compared as joined strings; shorter items are one window of their own length.
_OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
spots as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, spots.n from spots join win on spots.s = win.s and spots.n = win.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


#: Links by counting common shingles of all pairs that have any; components by reachability.
_OP7_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r as (select doc_id as d, doc_id as c from documents union select r.d, e.b from r join e on e.a = r.c),
m as (select d as doc_id, min(c) as component_id from r group by d)
select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, documents.doc_id = component_id as kept
from documents left join n using (doc_id) left join m using (doc_id)
"""


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _op10_sql() -> str:
    """Phrases by their places; templates by common words with each block of twice the longest template, half overlapping."""
    quoted = lambda words: "[" + ", ".join(f"'{x}'" for x in words) + "]"
    step = max(len(_words(t)) for _, t in licenses.TEMPLATES)
    phrases = sorted((label, _words(p)) for p, label in licenses.PHRASES.items())
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = {quoted(p)}) as p{k}" for k, (_, p) in enumerate(phrases))
    every = " || ".join(f"p{k}" for k in range(len(phrases)))
    said = ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (label, _) in enumerate(phrases))
    sets = [(label, sorted(set(_words(t)))) for label, t in licenses.TEMPLATES]
    known = ", ".join(f"('{label}', {quoted(t)}, {math.ceil(licenses.THRESHOLD * len(t) - 1e-9)})" for label, t in sets)
    return rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select *, {places} from d),
base as (select *, {every} as spots, list_filter([{said}], lambda x: x is not null) as said from p),
t(label, words, need) as (values {known}),
block as (select r, list_distinct(w[b + 1:b + {2 * step}]) as b from (select r, w, unnest(range(0, len(w), {step})) as b from d)),
m as (select r, label, len(list_intersect(b, words)) as c, len(words) as n from block, t where len(list_intersect(b, words)) >= need),
found as (select r, list_distinct(list(label)) as labels, max(c / n::double) as share from m group by r)
select doc_id, len(w)::bigint as n_words, len(spots)::bigint as n_base, (list_min(spots) - 1)::bigint as first_word, (list_max(spots) - 1)::bigint as last_word,
  array_to_string(said, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(said, coalesce(labels, [])))), ',') as labels,
  case when len(spots) > 0 then 1.0::double else coalesce(share, 0) end as score
from base left join found using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1_SQL, "op3_decontaminate": _OP3_SQL, "op7_near_duplicates": _OP7_SQL, "op10_license_scan": _op10_sql()}
