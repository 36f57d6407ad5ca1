"""Queries over lines, hashes, repeats and normal forms of texts, and over versions and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import RULE_TOPICS, SECTION_TOPICS
from ..operators import deltas, outputs


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def content_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def line_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.size(T.lines("text")).alias("n_lines"), F.array_join(T.line_hashes("text"), ",").alias("hashes"))


def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.repeated_lines(_t(spark, sf, "documents"))


def line_norm_groups(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.repeated_lines(_t(spark, sf, "documents"), normal_form=True)


def middle_truncate(spark: SparkSession, sf: str) -> DataFrame:
    cut = T.middle_lines(T.lines("text"), 6, "... {n} lines omitted ...")
    return _t(spark, sf, "documents").select("doc_id", T.unlines(cut).alias("text"))


def filter_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = outputs.kept_lines(T.lines("text"), [r"^Th", r"\|"], [r"[0-9]"])
    return _t(spark, sf, "documents").select("doc_id", T.unlines(kept).alias("text"))


def group_lines(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.group_lines(_t(spark, sf, "documents"), "doc_id", r"^([A-Z][a-z])", 3)


def link_hosts(spark: SparkSession, sf: str) -> DataFrame:
    hosts = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    return _t(spark, sf, "pages").groupBy(hosts.alias("host")).agg(F.count("*").alias("pages"), F.sum(T.count_tokens("html")).alias("tokens"))


def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.first_sentence("text").alias("sentence"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.count_tokens("text").cast("long").alias("tokens"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", T.short_hash("text").alias("chunk_id"))


def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the one 1 higher in doc_id, on distinct words."""
    d = _t(spark, sf, "documents").select("doc_id", F.array_distinct(T.words("text")).alias("w"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(other, "doc_id").select("doc_id", F.round(T.jaccard("w", "v"), 6).alias("jaccard"))


def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.array_join(T.topics("text", RULE_TOPICS), ",").alias("rule_topics"), F.array_join(T.topics("text", SECTION_TOPICS), ",").alias("section_topics"))


def shared_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.fragments(_t(spark, sf, "documents"))


def fragment_coding(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    coded = deltas.encode(d, deltas.fragments(d))
    return coded.select("doc_id", F.size("used").cast("long").alias("used"), F.length("encoded").cast("long").alias("chars"))


def fragment_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    words = deltas.fragments(d)
    return deltas.decode(deltas.encode(d, words), words).select("doc_id", T.content_hash("text").alias("hash"))


def file_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as successive versions of one file."""
    return deltas.versions(_t(spark, sf, "documents"), "source", "doc_id").select("source", "doc_id", "version", "hash", "kind")


def version_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return deltas.versions(_t(spark, sf, "documents"), "source", "doc_id").where("kind = 'delta'").select("doc_id", "prefix", "removed", "inserted", "suffix")


def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two states of the documents: without every fifth; without every seventh, and every third a character longer."""
    d = _t(spark, sf, "documents").select("doc_id", "n_chars", "source")
    old = d.where("doc_id % 5 <> 0")
    new = d.where("doc_id % 7 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return deltas.snapshot_diff(old, new, "doc_id", ["n_chars", "source"])


def repeats_of_first_word(spark: SparkSession, sf: str) -> DataFrame:
    first = F.regexp_extract("text", r"^\S+", 0)
    return _t(spark, sf, "documents").select("doc_id", T.repeats("text", first).cast("long").alias("times"))


def compress_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.lit("cat file").alias("command"), F.col("text").alias("output"))
    return outputs.compress_outputs(d).select("doc_id", "filter_name", F.array_join("steps", ",").alias("steps"), "original_tokens", "compressed_tokens", F.round("ratio", 6).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (content_hash_dedup, line_hashes, repeated_lines, line_norm_groups, middle_truncate, filter_lines, group_lines, link_hosts, first_sentences, token_counts, chunk_ids, word_jaccard, topic_labels, shared_fragments, fragment_coding, fragment_round_trip, file_versions, version_diffs, incremental_scan, repeats_of_first_word, compress_documents)
}

_LINES = r"case when text = '' then [] else string_split(regexp_replace(replace(text, E'\r\n', E'\n'), E'\n$', ''), E'\n') end"
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]{{1,4}}|[^\s\p{{L}}\p{{N}}]'))"
_FRAG = rf"""b as (select doc_id, unnest(string_split(text, E'\n')) as content from documents), own as (select doc_id, content, count(*) as n from b where {_TOKENS.format("content")} >= 8 group by doc_id, content),
f as (select substr(sha256(content), 1, 16) as fragment_id, content, {_TOKENS.format("content")} as tokens, count(*) as docs, sum(n)::bigint as times from own group by content having count(*) >= 2)"""


def _topics(table: dict[str, list[str]]) -> str:
    parts = ", ".join(f"case when {' or '.join(f"contains(lower(text), '{k}')" for k in words)} then '{t}' end" for t, words in table.items())
    return f"coalesce(nullif(array_to_string(list_sort(list_filter([{parts}], lambda x: x is not null)), ','), ''), 'general')"


_NORM = r"trim(regexp_replace(regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?', '<TS>', 'g'), '\d+', '<N>', 'g'))"
_REPEATED = "select line, sum(n)::bigint as times, count(*) as rows, min(doc_id) as first_row from (select doc_id, line, count(*) as n from (select doc_id, {1} as line from (select doc_id, unnest({0}) as line from documents)) group by doc_id, line) group by line having sum(n) > 1"

#: Versions of a source with the one before, and the lines that both have at the beginning and at the end.
_DIFFED = rf"""v as (select source, doc_id, text, lag(text) over (partition by source order by doc_id) as old from documents),
n as (select doc_id, {_LINES} as b, {_LINES.replace("text", "old")} as a from v where old is not null and sha256(old) <> sha256(text)),
p as (select *, least(len(a), len(b)) as n, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0) - 1, least(len(a), len(b))) as prefix from n),
s as (select *, coalesce(nullif(list_position(list_transform(range(1, n - prefix + 1), lambda i: a[len(a) - i + 1] = b[len(b) - i + 1]), false), 0) - 1, n - prefix) as suffix from p)"""

SQL = {
    "version_diffs": f"with {_DIFFED} select doc_id, prefix::int as prefix, (len(a) - prefix - suffix)::int as removed, (len(b) - prefix - suffix)::int as inserted, suffix::int as suffix from s",
    "content_hash_dedup": "select sha256(text) as hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "line_hashes": f"select doc_id, len({_LINES}) as n_lines, array_to_string(list_transform({_LINES}, lambda x: substr(sha256(x), 1, 16)), ',') as hashes from documents",
    "repeated_lines": _REPEATED.format(_LINES, "line"),
    "line_norm_groups": _REPEATED.format(_LINES, _NORM),
    "middle_truncate": f"select doc_id, array_to_string(case when len(l) <= 6 then l else list_concat(list_concat(l[1:3], ['... ' || (len(l) - 6) || ' lines omitted ...']), l[len(l) - 2:len(l)]) end, E'\\n') as text from (select doc_id, {_LINES} as l from documents)",
    "filter_lines": rf"select doc_id, array_to_string(list_filter({_LINES}, lambda x: regexp_matches(x, '[0-9]') or not regexp_matches(x, '^Th|\|')), E'\n') as text from documents",
    "group_lines": f"select doc_id, \"group\", count(*) as lines from (select doc_id, regexp_extract(line, '^([A-Z][a-z])', 1) as \"group\" from (select doc_id, unnest({_LINES}) as line from documents)) where \"group\" <> '' group by 1, 2 having count(*) >= 3",
    "link_hosts": f"select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, count(*) as pages, sum({_TOKENS.format('html')})::bigint as tokens from pages group by 1",
    "first_sentences": "select doc_id, substr(trim(regexp_extract(text, '^[^.!?]*', 0), ' '), 1, 200) as sentence from documents",
    "token_counts": f"select doc_id, {_TOKENS.format('text')}::bigint as tokens, length(text)::bigint as chars, strlen(text)::bigint as bytes from documents",
    "chunk_ids": "select doc_id, substr(sha256(text), 1, 16) as chunk_id from documents",
    "word_jaccard": r"with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents) select a.doc_id, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 1.0::double else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double end, 6) as jaccard from w a join w b on b.doc_id = a.doc_id + 1",
    "topic_labels": f"select doc_id, {_topics(RULE_TOPICS)} as rule_topics, {_topics(SECTION_TOPICS)} as section_topics from documents",
    "shared_fragments": f"with {_FRAG} select fragment_id, content, tokens, docs, times from f",
    "fragment_coding": f"with {_FRAG} select doc_id, count(distinct f.fragment_id) as used, (sum(case when f.fragment_id is null then length(b.content) else 22 end) + count(*) - 1)::bigint as chars from b left join f using (content) group by doc_id",
    "fragment_round_trip": "select doc_id, sha256(text) as hash from documents",
    "file_versions": "select source, doc_id, row_number() over w as version, sha256(text) as hash, case when lag(text) over w is null then 'full' when sha256(lag(text) over w) = sha256(text) then 'unchanged' else 'delta' end as kind from documents window w as (partition by source order by doc_id)",
    "incremental_scan": "with o as (select doc_id, n_chars, source from documents where doc_id % 5 <> 0), n as (select doc_id, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end as n_chars, source from documents where doc_id % 7 <> 0) select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.n_chars = n.n_chars and o.source is not distinct from n.source then 'unchanged' else 'updated' end as status from o full join n on o.doc_id = n.doc_id",
    "repeats_of_first_word": r"select doc_id, case when length(w) > 0 then ((length(text) - length(replace(text, w, ''))) // length(w))::bigint else 0 end as times from (select doc_id, text, regexp_extract(text, '^\S+', 0) as w from documents)",
}
