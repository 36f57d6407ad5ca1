"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import FACTS, RULE_TOPICS
from ..operators import chunks
from ..operators import memory as M
from ..streaming.memory import rolling_summary_batch


def _c(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def recent_window(spark: SparkSession, sf: str) -> DataFrame:
    return M.recent_window(_c(spark, sf), 3).select("conv_id", "turn", F.col("k").cast("long").alias("k"), "n")


def heuristic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.heuristic_summary(_c(spark, sf))


def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return M.last_turns(_c(spark, sf))


def keyword_index(spark: SparkSession, sf: str) -> DataFrame:
    return M.keyword_index(_c(spark, sf)).select("keyword", "block", F.array_join("messages", ",").alias("messages"), "n")


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_stats(_c(spark, sf))


def turn_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return M.blocks(_c(spark, sf), 3).groupBy("conv_id", "block").agg(F.count("*").alias("turns"), F.sum(T.count_tokens("text")).alias("tokens"))


def topic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return M.topic_clusters(_c(spark, sf), RULE_TOPICS).select("topic", "n")


def topic_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose words have less than 0.3 in common with the turn before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    words = _c(spark, sf).select("conv_id", "turn", F.array_distinct(T.words("text")).alias("w"))
    j = words.withColumn("p", F.lag("w").over(w)).where("p is not null").withColumn("j", T.jaccard("w", "p"))
    return j.select("conv_id", "turn", F.round("j", 6).alias("jaccard"), (F.col("j") < 0.3).alias("breaks"))


def compress_history(spark: SparkSession, sf: str) -> DataFrame:
    out = M.compress_history(_c(spark, sf), max_tokens=200, base=2, passthrough=3)
    return out.select("conv_id", F.length("summary").alias("summary_chars"), F.size("facts").alias("facts"), F.size("recent").alias("recent"), "original_count", "token_count")


def rolling_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the streaming operator, with a threshold that conversations of eight turns reach."""
    return rolling_summary_batch(_c(spark, sf), threshold=4, recent=1, floor=2)


def message_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_messages(_c(spark, sf)).select("conv_id", "turn", "pos", "chunk_id", "kind", "tokens", "times")


def conversation_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of user turns, of which the invented texts hold few; the count of messages comes with each conversation."""
    said = M.facts(_c(spark, sf)).groupBy("conv_id").agg(F.count("*").alias("facts"))
    return _c(spark, sf).groupBy("conv_id").agg(F.count("*").alias("messages")).join(said, "conv_id", "left").select("conv_id", "messages", F.coalesce("facts", F.lit(0)).alias("facts"))


QUERIES = {f.__name__: f for f in (recent_window, heuristic_summary, last_turns, keyword_index, token_stats, turn_blocks, topic_clusters, topic_breaks, compress_history, rolling_summary, message_chunks, conversation_facts)}

_ROLE = "case when lower(trim(role)) in ('assistant', 'system') then lower(trim(role)) else 'user' end"
_SENT = "substr(trim(regexp_extract(text, '^[^.!?]*', 0), ' '), 1, 200)"
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]'))"



def _facts_sql() -> str:
    """Matches of all rules in user turns; equal contents of a conversation count once."""
    rules = []
    for _, pattern, form in FACTS:
        # Word characters of all scripts, within brackets and alone.
        p = pattern.replace("(\\w+ ", r"([\p{L}\p{N}_]+ ").replace(r"\w", r"\p{L}\p{N}_").replace("'", "''")
        form = form.replace("'", "''")
        rules.append(f"select conv_id, list_transform(list_zip(regexp_extract_all(text, '{p}', 0), regexp_extract_all(text, '{p}', 1)), lambda x: trim(replace(replace('{form}', '{{0}}', trim(x[1], ' ')), '{{1}}', trim(x[2], ' ')), ' ')) as l from u")
    return f"""with u as (select conv_id, text from conversations where lower(trim(role, ' ')) not in ('assistant', 'system')),
f as (select conv_id, unnest(l) as content from ({" union all ".join(rules)})),
n as (select conv_id, count(distinct lower(content)) as facts from f where content <> '' group by conv_id)
select conv_id, count(*) as messages, coalesce(any_value(facts), 0) as facts from conversations left join n using (conv_id) group by conv_id"""


SQL = {
    "conversation_facts": _facts_sql(),
    "recent_window": "select conv_id, turn, k, n from (select conv_id, turn, count(*) over (partition by conv_id) as n, greatest(3, floor(log2(count(*) over (partition by conv_id))))::bigint as k, row_number() over (partition by conv_id order by turn desc) as b from conversations) where b <= k",
    "heuristic_summary": f"""with m as (select conv_id, turn, {_ROLE} as r, text, {_SENT} as s from conversations),
g as (select conv_id, list(s order by turn) filter (where r = 'user' and contains(text, '?')) as asked, list(s order by turn) filter (where r = 'assistant') as said, count(*) filter (where contains(text, '```')) as code from m group by conv_id)
select conv_id, coalesce(nullif(concat_ws(' ', 'User asked about: ' || array_to_string(asked[1:6], '; ') || '.', 'Assistant responses covered: ' || array_to_string(said[1:6], '; ') || '.', case when code > 0 then 'Conversation included ' || code || ' code-oriented message(s).' end), ''), 'Conversation contains mixed discussion with no clear dominant thread.') as summary from g""",
    "last_turns": f"with m as (select conv_id, turn, upper(substr({_ROLE}, 1, 1)) || substr({_ROLE}, 2) || ': ' || {_SENT} as line, row_number() over (partition by conv_id order by turn desc) as b from conversations) select conv_id, string_agg(line, ' | ' order by turn) as transcript from m where b <= 5 group by conv_id",
    "keyword_index": r"with k as (select distinct conv_id // 1000 as block, conv_id || ':' || turn as m, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: strlen(w) >= 4)) as keyword from conversations) select keyword, block, string_agg(m, ',' order by m) as messages, count(*) as n from k group by keyword, block",
    "token_stats": f"select role as module, count(*) as calls, sum({_TOKENS})::bigint as original_tokens, sum({_TOKENS})::bigint as compressed_tokens from conversations group by rollup(role)",
    "turn_blocks": f"select conv_id, block, count(*) as turns, sum(t)::bigint as tokens from (select conv_id, (row_number() over (partition by conv_id order by turn) - 1) // 3 as block, {_TOKENS} as t from conversations) group by conv_id, block",
    "topic_clusters": "select topic, count(*) as n from (select unnest(case when len(t) = 0 then ['general'] else t end) as topic from (select list_filter([" + ", ".join(f"case when {' or '.join(f"contains(lower(text), '{k}')" for k in words)} then '{t}' end" for t, words in RULE_TOPICS.items()) + "], lambda x: x is not null) as t from conversations)) group by topic",
    "topic_breaks": r"with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from conversations), p as (select *, lag(w) over (partition by conv_id order by turn) as p from w), j as (select conv_id, turn, case when len(list_distinct(list_concat(w, p))) = 0 then 1.0::double else len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p)))::double end as j from p where p is not null) select conv_id, turn, round(j, 6) as jaccard, j < 0.3 as breaks from j",
}
