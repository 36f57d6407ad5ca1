"""Conversation memory: recent window, facts with supersession, summaries, keyword index, budgets.

Messages are (conv_id, turn, role, text); conversations are many, each is one group ordered by turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import FACTS, MUTABLE
from .outputs import tokens
from .retrieval import keyword_embedding

#: The longest cut that one step of the budget loop takes off a summary, and the length from which it cuts.
SUMMARY_STEP, SUMMARY_FLOOR = 80, 120


def recent_window(messages: DataFrame, base: int = 5) -> DataFrame:
    """The last k turns of each conversation, k = max(base, floor(log2 n)); adds n, k."""
    w = Window.partitionBy("conv_id")
    back = F.row_number().over(w.orderBy(F.col("turn").desc()))
    k = F.greatest(F.lit(base), F.floor(F.log2("n")).cast("int"))
    return messages.withColumn("n", F.count("*").over(w)).withColumn("k", k).withColumn("back", back).where("back <= k").drop("back")


def _fact(rule: int, category: str, form: str) -> Callable[[Column, Column], Column]:
    """What a match of a rule, the ``at``-th in its message, says."""

    def said(x: Column, at: Column) -> Column:
        content = F.trim(F.replace(F.replace(F.lit(form), F.lit("{0}"), F.trim(x["whole"])), F.lit("{1}"), F.trim(x["first"])))
        return F.struct((F.lit(rule * 100_000) + at).alias("seq"), F.lit(category).alias("category"), content.alias("content"))

    return said


def facts(messages: DataFrame, rules: list[tuple[str, str, str]] = FACTS) -> DataFrame:
    """conv_id, turn, seq, category, content, superseded of statements in user turns; equal ones (but for case) once."""
    user = messages.where(T.role("role") == "user").select("conv_id", "turn", "text")
    every = []
    for i, (category, pattern, form) in enumerate(rules):
        whole, first = (F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(g)) for g in (0, 1))
        every.append(F.transform(F.arrays_zip(whole.alias("whole"), first.alias("first")), _fact(i, category, form)))
    # The matches of all rules in one array: messages are read once.
    out = user.select("conv_id", "turn", F.explode(F.concat(*every)).alias("x")).select("conv_id", "turn", "x.*")
    once = Window.partitionBy("conv_id", F.lower("content")).orderBy("turn", "seq")
    out = out.where("content <> ''").withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    latest = F.row_number().over(Window.partitionBy("conv_id", "category").orderBy(F.col("turn").desc(), "seq"))
    return out.withColumn("superseded", F.col("category").isin(MUTABLE) & (latest > 1))


def heuristic_summary(messages: DataFrame, most: int = 6) -> DataFrame:
    """conv_id, summary: first sentences of the first user questions and assistant turns, and the count of code turns."""
    sentence = T.first_sentence("text")
    r = T.role("role")
    one = messages.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when((r == "user") & F.col("text").contains("?"), F.struct("turn", sentence.alias("s"))))).alias("asked"),
        F.array_sort(F.collect_list(F.when(r == "assistant", F.struct("turn", sentence.alias("s"))))).alias("said"),
        F.count_if(F.col("text").contains("```")).alias("code"),
    )

    def listed(c: str, lead: str):
        return F.when(F.size(c) > 0, F.concat(F.lit(lead), F.array_join(F.transform(F.slice(c, 1, most), lambda x: x["s"]), "; "), F.lit(".")))

    code = F.when(F.col("code") > 0, F.format_string("Conversation included %d code-oriented message(s).", "code"))
    summary = F.concat_ws(" ", listed("asked", "User asked about: "), listed("said", "Assistant responses covered: "), code)
    return one.select("conv_id", F.when(summary == "", "Conversation contains mixed discussion with no clear dominant thread.").otherwise(summary).alias("summary"))


def last_turns(messages: DataFrame, most: int = 5) -> DataFrame:
    """conv_id, transcript: role and first sentence of the last turns in order."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)
    line = F.concat(F.initcap(T.role("role")), F.lit(": "), T.first_sentence("text"))
    return last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), " | ").alias("transcript"))


def keyword_index(messages: DataFrame, conversations: int = 1000) -> DataFrame:
    """keyword, block, messages (sorted conv_id:turn), n, of words of four bytes or more. A row lists the messages of one
    block of ``conversations`` ids, so a word that all messages hold makes many rows and none of them is unbounded."""
    each = messages.select(F.floor(F.col("conv_id") / conversations).alias("block"), F.concat_ws(":", "conv_id", "turn").alias("m"), F.explode(F.array_distinct(T.keywords("text"))).alias("keyword"))
    return each.groupBy("keyword", "block").agg(F.array_sort(F.collect_list("m")).alias("messages"), F.count("*").alias("n"))


def expand(messages: DataFrame, queries: DataFrame, k: int = 12, base: int = 5) -> DataFrame:
    """query_id, conv_id, turn of the messages that a query (query_id, conv_id, text) needs of its conversation: the
    recent window, and the ``k`` messages that are likest to it by their words, ties in order of turns."""
    embedded = keyword_embedding(messages.select(F.struct("conv_id", "turn").alias("at"), "text"), "at").select("at.conv_id", "at.turn", F.col("embedding").alias("a"))
    asked = keyword_embedding(queries.select(F.struct("query_id", "conv_id").alias("at"), "text"), "at").select("at.query_id", "at.conv_id", F.col("embedding").alias("b"))
    near = embedded.join(asked, "conv_id").select("query_id", "conv_id", "turn", F.round(T.dot("a", "b"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "turn")
    best = near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).select("query_id", "conv_id", "turn")
    recent = recent_window(messages, base).select("conv_id", "turn").join(queries.select("query_id", "conv_id"), "conv_id").select("query_id", "conv_id", "turn")
    return best.union(recent).distinct()


def topic_clusters(messages: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """topic, n, first three summaries of its messages."""
    each = messages.select("conv_id", "turn", T.first_sentence("text", 180).alias("s"), F.explode(T.topics("text", table)).alias("topic"))
    w = Window.partitionBy("topic").orderBy("conv_id", "turn")
    top = each.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("x"))
    return each.groupBy("topic").agg(F.count("*").alias("n")).join(top, "topic").select("topic", "n", F.transform("x", lambda x: x["s"]).alias("summaries"))


def token_stats(messages: DataFrame, module: str = "role", original: str = "text", compressed: str | None = None) -> DataFrame:
    """calls and token sums of each module and of all (module null)."""
    counted = messages.select(F.col(module).alias("module"), T.count_tokens(original).alias("a"), T.count_tokens(compressed or original).alias("b"))
    return counted.rollup("module").agg(F.count("*").alias("calls"), F.sum("a").alias("original_tokens"), F.sum("b").alias("compressed_tokens"))


def blocks(messages: DataFrame, size: int = 30) -> DataFrame:
    """messages with the number of their block of ``size`` turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("block", F.floor((F.row_number().over(w) - 1) / size))


def fit_budget(summary: str, active: list[str], recent: list[str], most: int) -> tuple[str, list[str], list[str], int]:
    """Cuts the summary's end, then drops the last facts, then the oldest turns, until all fits into ``most`` tokens."""
    while True:
        used = tokens("\n".join([summary, "\n".join(active), "\n".join(recent)]))
        if used <= most:
            return summary, active, recent, used
        if len(summary) > SUMMARY_FLOOR:
            summary = summary[: len(summary) - SUMMARY_STEP] + "..."
        elif active:
            active = active[:-1]
        elif recent:
            recent = recent[1:]
        else:
            return summary, active, recent, used


def compress_history(messages: DataFrame, max_tokens: int = 2000, base: int = 5, passthrough: int = 10) -> DataFrame:
    """One row a conversation: summary, facts (still active), recent (texts), original_count, token_count.

    Conversations of fewer than ``passthrough`` messages that fit as they are come back whole and without a summary.
    """
    texts = messages.groupBy("conv_id").agg(F.count("*").alias("original_count"), F.sum(T.count_tokens("text")).alias("raw"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("whole"))
    recent = recent_window(messages, base)
    kept = recent.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("recent"), F.min("turn").alias("from_turn"))
    older = messages.join(kept.select("conv_id", "from_turn"), "conv_id").where("turn < from_turn")
    said = facts(messages).where("not superseded").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "seq", "content"))), lambda x: x["content"]).alias("facts"))
    joined = texts.join(kept.drop("from_turn"), "conv_id").join(heuristic_summary(older), "conv_id", "left").join(said, "conv_id", "left")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples():
                found = list(r.facts) if r.facts is not None else []
                if r.raw + 16 <= max_tokens and r.original_count < passthrough:
                    rows.append((r.conv_id, "", found, list(r.whole), r.original_count, int(r.raw)))
                else:
                    rows.append((r.conv_id, *(lambda s, f, m, n: (s, f, m, r.original_count, n))(*fit_budget(r.summary or "No previous messages to summarize.", found, list(r.recent), max_tokens))))
            yield pd.DataFrame(rows, columns=["conv_id", "summary", "facts", "recent", "original_count", "token_count"])

    return joined.mapInPandas(cut, "conv_id bigint, summary string, facts array<string>, recent array<string>, original_count bigint, token_count bigint")
