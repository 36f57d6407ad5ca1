"""Sectioned prompts shrunk to what a query needs, under a token budget; many prompts at once, one group each.

Sections come from leaf tags <name>...</name>, else ## headings, else numbered lines, else RULE: lines, else the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import PRIORITIES, SECTION_TOPICS, TOPIC_SECTIONS

#: Likeness to the query from which a section is taken.
SEMANTIC_AT = 0.55

_TAG = re.compile(r"<([A-Za-z_][\w-]*)>([^<]*)</([A-Za-z_][\w-]*)>")
_HEAD = re.compile(r"^##+\s+(.+)$", re.M)
_NUMBER = re.compile(r"^\s*\d+[.)]\s+(.+)$", re.M)
_RULE = re.compile(r"^\s*RULE:\s*(.+)$", re.M)


def split_sections(text: str) -> list[tuple[str, str]]:
    """(name, content) in document order; what stands before the first heading or number is left out."""
    tags = [(m[1], m[2].strip()) for m in _TAG.finditer(text) if m[1] == m[3]]
    if tags:
        return tags
    for head in (_HEAD, _NUMBER):
        at = list(head.finditer(text))
        if at:
            ends = [m.start() for m in at[1:]] + [len(text)]
            return [(m[1].strip()[:60], text[m.end() if head is _HEAD else m.start() : e].strip()) for m, e in zip(at, ends, strict=True)]
    rules = [m[1].strip() for m in _RULE.finditer(text)]
    if rules:
        return [(f"rule_{i + 1}", r) for i, r in enumerate(rules)]
    return [("content", text.strip())] if text.strip() else []


def priority(name: Column, content: Column) -> Column:
    """0 (core) to 3 by cues in name and content."""
    out = F.lit(3)
    for p, names, cues in reversed(PRIORITIES):
        out = F.when(T.contains_any(F.lower(name), names) | T.contains_any(F.lower(content), cues), p).otherwise(out)
    return out


def sections(prompts: DataFrame) -> DataFrame:
    """prompt_id, pos, section_id (unique in its prompt), name, content, tokens, topics, priority, needs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, n, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, (n, c) in enumerate(split_sections(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.string(), pa.string()])], names=["prompt_id", "pos", "name", "content"])

    raw = prompts.select(F.col("prompt_id").cast("long"), "text").mapInArrow(cut, "prompt_id long, pos int, name string, content string")
    same = Window.partitionBy("prompt_id", "base").orderBy("pos")
    named = raw.withColumn("base", T.section_name("name")).withColumn("nth", F.row_number().over(same))
    ids = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "nth"))
    return named.select("prompt_id", "pos", ids.alias("section_id"), "name", "content", T.count_tokens("content").alias("tokens"), T.topics("content", SECTION_TOPICS).alias("topics"), priority(F.col("name"), F.col("content")).alias("priority"), T.dependencies("content").alias("needs"))


def query_topics(queries: DataFrame, most: int = 4) -> DataFrame:
    """prompt_id, topics (best first, ties by name), confidence, complexity of each query (prompt_id, query)."""
    low = F.lower(F.col("query"))
    votes = F.array(*(F.struct(sum((low.contains(k).cast("int") for k in words), F.lit(0)).alias("votes"), F.lit(t).alias("topic")) for t, words in SECTION_TOPICS.items()))
    hit = F.array_sort(F.filter(votes, lambda v: v["votes"] > 0), lambda a, b: F.when(a["votes"] != b["votes"], (b["votes"] - a["votes"]).cast("int")).when(a["topic"] < b["topic"], -1).otherwise(1))
    x = queries.withColumn("_v", hit)
    total = F.aggregate("_v", F.lit(0), lambda s, v: s + v["votes"])
    none = F.size("_v") == 0
    return x.select("prompt_id", F.when(none, F.array(F.lit("conversation"))).otherwise(F.slice(F.transform("_v", lambda v: v["topic"]), 1, most)).alias("asked"), F.when(none, F.lit(0.3)).otherwise(F.get("_v", F.lit(0))["votes"] / total).alias("confidence"), T.complexity("query").alias("complexity"))


def _matches(name: str, pattern: str) -> bool:
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def choose(parts: list[dict], asked: list[str], complexity: str, most: int, least: int = 0) -> list[dict]:
    """Sections of one prompt that a query needs, in the order they are rendered.

    Core sections, those that the query's topics name or share or whose ``score`` (if they have one) reaches
    ``SEMANTIC_AT``, and what they depend on; over budget the least
    important of the unmatched go first, then of the matched; under ``least`` others fill up in document order; a
    simple query keeps two sections besides the core; one section that is still too long is cut.
    """
    named = [p for t in asked for p in TOPIC_SECTIONS.get(t, [])]
    matched = {s["section_id"] for s in parts if any(_matches(n, p) for p in named for n in (s["section_id"], s["name"])) or set(s["topics"]) & set(asked) or (s.get("score") or 0) >= SEMANTIC_AT}
    wanted = matched | {s["section_id"] for s in parts if s["priority"] == 0}
    by_id = {s["section_id"]: s for s in parts}
    queue = list(wanted)
    while queue:
        for need in by_id[queue.pop()]["needs"]:
            if need in by_id and need not in wanted:
                wanted.add(need)
                queue.append(need)
    kept = [s for s in parts if s["section_id"] in wanted] or parts[:1]
    size = lambda x: sum(s["tokens"] for s in x)
    if size(kept) > most:
        order = sorted(kept, key=lambda s: (s["priority"], s["tokens"], s["pos"]))
        for again in (False, True):
            for s in reversed(list(order)):
                if size(order) <= most:
                    break
                if s["priority"] > 0 and (again or s["section_id"] not in matched):
                    order.remove(s)
        kept = sorted(order, key=lambda s: s["section_id"])
    for s in parts:
        if size(kept) >= min(least, most):
            break
        if s not in kept:
            kept.append(s)
    if complexity == "simple":
        extra = sorted((s for s in kept if s["priority"] > 0), key=lambda s: (s["priority"], s["tokens"], s["pos"]))[:2]
        kept = [s for s in kept if s["priority"] == 0 or s in extra]
    if kept and size(kept) > most:
        longest = max(kept, key=lambda s: s["tokens"])
        cut = int(len(longest["content"]) * min(1.0, most / max(longest["tokens"], 1)) * 0.9)
        kept = [s | {"content": s["content"][:cut]} if s is longest else s for s in kept]
    return kept


def compress_prompts(prompts: DataFrame, max_tokens: int = 2000, min_tokens: int = 0, headers: bool = True, scores: DataFrame | None = None) -> DataFrame:
    """prompt_id, text, token_count, included, excluded, ratio for prompts (prompt_id, text, query). ``scores``
    (prompt_id, section_id, score; see ``retrieval.section_scores``) bring in sections that are like the query."""
    cut = sections(prompts.select("prompt_id", "text"))
    cut = cut.withColumn("score", F.lit(None).cast("double")) if scores is None else cut.join(scores, ["prompt_id", "section_id"], "left")
    parts = cut.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section_id", "name", "content", "tokens", "topics", "priority", "needs", "score"))).alias("parts"))
    both = parts.join(query_topics(prompts.select("prompt_id", F.coalesce("query", F.lit("")).alias("query"))), "prompt_id").select("prompt_id", "parts", "asked", "complexity")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kept = choose(r["parts"], r["asked"], r["complexity"], max_tokens, min_tokens)
                text = "\n\n".join(f"## {s['name']}\n{s['content']}" if headers else s["content"] for s in kept)
                names = [s["section_id"] for s in kept]
                out.append((r["prompt_id"], text, names, [s["section_id"] for s in r["parts"] if s["section_id"] not in names], sum(s["tokens"] for s in r["parts"])))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["prompt_id", "text", "included", "excluded", "total"])

    done = both.mapInArrow(shrink, "prompt_id long, text string, included array<string>, excluded array<string>, total long").withColumn("token_count", T.count_tokens("text"))
    return done.withColumn("ratio", T.ratio("token_count", "total")).drop("total")
