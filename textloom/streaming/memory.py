"""Incremental operators: rolling summaries, file states, idempotent inserts, statistics over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T

#: Messages that may be waiting before the summary is drawn up anew, and the least that this can be set to.
THRESHOLD, FLOOR = 50, 10

_SUMMARY = "conv_id bigint, summary string, summarised_until bigint, waiting bigint, seen bigint"
_STATE = "asked array<string>, said array<string>, roles array<string>, texts array<string>, turns array<bigint>, summary string, until bigint"
#: First sentences of each kind that a summary has.
MOST = 6


def _sentence(text: str) -> str:
    for i, c in enumerate(text):
        if c in ".!?":
            return text[:i].strip()[:200]
    return text.strip()[:200]


class Summary:
    """A conversation's summary, and the messages that wait to go into it. Of what is summarised only the sentences that
    summaries show are kept, so the state doesn't hold a conversation's texts."""

    def __init__(self, asked=(), said=(), roles=(), texts=(), summary="", until=0) -> None:
        self.asked, self.said, self.roles, self.texts, self.summary, self.until = list(asked), list(said), list(roles), list(texts), summary, until

    def add(self, role: str, text: str, threshold: int, recent: int) -> None:
        """Takes a message in. Once ``threshold`` wait, all but the last few go into the summary."""
        self.roles.append(role)
        self.texts.append(text)
        go = len(self.texts) - max(2 * recent, 8)
        if len(self.texts) >= threshold and go > 0:
            for r, t in zip(self.roles[:go], self.texts[:go], strict=True):
                kind = self.asked if r == "user" and "?" in t else self.said if r == "assistant" else None
                if kind is not None and len(kind) < MOST:
                    kind.append(_sentence(t))
            del self.roles[:go], self.texts[:go]
            self.until += go
            parts = [f"{lead}: {'; '.join(x)}." for lead, x in (("User asked about", self.asked), ("Assistant responses covered", self.said)) if x]
            self.summary = " ".join(parts) or "Conversation contains mixed discussion with no clear dominant thread."


def rolling_summary(messages: DataFrame, threshold: int = THRESHOLD, recent: int = 5, floor: int = FLOOR) -> DataFrame:
    """Streaming: one row a conversation and batch that touches it. Messages are (conv_id, turn, role, text).

    State holds a conversation's waiting messages, the numbers of its turns, and what its summary shows. Turns that come
    twice count once, so a replay changes nothing. The result equals ``rolling_summary_batch`` if each conversation's
    turns come in order, however they are cut.
    """
    limit = max(threshold, floor)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, said, roles, texts, turns, summary, until = state.get if state.exists else ([], [], [], [], [], "", 0)
        now, known = Summary(asked, said, roles, texts, summary, until), set(turns)
        for r in pd.concat(list(parts)).sort_values("turn").itertuples():
            if r.turn not in known:
                known.add(int(r.turn))
                now.add(r.role or "user", r.text or "", limit, recent)
        state.update((now.asked, now.said, now.roles, now.texts, sorted(map(int, known)), now.summary, now.until))
        yield pd.DataFrame([(key[0], now.summary, now.until, len(now.texts), len(known))], columns=["conv_id", "summary", "summarised_until", "waiting", "seen"])

    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), T.role("role").alias("role"), "text")
    return rows.groupBy("conv_id").applyInPandasWithState(step, _SUMMARY, _STATE, "update", GroupStateTimeout.NoTimeout)


def rolling_summary_batch(messages: DataFrame, threshold: int = THRESHOLD, recent: int = 5, floor: int = FLOOR) -> DataFrame:
    """What the stream has after all messages."""
    limit = max(threshold, floor)

    def whole(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("turn").sort_values("turn")
        now = Summary()
        for r in p.itertuples():
            now.add(r.role or "user", r.text or "", limit, recent)
        return pd.DataFrame([(key[0], now.summary, now.until, len(now.texts), len(p))], columns=["conv_id", "summary", "summarised_until", "waiting", "seen"])

    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), T.role("role").alias("role"), "text")
    return rows.groupBy("conv_id").applyInPandas(whole, _SUMMARY)


def file_states(changes: DataFrame) -> DataFrame:
    """Streaming: path, version, hash, kind (full, delta, unchanged) for contents (path, seq, content) as they come."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, last = state.get if state.exists else (0, "")
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            kind = "full" if not version else "unchanged" if r.hash == last else "delta"
            version, last = version + (kind != "unchanged"), r.hash
            out.append((key[0], version, r.hash, kind))
        state.update((version, last))
        yield pd.DataFrame(out, columns=["path", "version", "hash", "kind"])

    rows = changes.select("path", "seq", T.content_hash("content").alias("hash"))
    return rows.groupBy("path").applyInPandasWithState(step, "path string, version bigint, hash string, kind string", "version bigint, hash string", "append", GroupStateTimeout.NoTimeout)


def distinct_chunks(chunks: DataFrame, key: str = "chunk_id", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Streaming: each chunk once. With an event time, keys are forgotten once the watermark has passed them."""
    return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else chunks.dropDuplicates([key])


def windowed_stats(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Batch or streaming: count and sum of each key and window; late rows are taken until the watermark passes."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def session_stats(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Batch or streaming: events of each key's sessions."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("events")).select(by, F.col("s.start").alias("start"), "events")
