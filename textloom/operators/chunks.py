"""Messages cut into chunks: tool calls and results, fenced code, prose packed by sentences with overlap."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outputs import tokens

_FENCE = re.compile(r"```[^\n]*\n(.*?)```", re.S)
_CALL = re.compile(r"^Tool call: (\S+?)\((.*)\)\s*$", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\n")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def tool_use(text: str) -> str | None:
    """A tool call in canonical form: name and arguments with sorted keys."""
    m = _CALL.match(text.strip())
    value = _parsed(text) if text.lstrip().startswith("{") else None
    if m:
        args = _parsed(m[2])
        return f"{m[1]}({json.dumps(args, sort_keys=True, ensure_ascii=False) if args is not None else m[2]})"
    if isinstance(value, dict) and value.get("type") == "tool_use":
        return f"{value.get('name', '')}({json.dumps(value.get('input', {}), sort_keys=True, ensure_ascii=False)})"
    return None


def tool_result(text: str) -> str | None:
    value = _parsed(text) if text.lstrip().startswith("{") else None
    if isinstance(value, dict) and value.get("type") == "tool_result":
        body = value.get("content", "")
        return body if isinstance(body, str) else "\n".join(b.get("text", "") for b in body if isinstance(b, dict) and b.get("type") == "text")
    return None


def pack(text: str, target: int = 128, most: int = 256, overlap: int = 32) -> list[str]:
    """Sentences gathered up to ``target`` tokens; one longer than ``most`` is cut by words; each chunk after the first
    begins with the last ``overlap`` tokens of the one before, as it was without its own overlap."""
    out: list[str] = []
    now: list[str] = []
    used = 0
    for s in sentences(text):
        words = s.split(" ") if tokens(s) > most else None
        for part in ([" ".join(words[i : i + most // 2]) for i in range(0, len(words), max(most // 2, 1))] if words else [s]):
            n = tokens(part)
            if now and used + n > target:
                out.append(" ".join(now))
                now, used = [], 0
            now.append(part)
            used += n
    if now:
        out.append(" ".join(now))
    if not out:
        return []
    tails = [""] + [" ".join(c.split(" ")[-overlap // 2 :]) if overlap else "" for c in out[:-1]]
    return [f"{t} {c}" if t else c for t, c in zip(tails, out, strict=True)]


def chunk(text: str, **sizes: int) -> list[tuple[str, str]]:
    """(kind, content) of one message."""
    for kind, found in (("tool_use", tool_use(text)), ("tool_result", tool_result(text))):
        if found is not None:
            return [(kind, found)]
    out = [("code", m[1].strip()) for m in _FENCE.finditer(text) if m[1].strip()]
    return out + [("prose", c) for c in pack(_FENCE.sub("\n\n", text), **sizes)]


def chunk_messages(messages: DataFrame, target: int = 128, most: int = 256, overlap: int = 32) -> DataFrame:
    """conv_id, turn, pos, chunk_id (first eight bytes of SHA-256 in hex), kind, content, tokens; equal chunks once."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["conv_id", "turn", "pos", "chunk_id", "kind", "content", "tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for p, (kind, content) in enumerate(chunk(text or "", target=target, most=most, overlap=overlap)):
                    rows.append((conv, turn, p, hashlib.sha256(content.encode()).hexdigest()[:16], kind, content, tokens(content)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    cut_rows = messages.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "text").mapInArrow(cut, "conv_id long, turn long, pos int, chunk_id string, kind string, content string, tokens long")
    # The first message that has a chunk keeps it.
    first = F.struct("conv_id", "turn", "pos")
    kept = [F.min_by(c, first).alias(c) for c in ("conv_id", "turn", "pos", "kind", "content", "tokens")]
    return cut_rows.groupBy("chunk_id").agg(F.count("*").alias("times"), *kept)
