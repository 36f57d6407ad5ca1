"""Points where a language model, an embedder or a reranker can be plugged in; nothing is called unless one is given.

A model is any Python callable from prompt to reply. What it fails at or answers with nonsense falls back to the
heuristics, row by row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[str], str]


def first_json(text: str) -> str | None:
    """The first balanced JSON object of a reply, braces in strings aside."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


def ask(model: Model | None, prompt: str) -> str | None:
    """The model's reply (of a JSON envelope: its result), or None."""
    if model is None:
        return None
    try:
        reply = model(prompt)
    except Exception:  # noqa: BLE001  a model may fail in any way; the caller has a heuristic
        return None
    if not reply or not reply.strip():
        return None
    try:
        value = json.loads(reply)
        return value["result"] if isinstance(value, dict) and isinstance(value.get("result"), str) else reply
    except ValueError:
        return reply


def with_replies(rows: DataFrame, prompt: str, model: Model | None, name: str = "reply") -> DataFrame:
    """Adds the model's reply to each row's prompt column, null without one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{name: [ask(model, x) for x in p[prompt]]})

    return rows.mapInPandas(run, f"{fields}, `{name}` string")


def triples(reply: str | None, most: int = 80) -> list[dict]:
    """Triples of a reply of the form {"triples": [{"subject", "predicate", "object", "confidence"}]}."""
    try:
        found = json.loads(first_json(reply or "") or "{}").get("triples", [])
    except ValueError:
        return []
    out = []
    for t in found if isinstance(found, list) else []:
        if isinstance(t, dict) and all(isinstance(t.get(k), str) and t[k].strip() for k in ("subject", "predicate", "object")):
            c = t.get("confidence", 0.7)
            out.append({"subject": t["subject"], "predicate": t["predicate"], "object": t["object"], "confidence": min(max(float(c), 0.0), 1.0) if isinstance(c, int | float) else 0.7})
    return out[:most]


def variants(query: str, reply: str | None, most: int = 5) -> list[str]:
    """The query and up to ``most`` sub-queries or rewrites, one a line of the reply."""
    more = [x.strip(" -*0123456789.)\t") for x in (reply or "").splitlines()]
    return list(dict.fromkeys([query, *(x for x in more if x)]))[: most + 1]


def rerank(scores: list[float], reply: str | None) -> list[float]:
    """Scores of a reply (numbers 0 to 10, padded with 5) as shares of ten; without a reply the given ones."""
    if reply is None:
        return scores
    numbers = []
    for x in reply.replace(",", " ").split():
        try:
            numbers.append(min(max(float(x), 0.0), 10.0))
        except ValueError:
            continue
    return [x / 10 for x in (numbers + [5.0] * len(scores))[: len(scores)]]
