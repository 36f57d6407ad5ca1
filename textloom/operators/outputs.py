"""Command outputs shrunk line by line: the first filter that fits the command runs its steps in order.

All outputs go through in one pass: a row's output is one unit of work, so batches of rows are handed to Python as
Arrow and no shuffle is needed. Sizes of budgets are estimated tokens (see ``functions.text.count_tokens``).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import FILTERS, Filter, Step

_STAMP = re.compile(T.TIMESTAMP)
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]{1,4}|[^\w\s]|_")
#: What takes the place of array items that are left out.
MORE_ITEMS = "... and {n} more items of similar shape"


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def split_lines(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def _filter_lines(lines: list[str], step: Step) -> list[str]:
    keep, remove = (re.compile("|".join(f"(?:{p})" for p in ps)) if ps else None for ps in (step.keep, step.remove))
    return [x for x in lines if keep and keep.search(x) or not (remove and remove.search(x))]


def _group(lines: list[str], step: Step) -> list[str]:
    key = re.compile(step.key)
    loose, groups = [], {}
    for x in lines:
        m = key.search(x)
        groups.setdefault(m[1], []).append(x) if m else loose.append(x)
    for k in sorted(groups, key=lambda s: s.encode()):
        n = len(groups[k])
        loose += [step.form.replace("{key}", k).replace("{count}", str(n))] if n >= max(step.least, 2) else groups[k]
    return loose


def normal(line: str) -> str:
    return _NUMBER.sub("<N>", _STAMP.sub("<TS>", line)).strip()


def dedup(lines: list[str], threshold: float, form: str) -> list[str]:
    """Lines that equal an earlier one but for numbers, or share ``threshold`` of their words with it, are counted there.

    Of several earlier lines that fit, the latest takes the count. Two sets of words that are so much alike share one of
    the rarest words of each, as many as may be missing and one more (prefix filter): only lines that do are compared.
    """
    norms = [normal(x) for x in lines]
    sets = {n: frozenset(n.split()) for n in dict.fromkeys(norms)}
    often = Counter(w for s in sets.values() for w in s)
    first: list[int] = []
    count: list[int] = []
    exact: dict[str, int] = {}
    holders: dict[str, list[int]] = {}
    blank = -1
    for i, norm in enumerate(norms):
        own = sets[norm]
        best = exact.get(norm, -1)
        if not own:
            best = max(best, blank)
        spare = len(own) - math.ceil(threshold * len(own) - 1e-9)
        head = sorted(own, key=lambda w: (often[w], w))[: spare + 1]
        for b in sorted({b for w in head for b in holders.get(w, ())}, reverse=True):
            if b <= best:
                break
            n = len(own & sets[norms[first[b]]])
            if n >= threshold * (len(own) + len(sets[norms[first[b]]]) - n):
                best = b
        if best >= 0:
            count[best] += 1
            continue
        b = len(first)
        first.append(i)
        count.append(1)
        exact[norm] = b
        if not own:
            blank = b
        for w in head:
            holders.setdefault(w, []).append(b)
    return [lines[i] if n == 1 else form.replace("{line}", lines[i]).replace("{count}", str(n)) for i, n in zip(first, count, strict=True)]


def middle(lines: list[str], most: int, form: str) -> list[str]:
    if not most or len(lines) <= most:
        return lines
    half = most // 2
    return [*lines[:half], form.replace("{n}", str(len(lines) - 2 * half)), *lines[len(lines) - half :]]


def columns(lines: list[str], fields: list[str]) -> list[str]:
    """Chosen columns of a table whose cells begin where the header's names do."""
    if not lines:
        return lines
    heads = [(m.start(), m[0]) for m in re.finditer(r"\S+", lines[0])]
    pick = [i for f in fields for i in [next((i for i, (_, h) in enumerate(heads) if h.lower() == f.lower()), None)] if i is not None]
    if not pick:
        return lines
    starts = [s for s, _ in heads] + [None]
    return ["  ".join(heads[i][1] for i in pick)] + ["  ".join(x[starts[i] : starts[i + 1]].strip() for i in pick) for x in lines[1:]]


def shrink_json(value, items: int, chars: int):
    if isinstance(value, list):
        kept = [shrink_json(v, items, chars) for v in (value[:items] if items else value)]
        return kept + [MORE_ITEMS.replace("{n}", str(len(value) - items))] if items and len(value) > items else kept
    if isinstance(value, dict):
        return {k: shrink_json(v, items, chars) for k, v in value.items()}
    if isinstance(value, str) and chars and len(value) > chars:
        return f"{value[:chars]}… (clipped, original {len(value)} chars)"
    return value


def json_text(text: str, items: int, chars: int) -> str:
    if not text.lstrip()[:1] or text.lstrip()[0] not in '{["-0123456789tfn':
        return text
    try:
        return json.dumps(shrink_json(json.loads(text), items, chars), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def cap(text: str, budget: int, head: int, tail: int) -> str:
    """Head and tail lines of a text over budget, at four characters a token and 256 characters at least."""
    most, lines = max(4 * budget, 256), split_lines(text)
    if len(text) <= most:
        return text
    begin = "\n".join(lines[:head])
    rest = lines[head:]
    end = "\n".join(rest[max(len(rest) - tail, 0) :]) if tail else ""
    form = "... token budget reached ({n} chars omitted) ..."
    if len(begin) + len(end) + len(form) + 8 >= most:
        cut = max(most - len(form) - 8, 0)
        return text[:cut] + "\n" + form.replace("{n}", str(len(text) - cut))
    return "\n".join([begin, form.replace("{n}", str(len(text) - len(begin) - len(end))), end])


def route(command: str, filters: list[Filter] = FILTERS) -> Filter:
    return next(f for f in filters if any(re.search(p, command) for p in f.commands))


def compress(command: str, output: str, filters: list[Filter] = FILTERS) -> tuple[str, str, list[str]]:
    """(text, filter, steps that changed it) of one output."""
    f = route(command, filters)
    now, used = output, []
    for s in f.steps:
        if s.kind == "json":
            new = json_text(now, s.items, s.chars)
        else:
            x = split_lines(now)
            short = s.kind == "truncate" and len(x) <= s.most
            new = now if short or s.kind == "columns" and columns(x, s.fields) is x else "\n".join(
                _filter_lines(x, s) if s.kind == "filter" else _group(x, s) if s.kind == "group" else dedup(x, s.threshold, s.form) if s.kind == "dedup" else middle(x, s.most, s.form) if s.kind == "truncate" else columns(x, s.fields)
            )
        if new != now:
            used.append(s.kind)
            now = new
    if "json" not in used and tokens(now) > f.budget:
        new = cap(now, f.budget, f.head, f.tail)
        if new != now:
            used.append("budget_cap")
            now = new
    return now, f.name, used


def compress_outputs(outputs: DataFrame, filters: list[Filter] = FILTERS) -> DataFrame:
    """All columns of ``outputs`` (command, output, ...) with compressed, filter_name, steps, token counts and ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("_command").to_pylist(), batch.column("_output").to_pylist(), strict=True)
            done = [compress(c or "", o or "", filters) for c, o in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.list_(pa.string()))], names=["row", "compressed", "filter_name", "steps"])

    packed = outputs.select(F.struct("*").alias("row"), F.col("command").alias("_command"), F.col("output").alias("_output"))
    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, compressed string, filter_name string, steps array<string>")
    out = found.select("row.*", "compressed", "filter_name", "steps")
    counted = out.withColumn("original_tokens", F.coalesce(T.count_tokens("output"), F.lit(0))).withColumn("compressed_tokens", T.count_tokens("compressed"))
    return counted.withColumn("ratio", T.ratio("compressed_tokens", "original_tokens"))


def filter_name(command: Column | str, filters: list[Filter] = FILTERS) -> Column:
    """The first filter that fits, as an expression."""
    c, out = T.col(command), None
    for f in reversed(filters):
        hit = F.lit(False)
        for p in f.commands:
            hit = hit | c.rlike(p)
        out = F.lit(f.name) if out is None else F.when(hit, f.name).otherwise(out)
    return out


def kept_lines(array: Column | str, remove: list[str], keep: list[str]) -> Column:
    """The line filter as an expression over an array of lines."""
    def stays(x: Column) -> Column:
        out = ~x.rlike("|".join(f"(?:{p})" for p in remove)) if remove else F.lit(True)
        return x.rlike("|".join(f"(?:{p})" for p in keep)) | out if keep else out

    return F.filter(T.col(array), stays)


def group_lines(docs: DataFrame, key: str, pattern: str, least: int, text: str = "text") -> DataFrame:
    """``key``, group, lines of each captured group of at least ``least`` lines."""
    each = docs.select(key, F.explode(T.lines(text)).alias("line")).select(key, F.regexp_extract("line", pattern, 1).alias("group")).where("group <> ''")
    return each.groupBy(key, "group").agg(F.count("*").alias("lines")).where(F.col("lines") >= max(least, 2))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", normal_form: bool = False) -> DataFrame:
    """Lines (or their normal forms) that occur more than once over all rows: line, times, rows, first_row."""
    line = F.explode(T.lines(text)).alias("line")
    each = docs.select(key, line)
    if normal_form:
        each = each.withColumn("line", T.normal_line("line"))
    # Counted within a row first, so a line that all rows share is one pre-aggregated row for each.
    own = each.groupBy(key, "line").agg(F.count("*").alias("n"))
    return own.groupBy("line").agg(F.sum("n").alias("times"), F.count("*").alias("rows"), F.min(key).alias("first_row")).where("times > 1")
