"""Versions, deltas and snapshots: what changed between two states of rows, and dictionary coding of repeated blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _common(x: str, y: str, most: Column) -> Column:
    """How many of the first ``most`` items of two array columns are equal from the start."""
    same = F.zip_with(F.slice(x, F.lit(1), F.greatest(most, F.lit(1))), F.slice(y, F.lit(1), F.greatest(most, F.lit(1))), lambda p, q: p == q)
    at = F.array_position(same, F.lit(False))
    return F.when(most <= 0, F.lit(0)).when(at == 0, most).otherwise(at - 1).cast("int")


def with_diff(rows: DataFrame, old: str, new: str, name: str = "d") -> DataFrame:
    """Adds a struct of prefix (equal lines first), removed, inserted (lines), suffix (equal lines last): one operation
    in the middle turns ``old`` into ``new``. Each part is a column of its own, so none is worked out twice."""
    x = rows.withColumn("_a", T.lines(old)).withColumn("_b", T.lines(new)).withColumn("_n", F.least(F.size("_a"), F.size("_b")))
    x = x.withColumn("_p", _common("_a", "_b", F.col("_n")))
    x = x.withColumn("_ra", F.reverse("_a")).withColumn("_rb", F.reverse("_b")).withColumn("_s", _common("_ra", "_rb", F.col("_n") - F.col("_p")))
    added = F.slice("_b", F.col("_p") + 1, F.greatest(F.size("_b") - F.col("_p") - F.col("_s"), F.lit(0)))
    change = F.struct(F.col("_p").alias("prefix"), (F.size("_a") - F.col("_p") - F.col("_s")).alias("removed"), added.alias("inserted"), F.col("_s").alias("suffix"))
    return x.withColumn(name, change).drop("_a", "_b", "_n", "_p", "_ra", "_rb", "_s")


def patch(old: Column | str, change: Column) -> Column:
    """The lines that a change of ``with_diff`` leads to."""
    a = T.lines(old)
    return F.concat(F.slice(a, F.lit(1), change["prefix"]), change["inserted"], F.slice(a, change["prefix"] + change["removed"] + 1, F.greatest(change["suffix"], F.lit(0))))


def versions(rows: DataFrame, path: str, order: str, text: str = "text") -> DataFrame:
    """Each version of a path with its hash, kind (full, unchanged, delta), and the lines it keeps, drops and adds.

    Versions are numbered by ``order``, which is unique within a path; a null text has none before it. Only hashes are
    put in order; texts are fetched for deltas alone, by path and place.
    """
    w = Window.partitionBy(path).orderBy(order)
    out = rows.select(path, order, T.content_hash(text).alias("hash")).withColumn("version", F.row_number().over(w))
    out = out.withColumn("old_hash", F.lag("hash").over(w)).withColumn("_before", F.lag(order).over(w))
    kind = F.when(F.col("old_hash").isNull(), "full").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("delta")
    out = out.withColumn("kind", kind).drop("old_hash")
    texts = rows.select(path, F.col(order).alias("_at"), F.col(text).alias("_text"))
    changed = out.where("kind = 'delta'").select(path, order, "_before")
    both = changed.join(texts.toDF(path, order, "_new"), [path, order]).join(texts.toDF(path, "_before", "_old"), [path, "_before"])
    d = with_diff(both, "_old", "_new").select(path, order, "d.prefix", "d.removed", F.size("d.inserted").alias("inserted"), "d.suffix")
    return out.join(d, [path, order], "left").select(path, order, "version", "hash", "kind", "prefix", "removed", "inserted", "suffix")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: list[str]) -> DataFrame:
    """key, status (added, removed, updated, unchanged) of rows by the columns ``state``."""
    a, b = old.select(key, F.struct(*state).alias("_old")), new.select(key, F.struct(*state).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def read_delta(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests (path, known_version, known_hash) answered from snapshots (path, version, content): the newest as a
    whole, as lines changed since the known version, or as unchanged; missing if there is none."""
    last = snapshots.groupBy("path").agg(F.max("version").alias("now"))
    newest = snapshots.join(last, "path").where("version = now").select("path", "now", F.col("content").alias("current"))
    known = snapshots.select("path", F.col("version").alias("known_version"), F.col("content").alias("base"))
    got = requests.join(newest, "path", "left").join(known, ["path", "known_version"], "left")
    same = (T.content_hash("current") == F.col("known_hash")) | (F.col("known_version") == F.col("now"))
    kind = F.when(F.col("now").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("base").isNotNull(), "delta").otherwise("full")
    got = with_diff(got.withColumn("kind", kind), "base", "current")
    return got.select("path", "known_version", F.col("now").alias("version"), "kind", F.when(F.col("kind") == "full", F.col("current")).alias("content"), F.when(F.col("kind") == "delta", F.col("d")).alias("change"))


def write_delta(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Edits (path, base_version, content) on the newest snapshots: path, accepted, version. A base that isn't the newest is refused."""
    newest = snapshots.groupBy("path").agg(F.max("version").alias("now"))
    got = edits.join(newest, "path", "left")
    ok = F.col("base_version").eqNullSafe(F.col("now"))
    return got.select("path", ok.alias("accepted"), F.when(ok, F.coalesce("now", F.lit(0)) + 1).otherwise(F.col("now")).alias("version"))


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The ``most`` rows of each group that come first: retention of caches and logs."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", least_tokens: int = 8, least_docs: int = 2) -> DataFrame:
    """The dictionary of blocks that several rows share: fragment_id (16 hex of SHA-256), content, tokens, docs, times."""
    own = docs.select(key, F.explode(F.split(text, separator)).alias("content")).where(T.count_tokens("content") >= least_tokens).groupBy(key, "content").agg(F.count("*").alias("n"))
    return own.groupBy("content").agg(F.count("*").alias("docs"), F.sum("n").alias("times")).where(F.col("docs") >= least_docs).select(T.short_hash("content").alias("fragment_id"), "content", T.count_tokens("content").alias("tokens"), "docs", "times")


def _alone(key: str) -> Column:
    """A key for a block that no fragment has, and that spreads blocks evenly."""
    return F.concat(F.lit("-"), F.xxhash64(key, "pos").cast("string"))


def encode(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """key, encoded, used (fragment ids): blocks found in the dictionary become references of the form [[f:id]].

    Blocks are matched by their hash in a join, so the dictionary may be of any size. Blocks shorter than all of the
    dictionary's, blank lines for one, get a key of their own instead, so they don't meet in one task.
    """
    least = dictionary.agg(F.min(F.length("content"))).first()[0]
    each = docs.select(key, F.posexplode(F.split(text, separator)).alias("pos", "content"))
    able = F.lit(False) if least is None else F.length("content") >= least
    each = each.withColumn("fragment_id", F.when(able, T.short_hash("content")).otherwise(_alone(key)))
    hit = each.join(dictionary.select("fragment_id", F.lit(True).alias("known")), "fragment_id", "left")
    # A block that already looks like a reference is escaped, so that decoding is exact.
    plain = F.regexp_replace("content", r"^(\\*\[\[f:)", r"\\$1")
    part = F.when(F.col("known"), F.concat(F.lit("[[f:"), "fragment_id", F.lit("]]"))).otherwise(plain)
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return hit.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), separator).alias("encoded"), F.array_sort(F.collect_set(F.when(F.col("known"), F.col("fragment_id")))).alias("used"))


def decode(encoded: DataFrame, dictionary: DataFrame, key: str = "doc_id", separator: str = "\n") -> DataFrame:
    """key, text; raises where a reference is not in the dictionary."""
    each = encoded.select(key, F.posexplode(F.split("encoded", separator)).alias("pos", "part")).withColumn("named", F.regexp_extract("part", r"^\[\[f:([0-9a-f]{16})\]\]$", 1))
    # Plain blocks name no fragment; they have keys of their own, so they don't meet in one task.
    each = each.withColumn("fragment_id", F.when(F.col("named") == "", _alone(key)).otherwise(F.col("named")))
    got = each.join(dictionary.select("fragment_id", "content"), "fragment_id", "left")
    plain = F.regexp_replace("part", r"^\\(\\*\[\[f:)", "$1")
    part = F.when(F.col("named") == "", plain).otherwise(F.coalesce("content", F.raise_error(F.concat(F.lit("no fragment "), "fragment_id"))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return got.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), separator).alias("text"))


def apply_edits(rows: DataFrame) -> DataFrame:
    """path, content, error after structured edits: rows of path, content and edits, an array of structs with kind
    (replace, insert_before, insert_after, delete), anchor and text; see ``edit``. With an error the content stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [edit(c or "", e or []) for c, e in zip(batch.column("content").to_pylist(), batch.column("edits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([t for t, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())], names=["path", "content", "error"])

    return rows.select("path", "content", "edits").mapInArrow(run, "path string, content string, error string")


# How a line begins that defines a symbol of each kind.
_DEFINES = {"function": r"(?:pub\s+)?(?:async\s+)?fn", "class": "class", "struct": r"(?:pub\s+)?struct", "enum": r"(?:pub\s+)?enum"}


def _anchored(lines: list[str], anchor: str) -> tuple[int, int] | str:
    """The lines (from, to) that an anchor names, or what is wrong with it."""
    if m := re.fullmatch(r"lines (\d+)-(\d+)", anchor):
        a, b = int(m[1]) - 1, int(m[2])
        return (a, b) if 0 <= a < b <= len(lines) else "lines out of range"
    if m := re.fullmatch(rf"symbol ({'|'.join(_DEFINES)}) (.+)", anchor):
        head = re.compile(rf"\s*{_DEFINES[m[1]]}\s+{re.escape(m[2])}\b")
        at = next((i for i, x in enumerate(lines) if head.match(x)), None)
        return "anchor not found" if at is None else (at, _block_end(lines, at))
    at = [i for i, x in enumerate(lines) if anchor in x]
    return (at[0], at[0] + 1) if len(at) == 1 else "anchor is not unique" if at else "anchor not found"


def _block_end(lines: list[str], at: int) -> int:
    """The line after the brace that closes what opens on line ``at`` or after it; without braces the next line."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
    return at + 1


def edit(text: str, edits: list[dict]) -> tuple[str, str | None]:
    """The text after edits of whole lines, and the first error. An anchor is a text that one line holds, ``lines a-b``
    (from 1), or ``symbol kind name`` for a definition with its block. All are looked up in the text as it comes, and
    the last lines are edited first, so no edit moves the place of another."""
    lines = text.split("\n")
    end = [lines.pop()] if lines[-1] == "" else []
    placed = []
    for e in edits:
        place = _anchored(lines, e["anchor"])
        if isinstance(place, str):
            return text, place
        placed.append((place, e))
    for (a, b), e in sorted(placed, key=lambda x: (-x[0][0], x[1]["kind"] == "insert_before")):
        new = (e["text"] or "").split("\n") if e["text"] else []
        lines[a:b] = {"replace": new, "insert_before": [*new, *lines[a:b]], "insert_after": [*lines[a:b], *new], "delete": []}[e["kind"]]
    return "\n".join([*lines, *end]), None
