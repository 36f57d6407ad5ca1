"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash draws, for each element, one random permutation of the m signature slots; in round j the element offers
j + r (0 <= r < 1) to the slot that its permutation has at place j. Because an offer of round j can't beat one of an
earlier round, a document is done after the first round in which all its slots hold offers of rounds so far: large
sets need one round, small ones a few. Slots of one element are correlated, which lowers the estimate's variance.

Documents with equal shingle sets are one class, and only one set of each goes on. Signatures of 32 bands of 4 slots
put two sets of similarity 0.85 in no common bucket with probability (1 - 0.85^4)^32 = 6e-11. Shingles that only one
candidate has bound what it can share with any other, which rules out most pairs by numbers alone.

No pairs of members are listed. First each bucket compares its members with one leader, verified links are merged, and
only buckets whose members are still in different components go on; with other leaders, while that finds links and a
bucket is larger than a block. What is left is compared whole: the members of a bucket are dealt into blocks, each two
blocks meet in one task, which counts the common shingles of all their pairs and gives out only the edges that connect
components, at most one a member. So each link that shares a bucket is found, and rows are linear in the members but for
buckets of many blocks, whose members go to each pair of blocks.

Defined results: null text and text without words: no shingles, linked with nothing, kept. Rows that repeat a doc_id
are one node, whatever their texts. A row without doc_id is never a representative. Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Steps, column, slices, width
from ._words import SPACED, mix, ranges, shingles, words

BANDS, ROWS = 32, 4
#: Members of a bucket, and shingles of theirs, that make a block; larger buckets are compared block by block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 400_000
#: Sets holding an element up to which it is counted pair by pair, and elements of one matrix product.
FEW_OWNERS, COLUMNS = 4, 4096


def superminhash(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m, uint64: round in the high half, r in the low) of sets of 64-bit hashes."""
    docs = len(bounds) - 1
    sig = np.full((docs, m), np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    flat = sig.reshape(-1)
    perm = np.zeros((0, m), np.uint8 if m <= 256 else np.uint16)
    for j in range(m):
        if not len(h):
            break
        draw = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            each = np.arange(len(h))
            slot = perm[each, pick].astype(np.int64)
            perm[each, pick] = perm[each, j]
        np.minimum.at(flat, doc * m + slot, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_docs = sig.max(1) >= np.uint64(j + 1) << np.uint64(32)
        live = open_docs[doc]
        if j == 0:
            h, doc, pick = h[live], doc[live], pick[live]
            perm = np.tile(np.arange(m, dtype=perm.dtype), (len(h), 1))
            perm[np.arange(len(h)), pick] = 0
        elif not live.all():
            h, doc, perm = h[live], doc[live], perm[live]
    return sig


def signatures(documents: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the shingle set; null if empty), buckets (one key a band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            h, bounds = shingles(words(col, SPACED), k)
            n = np.diff(bounds)
            sig = superminhash(h, bounds, bands * rows)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(n), 1))
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
            some = n > 0
            digests = [_digest(h[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            off = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(key[some].view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(n), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "buckets"])

    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, buckets array<bigint>")


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def shingle_sets(documents: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, set_key (null if empty) and the sorted hashes of its distinct shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            h, bounds = shingles(words(col, SPACED), k)
            keys = [_digest(h[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "set_key", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, set_key binary, shingles array<bigint>")


def common(x: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """members x members: how many elements each two sets share. ``x`` are the elements of all sets, which ``owner``
    numbers. Elements that few sets have add to their pairs one by one, the others by matrix products."""
    shared = np.zeros((members, members), np.int64)
    order = np.argsort(x, kind="stable")
    x, owner = x[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    held = np.diff(np.concatenate([first, [len(x)]]))
    for size in range(2, FEW_OWNERS + 1):
        who = owner[first[held == size][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                np.add.at(shared, (who[:, i], who[:, j]), 1)
    first, held = first[held > FEW_OWNERS], held[held > FEW_OWNERS]
    for at in range(0, len(first), COLUMNS):
        n = held[at : at + COLUMNS]
        has = np.zeros((members, len(n)), np.float32)
        has[owner[np.repeat(first[at : at + COLUMNS], n) + ranges(n)], np.repeat(np.arange(len(n)), n)] = 1
        both = has @ has.T
        shared += np.triu(both, 1).astype(np.int64)
    return shared + shared.T


def spanning(x: np.ndarray, sizes: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ``component`` numbers that the links among these sets (elements ``x`` end to end) connect, at most
    one a set. Sets of the same ``side`` aren't compared, but for side -1, where all are."""
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    i = common(x, owner, m)
    linked = (100 * i >= percent * (sizes[:, None] + sizes[None, :] - i)) & ((side[:, None] != side[None, :]) | (side[:, None] < 0))
    names, comp = np.unique(component, return_inverse=True)
    label = np.arange(len(names))
    while True:
        mine = label[comp]
        near = np.minimum(np.where(linked, mine[None, :], len(names)).min(1, initial=len(names)), mine)
        low = label.copy()
        np.minimum.at(low, comp, near)
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components that the links within each group (bucket, lo, hi) of ``rows`` connect. The rows
    of a group follow each other in one partition; of a pair of blocks, members of ``lo`` are compared with ``hi``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch | None:
            got = pa.Table.from_batches(held).combine_chunks()
            lists = got["shingles"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            mine, lo, hi = (got[c].to_numpy() for c in ("block", "lo", "hi"))
            a, b = spanning(lists.flatten().to_numpy(), sizes, got["component"].to_numpy(), np.where(lo == hi, -1, mine), percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if len(a) else None

        for batch in batches:
            key = np.stack([column(batch, c).to_numpy() for c in ("bucket", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if (this := tuple(key[:, a])) != now:
                        if held and (found := close()):
                            yield found
                        now, held = this, []
                    held.append(batch.slice(a, b - a))
        if held and (found := close()):
            yield found

    return rows.mapInArrow(look, "a bigint, b bigint")


def _forest(edges: DataFrame) -> DataFrame:
    """Union-find over the edges of each partition: every node with the smallest one it reaches there."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        for at in range(0, len(nodes), 65536):
            part = nodes[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(merge, "a bigint, b bigint")


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """Connected components of undirected edges (a, b): node, component (its smallest node), for nodes that have edges.

    Partitions contract their own edges first; then each node points at the smallest neighbour it sees, and its
    neighbours follow it there, until nothing changes. A round shuffles pairs of ids only.
    """
    edges = steps.write(_forest(edges.where("a <> b")).where("a <> b"), "forest")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        # Each neighbour b of a node learns the smallest neighbour of that node.
        heard = both.join(low, "a").select(F.col("b").alias("node"), "low").union(low.select("a", "low"))
        to = steps.write(heard.groupBy("node").agg(F.min("low").alias("low")), "labels")
        moved = edges.join(to.toDF("a", "la"), "a").join(to.toDF("b", "lb"), "b")
        rest = moved.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).where("a <> b")
        follow = to.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        after = steps.write(rest.union(follow).distinct(), "forest")
        # Done when every edge leads from a node to a root: nothing that is pointed at points elsewhere.
        if rest_is_empty(after):
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b").distinct())
        edges = after


def rest_is_empty(edges: DataFrame) -> bool:
    """Whether each node has one edge at most, and to a node that has none itself."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return twice.union(chained).isEmpty()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents connected by links of 100 * intersection >= ``percent`` * union of k-word shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (whether it is that document).
    """
    steps = Steps(documents.sparkSession)
    signed = steps.write(signatures(documents, k, bands, rows), "signatures")
    worded = signed.where("set_key is not null and doc_id is not null")
    # Numbers of classes only tell them apart; nothing depends on which is which.
    classes = worded.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = steps.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    spread = classes.select("cid", "n", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = steps.write(spread.join(shared, "bucket"), "members")
    named = steps.write(members.select("cid").distinct().join(classes, "cid").select("cid", "set_key", "rep"), "named")
    cut = shingle_sets(documents.join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), k)
    sets = steps.write(cut.join(named, "set_key").dropDuplicates(["set_key"]).select("cid", "shingles"), "sets")
    # Shingles that no other candidate has can't be common: a pair shares at most the lesser rest of the two.
    lone = sets.select("cid", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c = 1")
    lone = lone.groupBy("cid").agg(F.count("*").alias("u"))
    placed = members.join(lone, "cid", "left").select("bucket", "cid", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"), F.col("cid").alias("component"))
    placed = steps.write(placed.where(f"100 * s >= {percent} * n"), "placed")

    # A doc_id that comes with several texts is one node: its classes belong together.
    repeated = worded.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("x"), F.max(F.xxhash64("set_key")).alias("y")).where("x <> y").select("doc_id")
    repeated = worded.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes, "set_key").select("doc_id", "cid")
    edges = repeated.join(repeated.groupBy("doc_id").agg(F.min("cid").alias("b")), "doc_id").select(F.col("cid").alias("a"), "b").where("a <> b")
    edges = steps.write(edges, "edges")
    linked = None if edges.isEmpty() else steps.write(components(edges, steps), "components")

    turn = 0
    while True:
        if linked is not None:
            placed = placed.drop("component").join(linked.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid")).select("bucket", "cid", "n", "s", "component")
        count = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("x"), F.sum(F.xxhash64("cid", F.lit(1)).cast("decimal(20,0)")).alias("y"))
        open_ = count.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).where("c > 1")
        # Buckets of the same members need one look.
        open_ = open_.groupBy("m", "n", "x", "y").agg(F.min("bucket").alias("bucket"))
        parts = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("n") / BLOCK_SHINGLES)).cast("int")
        open_ = steps.write(open_.select("bucket", parts.alias("parts")), "open")
        most = open_.agg(F.max("parts")).first()[0]
        if most is None:
            break
        placed = steps.write(placed.drop("parts").join(open_, "bucket"), "placed")
        last = turn > 0 and (most == 1 or not helped)
        if last:
            # Each block meets each block of its bucket in one task.
            block = F.pmod(F.xxhash64("cid", "bucket"), F.col("parts")).cast("int")
            dealt = placed.select("bucket", "cid", "component", "parts", block.alias("block"))
            dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            dealt = dealt.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "component")
            dealt = dealt.join(sets, "cid").select("bucket", "lo", "hi", "block", "component", "shingles")
            found = _verified(dealt.repartition(width(dealt.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), percent)
        else:
            # First the member with the least of its own: near copies of one text are likest to it. Then any other.
            rank = F.col("s") / F.col("n") * -1 if not turn else F.xxhash64("cid", F.lit(turn)).cast("double")
            lead = placed.groupBy("bucket").agg(F.min(F.struct(rank.alias("o"), "cid", "n", "s", "component")).alias("x")).select("bucket", F.col("x.cid").alias("b"), F.col("x.n").alias("nb"), F.col("x.s").alias("sb"), F.col("x.component").alias("cb"))
            fits = f"100 * least(s, sb) >= {percent} * (n + nb - least(s, sb))"
            ask = placed.join(lead, "bucket").where(f"component <> cb and {fits}")
            ask = ask.select(F.col("cid").alias("a"), "b", F.col("component").alias("ca"), "cb").distinct()
            seen = ask.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
            both = F.size(F.array_intersect("xa", "xb"))
            seen = seen.select("ca", "cb", both.alias("i"), (F.size("xa") + F.size("xb") - both).alias("u"))
            found = seen.where(f"100 * i >= {percent} * u").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = steps.write(found, "links")
        helped = not found.isEmpty()
        if helped:
            # Components so far are edges to their smallest members.
            edges = found if linked is None else found.union(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b"))
            linked = steps.write(components(edges, steps), "components")
        if last:
            break
        turn += 1
    grouped = classes.select("set_key", "cid", "rep")
    if linked is not None:
        grouped = grouped.join(linked.toDF("cid", "component"), "cid", "left").select("set_key", F.coalesce("component", "cid").alias("component"), "rep")
        low = grouped.groupBy("component").agg(F.min("rep").alias("low"))
        grouped = grouped.join(low, "component").select("set_key", "low")
    else:
        grouped = grouped.select("set_key", F.col("rep").alias("low"))
    grouped = steps.write(grouped, "grouped")
    steps.clear(signed, grouped)
    worded = signed.where("set_key is not null").join(grouped, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    wordless = signed.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.union(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
