"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised whole by a given tokenizer file, get an end token, and only those longer than a sequence are
cut. Pieces are dealt by hash into shards of bounded size; each shard is packed best-fit decreasing, then searched:
pieces move between underfull sequences, or are exchanged one for one or two for one, whenever that raises the sum of
squared fills, so full sequences fill up and others empty. The sequences that a shard leaves underfull meet those of
other shards in up to ``LEVELS`` further levels, where they are packed again, so the loss doesn't grow with the number
of shards; what the last level leaves underfull stays as it is.

Tokenising splits texts at ASCII white space, and chunks of ASCII and Latin-1 letters further into the runs that the
tokenizer cuts them into; each distinct piece is given to the tokenizer once a worker and kept under its 64-bit hash.
All other chunks are given to it whole. That gives the ids of the whole text if the tokenizer lower-cases, its words
never span white space, and letters, single digits and signs are words apart; each worker tries this with ``PROBES``,
and gives texts whole to a tokenizer for which it doesn't hold.

Defined results: null and empty texts are documents of the end token alone; repeated rows are packed each; a row
without doc_id is packed too. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, materialise, raw, slices
from ._words import _P, _Q, _power, mix, ranges

SEQUENCE = 4096
END = 1
#: Pieces of a shard, about.
SHARD = 8192
#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
KEEP = 1 << 20
#: A sequence filled to this share is left as it is.
FULL = 0.999
#: Further levels of packing.
LEVELS = 6

_B = np.arange(256)
# Classes of bytes: 0 white space, 1 letters, 2 digits, 3 other ASCII signs, 4 whatever the tokenizer must see whole.
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[[0x27, 0x3C]] = 4  # ' starts contractions, < starts special tokens
_CODE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64)


#: Texts whose ids show whether a tokenizer works on pieces as described above.
PROBES = [
    "", " a", "Two words", "two  words ", "MiXed CASE", "12 4.5__8 (x)y[z]", "don't l'eau 'S", "a,b;c!? -- d", "\ttab\nline\r\nend", "ÀÉ×÷ß été", "x2y 3z", "a\x0bb\x0cc", "日本語 a日b", "ends with.",
]


class _Ids:
    """Token ids of distinct words, by hash."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()
        probes = pa.array(PROBES, pa.large_string())
        #: Whether ids of pieces are those of the whole.
        self.by_piece = all(np.array_equal(a, b) for a, b in zip(_piecewise(probes, self), whole_ids(probes, self), strict=True))

    def clear(self) -> None:
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Sorted hashes, where the ids of each begin, and how many there are: of most words, and of the latest ones.
        self.tables = [empty, empty]
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in got], np.int64)
        at = self.used + np.cumsum(n) - n
        new = np.array([i for x in got for i in x], np.uint32)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        self._add(1, (hashes, at, n))
        if len(self.tables[1][0]) > 1 << 15:
            self._add(0, self.tables[1])
            self.tables[1] = tuple(x[:0] for x in self.tables[1])

    def _add(self, k: int, rows: tuple) -> None:
        both = [np.concatenate(x) for x in zip(self.tables[k], rows, strict=True)]
        order = np.argsort(both[0])
        self.tables[k] = tuple(x[order] for x in both)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids begin, how many there are, and whether the word is known."""
        at, n, have = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for known, begin, count in self.tables:
            if len(known):
                i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[i] == hashes
                at[hit], n[hit] = begin[i[hit]], count[i[hit]]
                have |= hit
        return at, n, have


_loaded: dict[str, _Ids] = {}


def ids_of(path: str) -> _Ids:
    """The tokenizer of a file with the words it has seen, kept over the tasks of a worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = _Ids(path)
    return _loaded[path]


def token_ids(col: pa.Array, known: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end (uint32), and their bounds."""
    return (_piecewise if known.by_piece else whole_ids)(col, known)


def whole_ids(col: pa.Array, known: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """``token_ids`` of texts that the tokenizer gets whole."""
    got = [e.ids for e in known.tokenizer.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
    return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)


def _piecewise(col: pa.Array, known: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """``token_ids`` of texts whose pieces the tokenizer gets."""
    data, off = raw(col)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    kind = _KIND[data]
    # Letters of Latin-1 are two bytes, 0xC3 and a continuation; 0xC3 0x97 and 0xC3 0xB7 are signs.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    low = data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    low[upper] += 32
    cap = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)] + 1
    low[cap] += 32
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    # Chunks between white space; one with any byte of class 4 is a single unit.
    black = kind > 0
    start = black & np.concatenate([[True], ~black[:-1]]) | black & edge[:-1]
    chunk = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    whole = np.zeros(len(first), bool)
    whole[chunk[kind == 4]] = True
    cut = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]) & black
    unit = start | cut & ~whole[np.maximum(chunk, 0)]
    a = np.flatnonzero(unit)
    # A unit ends where the next begins, or at white space or the text's end before that.
    stop = np.flatnonzero(~black | edge[:-1])
    stop = np.append(stop, n)
    b = np.minimum(np.append(a[1:], n), stop[np.searchsorted(stop, a, "right")])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[low] * _power(_P, n), dtype=np.uint64)])
    h = mix((sums[b] - sums[a]) * _power(_Q, n)[a] ^ (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    if len(known) > KEEP:
        known.clear()
    begin, size, have = known.find(distinct)
    if not have.all():
        miss = at[~have]
        text = low.tobytes()
        known.learn(distinct[~have], [text[x:y].decode("utf-8", "replace") for x, y in zip(a[miss].tolist(), b[miss].tolist(), strict=True)])
        begin, size, _ = known.find(distinct)
    count = size[inverse]
    ids = known.ids[np.repeat(begin[inverse], count) + ranges(count)]
    total = np.concatenate([[0], np.cumsum(count)])
    return ids, total[np.searchsorted(a, off)]


def pieces(documents: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids_of(tokenizer)
        for batch, col in slices(batches, "text"):
            ids, bounds = token_ids(col, known)
            docs, rows = column(batch, "doc_id").to_pylist(), []
            for d, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(ids[x:y], np.uint32(END)).astype("<u4")
                for p, s in enumerate(range(0, len(own), size)):
                    part = own[s : s + size].tobytes()
                    rows.append((docs[d], p, s, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where the least room is left. Lists of piece numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect.bisect_left(room, (lengths[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
            left -= lengths[i]
        else:
            b, left = len(bins), size - lengths[i]
            bins.append([i])
        if left:
            bisect.insort(room, (left, b))
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int, rounds: int = 8, givers: int = 32) -> list[list[int]]:
    """Moves and exchanges of pieces between underfull sequences that raise the sum of squared fills.

    Each step moves tokens from a sequence into one that is at least as full, which raises the sum. Fullest sequences
    are filled first, each from the ``givers`` emptiest ones. The search ends when a pass over all has no step, or
    after ``rounds`` passes: a bound on its time, not on what is packed.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    for _ in range(rounds):
        changed = False
        order = sorted((k for k in range(len(bins)) if 0 < fill[k] < FULL * size), key=lambda k: (-fill[k], k))
        for pos, to in enumerate(order):
            while order and not fill[order[-1]]:
                order.pop()
            for giver in order[: max(pos, len(order) - givers - 1) : -1]:
                if fill[to] == size or not fill[to]:
                    break
                if not fill[giver] or fill[giver] > fill[to]:
                    continue
                step = _exchange(bins[to], bins[giver], lengths, size - fill[to])
                if step:
                    out, into = step
                    gain = sum(lengths[i] for i in into) - sum(lengths[i] for i in out)
                    bins[to] = [i for i in bins[to] if i not in out] + into
                    bins[giver] = [i for i in bins[giver] if i not in into] + out
                    fill[to] += gain
                    fill[giver] -= gain
                    changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _exchange(mine: list[int], theirs: list[int], lengths: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """What leaves and what comes: the move, one-for-one or two-for-one exchange that fills the room most."""
    own = sorted((lengths[i], i) for i in theirs)
    values = [v for v, _ in own]

    def largest(limit: int) -> tuple[int, list[int]]:
        """The largest sum within the limit of one or two of their pieces."""
        k = bisect.bisect_right(values, limit) - 1
        best, pick = (values[k], [own[k][1]]) if k >= 0 else (0, [])
        a, b = 0, len(values) - 1
        while a < b and best < limit:
            s = values[a] + values[b]
            if s > limit:
                b -= 1
            else:
                if s > best:
                    best, pick = s, [own[a][1], own[b][1]]
                a += 1
        return best, pick

    best, step = 0, None
    got, pick = largest(room)
    if got > best:
        best, step = got, ([], pick)
    for i in mine:
        if best == room:
            break
        got, pick = largest(room + lengths[i])
        if got - lengths[i] > best:
            best, step = got - lengths[i], ([i], pick)
    return step


def _pack_shards(table: DataFrame, shard: str, size: int) -> DataFrame:
    """Packs the pieces of each shard; adds bin (number within the shard), fill and offset."""
    fields = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in table.schema)}, bin bigint, fill bigint, offset bigint"

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in ("length", "doc_id", "piece", "ids_crc32")])
        lengths = group.column("length").to_pylist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        number, fill, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                number[i], offset[i] = k, at
                at += lengths[i]
            fill[b] = at
        for name, v in (("bin", number), ("fill", fill), ("offset", offset)):
            group = group.append_column(name, pa.array(v))
        return group

    return table.groupBy(shard).applyInArrow(pack, fields)


def pack(documents: DataFrame, tokenizer: str, size: int = SEQUENCE, shard_pieces: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = materialise(pieces(documents, tokenizer, size).withColumn("nth", F.monotonically_increasing_id()), "pieces")
    # A piece as long as a sequence is one.
    whole = cut.where(F.col("length") == size)
    out = whole.select(*kept, F.expr("shiftleft(1L, 62) + nth").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, level = cut.where(F.col("length") < size), 0
    count = rest.count()
    while count:
        shards = max(1, round(count / shard_pieces))
        packed = materialise(_pack_shards(rest.withColumn("shard", F.expr(f"pmod(xxhash64(nth, {level}), {shards})")), "shard", size), "packed")
        full = F.col("fill") >= FULL * size
        last = shards == 1 or level == LEVELS
        name = F.expr(f"shiftleft({level}L, 58) + shiftleft(shard, 20) + bin")
        out = out.union(packed.where(F.lit(True) if last else full).select(*kept, name.alias("sequence_id"), "offset"))
        if last:
            break
        before, rest, level = count, packed.where(~full).select(*cut.columns), level + 1
        count = rest.count()
        if count > before * 0.7:  # larger shards find more
            shard_pieces = min(shard_pieces * 2, 8 * SHARD)
    return out
