"""Benchmark decontamination by a stored, distributed positional inverted index.

The corpus is indexed in segments of whole documents: each row of the index table holds, for every word of its
documents, the ascending list of positions. Positions count words over the segment, with one unused position
between documents so that no phrase crosses from one into the next. A search looks up the words of a test window,
takes the list of the rarest as candidates, shifts it by the word's place in the window and intersects it with the
shifted lists of the other words, rarest first. With ``slop`` > 0 each word may stand that many positions off its
place, which gives proximity matches.

Index segments are searched where they lie: nothing is shuffled. The test set goes out in blocks of bounded size, and
``HELD`` blocks at a time: a larger set takes further passes over the index, each of which adds to what the ones before
have found. In a segment only windows are looked at whose rarest word, as the test set goes, is there.

Defined results: null text has no words; an item without words or with a null id is skipped; repeated items count
once; repeated documents get a row each; empty tables give empty results or zero hits. Only ``doc_id`` and ``text``
(``item_id`` and ``text``) are read, whatever else the tables hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, materialise, slices
from ._words import ranges, words

#: Words of test items that one broadcast block holds at most.
BLOCK_WORDS = 500_000
#: Blocks that a pass sends out.
HELD = 8
#: Candidate places that are intersected at a time.
_CANDIDATES = 1 << 20

_INDEX = "doc_ids array<bigint>, doc_words array<bigint>, terms binary, counts binary, positions binary"
#: What passes have found: a bit for each position that is hit, and items of each document.
_FOUND = "marks binary, items array<array<string>>, near array<array<string>>"
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, near_items array<string>"


def build_index(documents: DataFrame) -> DataFrame:
    """One row a segment: document ids, their word counts, sorted word hashes, list lengths, position gaps."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch, col in slices(batches, "text"):
            w = words(col)
            n = np.diff(w.bounds)
            at = ranges(n) + np.repeat(w.bounds[:-1] + np.arange(len(n)), n)
            order = np.argsort(w.hashes, kind="stable")
            h, at = w.hashes[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            gaps = np.diff(at, prepend=0).astype(np.int32)
            gaps[first] = at[first]
            row = [
                [column(batch, "doc_id").to_pylist()],
                [n.tolist()],
                [pack.compress(h[first].tobytes())],
                [pack.compress(np.diff(first, append=len(h)).astype(np.int32).tobytes())],
                [pack.compress(gaps.tobytes())],
            ]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["doc_ids", "doc_words", "terms", "counts", "positions"])

    return documents.select("doc_id", "text").mapInArrow(segments, _INDEX)


class _Block:
    """Test windows of some items, over a sorted vocabulary of their words."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int) -> None:
        self.vocab = np.unique(np.concatenate([w for _, w in items]))
        rows, self.item = [], []
        for name, w in items:
            t = np.searchsorted(self.vocab, w).astype(np.int32)
            if len(t) < size:
                win = np.full((1, size), -1, np.int32)
                win[0, : len(t)] = t
            else:
                win = np.unique(np.lib.stride_tricks.sliding_window_view(t, size), axis=0)
            rows.append(win)
            self.item += [name] * len(win)
        self.windows = np.concatenate(rows)
        self.length = (self.windows >= 0).sum(1)
        # Windows by the word of theirs that the fewest windows have.
        often = np.bincount(self.windows[self.windows >= 0], minlength=len(self.vocab))
        rarest = np.where(self.windows >= 0, often[self.windows], np.iinfo(np.int64).max).argmin(1)
        word = self.windows[np.arange(len(rarest)), rarest]
        self.by_word = np.argsort(word, kind="stable")
        self.first = np.searchsorted(word[self.by_word], np.arange(len(self.vocab) + 1))


def _blocks(benchmark: DataFrame, size: int) -> Iterator[_Block]:
    items: list[tuple[str, np.ndarray]] = []
    seen: set[str] = set()
    total = 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    for r in rows.toLocalIterator():
        w = words(pa.array([r.text], pa.large_string())).hashes
        if not len(w):
            continue
        seen.add(r.item_id)
        items.append((r.item_id, w))
        total += len(w)
        if total >= BLOCK_WORDS:
            yield _Block(items, size)
            items, total = [], 0
    if items:
        yield _Block(items, size)


def _find(block: _Block, terms: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and the places where they begin."""
    i = np.minimum(np.searchsorted(terms, block.vocab), max(len(terms) - 1, 0))
    here = (terms[i] == block.vocab) if len(terms) else np.zeros(len(block.vocab), bool)
    have = np.where(here, counts[i] if len(terms) else 0, 0).astype(np.int64)
    begin = np.where(here, starts[i] if len(terms) else 0, 0).astype(np.int64)
    there = np.flatnonzero(here)
    each = block.first[there + 1] - block.first[there]
    alive = np.sort(block.by_word[np.repeat(block.first[there], each) + ranges(each)])
    windows = block.windows[alive]
    real = windows >= 0
    n = np.where(real, have[windows], np.iinfo(np.int64).max)
    some = n.min(1, initial=np.iinfo(np.int64).max) > 0
    alive, windows, real, n = alive[some], windows[some], real[some], n[some]
    if not len(alive):
        return alive, alive
    used = np.unique(windows[real])
    span = int(at.max()) + 4 * windows.shape[1] + 4 * slop + 2
    # The lists of all words that live windows use, as one ascending array of (word, place).
    flat = np.repeat(begin[used], have[used]) + ranges(have[used])
    keys = np.repeat(used.astype(np.int64), have[used]) * span + at[flat]
    order = np.argsort(n, axis=1, kind="stable")
    rarest = np.take_along_axis(n, order[:, :1], 1)[:, 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(rarest) // _CANDIDATES)) + 1, [len(alive)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = np.repeat(np.arange(a, b), rarest[a:b])
        word = windows[k, order[k, 0]]
        place = at[begin[word] + ranges(rarest[a:b])] - order[k, 0]
        k, place = k[place >= 0], place[place >= 0]
        for step in range(1, windows.shape[1]):
            word = windows[k, order[k, step]]
            live = word >= 0
            low = word.astype(np.int64) * span + np.maximum(place + order[k, step] - slop, 0)
            j = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            ok = ~live | ((keys[j] >= low) & (keys[j] <= word.astype(np.int64) * span + place + order[k, step] + slop))
            k, place = k[ok], place[ok]
            if not len(k):
                break
        found.append((alive[k], place))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def search(index: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """For each indexed document: word count, words that exact windows hit, and the items found.

    Returns doc_id, n_words, n_hit, items (sorted array of strings), near_items (items found only with ``slop``).
    """
    sc = index.sparkSession.sparkContext
    names = [x.split()[0] for x in _INDEX.split(", ")]
    held: list = []
    for block in _blocks(benchmark, size):
        if len(held) == HELD:
            index = materialise(_pass(index, names, held, size, slop, False), "hits")
            names = [x.split()[0] for x in f"{_INDEX}, {_FOUND}".split(", ")]
            for b in held:
                b.destroy()
            held = []
        held.append(sc.broadcast(block))
    return _pass(index, names, held, size, slop, True)


def _pass(index: DataFrame, names: list[str], blocks: list, size: int, slop: int, last: bool) -> DataFrame:
    """Searches index rows for the windows of ``blocks``: the rows with what is found so far, or the ``last`` results."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {k: column(batch, k)[row].as_py() for k in names}
                n = np.array(r["doc_words"], np.int64)
                first = np.concatenate([[0], np.cumsum(n + 1)])
                terms = np.frombuffer(unpack.decompress(r["terms"]), np.uint64)
                counts = np.frombuffer(unpack.decompress(r["counts"]), np.int32).astype(np.int64)
                gaps = np.frombuffer(unpack.decompress(r["positions"]), np.int32).astype(np.int64)
                starts = np.cumsum(counts) - counts
                total = np.concatenate([[0], np.cumsum(gaps)])
                at = total[1:] - np.repeat(total[starts], counts)
                places = int(first[-1])
                mark = np.zeros(places + size + 1, np.int64)
                hits = [set(x) for x in r["items"]] if "items" in r else [set() for _ in n]
                near = [set(x) for x in r["near"]] if "near" in r else [set() for _ in n]
                for b in blocks:
                    win, place = _find(b.value, terms, starts, counts, at, 0)
                    np.add.at(mark, place, 1)
                    np.add.at(mark, place + b.value.length[win], -1)
                    for into, (w, p) in ((hits, (win, place)),) + (((near, _find(b.value, terms, starts, counts, at, slop)),) if slop else ()):
                        doc = np.searchsorted(first, p, "right") - 1
                        # Offsets may reach over the end of a text; its first and last word must both lie in it.
                        same = p + b.value.length[w] <= first[doc] + n[doc] + slop
                        for d, x in set(zip(doc[same].tolist(), w[same].tolist(), strict=True)):
                            into[d].add(b.value.item[x])
                hit = np.cumsum(mark)[:places] > 0
                if "marks" in r:
                    hit |= np.unpackbits(np.frombuffer(unpack.decompress(r["marks"]), np.uint8), count=places).astype(bool)
                if not last:
                    found = [[pack.compress(np.packbits(hit).tobytes())], [[sorted(x) for x in hits]], [[sorted(x) for x in near]]]
                    kinds = [pa.binary(), *[pa.list_(pa.list_(pa.string()))] * 2]
                    yield pa.RecordBatch.from_arrays([*(column(batch, k).slice(row, 1) for k in names[:5]), *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], names=[x.split()[0] for x in f"{_INDEX}, {_FOUND}".split(", ")])
                    continue
                sums = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(n), pa.array(sums[first[1:] - 1] - sums[first[:-1]]), pa.array([sorted(x) for x in hits], pa.list_(pa.string())), pa.array([sorted(x - y) for x, y in zip(near, hits, strict=True)], pa.list_(pa.string()))],
                    names=[x.split()[0] for x in _RESULT.split(", ")],
                )

    return index.mapInArrow(look, _RESULT if last else f"{_INDEX}, {_FOUND}")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Index ``documents`` in shared storage, then search it for the windows of ``benchmark``."""
    return search(materialise(build_index(documents), "postings"), benchmark, size, slop)


def digest(items: list[str]) -> str:
    """The contract's digest of item ids."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
