"""Language of texts by cross-parsing: suffix automata of labelled text per language.

Text is read as letters (lower case; rarer ones share a symbol) and single gaps. A language's automaton knows every
substring of its training text; parsing with it takes the longest known phrase again and again. With c phrases for n
symbols and N symbols of training text, c log2(N) / n estimates the cross entropy, and the lowest one wins. Parsing
runs over whole texts. Blocks of ``BLOCK`` symbols are parsed side by side as if each began a phrase; then the parse of
the block before is carried over into each until the two agree, which they mostly do after a few symbols, and as they
go on alike from there, the phrases are those of one parse from the text's beginning.

Training text is bounded: at most ``TRAIN_DOCS`` documents a language, chosen by hash, and ``TRAIN_CHARS`` characters
in all. Texts go in whole, in the order of their hashes, without those that don't fit in any more; only where no text
of a language fits, pieces of one are taken. Prediction reads everything.

Defined results: null text and text without letters: ``und`` with score 0; no training text at all: ``und``. Ties go
to the language that sorts first. Repeated rows get a row each. Only ``doc_id``, ``text`` and (in training) ``lang``
are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import column, slices

TRAIN_DOCS, TRAIN_CHARS = 128, 32_000
#: Letters that get symbols of their own; gaps and rarer letters have one each besides.
LETTERS = 120
BLOCK = 1024
#: Text bytes parsed side by side: each step of a block is one pass over all of them.
SIDE_BY_SIDE = 2 << 20


def pieces(sizes: list[int], most: int = TRAIN_CHARS) -> list[tuple[int, int]]:
    """(start, end) of what is taken of texts of these sizes, joined by one space: ``most`` characters at most. Texts
    under a common length are taken whole."""
    left, each = most - max(len(sizes) - 1, 0), 0
    for i, size in enumerate(sorted(sizes)):
        each = max(left, 0) // (len(sizes) - i)
        if size > each:
            break
        left, each = left - size, size
    out = []
    for i, size in enumerate(sizes):
        take = min(size, each)
        start = (size - take) * i // max(len(sizes) - 1, 1)
        out.append((start, start + take))
    return out


def _taken(rows: list) -> list[tuple]:
    """(row, start, end) of the texts of a language that training reads."""
    left, out = TRAIN_CHARS, []
    for r in rows:
        # A space stands between texts.
        if len(out) < TRAIN_DOCS and r["size"] + bool(out) <= left:
            out.append((r, 0, r["size"]))
            left -= r["size"] + (len(out) > 1)
    return out or [(rows[0], *pieces([rows[0]["size"]])[0])]


def training_text(documents: DataFrame, allowed: Column) -> dict[str, str]:
    """Text of each language from rows that ``allowed`` admits."""
    known = documents.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # Of each language the rows with the lowest hashes, about twice as many as are used.
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * TRAIN_DOCS / n)))), F.col("lang"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    rows = known.withColumn("rank", rank).where(F.col("rank") < share).select("lang", "rank", "doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("hash"))
    chosen: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["rank"], r["doc_id"], r["size"], r["hash"])):
        chosen.setdefault(r["lang"], []).append(r)
    # Sizes first, so that only the texts that are taken come to the driver.
    cuts = [(lang, r["doc_id"], r["hash"], i, a, b) for lang, x in chosen.items() for i, (r, a, b) in enumerate(_taken(x))]
    table = documents.sparkSession.createDataFrame(cuts, "lang string, doc_id long, hash long, i long, a int, b int")
    taken = known.withColumn("hash", F.xxhash64("text")).join(F.broadcast(table), ["lang", "doc_id", "hash"]).select("lang", "i", F.expr("substring(text, a + 1, b - a)").alias("piece"))
    found: dict[str, dict[int, str]] = {}
    for r in taken.distinct().collect():
        found.setdefault(r["lang"], {})[r["i"]] = r["piece"]
    return {lang: " ".join(x[i] for i in sorted(x)) for lang, x in found.items()}


class Languages:
    """Automata of all languages over one alphabet. States are rows of a dense transition table, 0 is the root."""

    def __init__(self, texts: dict[str, str]) -> None:
        letters = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        chosen = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.width = len(chosen) + 2
        self.symbol = np.zeros(0x110000, np.uint8)
        number = {c: i + 2 for i, c in enumerate(chosen)}
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.symbol[cp] = number.get(c.lower()[:1], 1)
        self.names = sorted(texts)
        self.tables, self.bits = [], []
        for name in self.names:
            x, _ = self.read([texts[name]])
            self.tables.append(self._automaton(x.tolist()))
            self.bits.append(float(np.log2(max(len(x), 2))))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts end to end, runs of gaps as one, and the texts' bounds."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(n)])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[code]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        keep[off[:-1][n > 0]] = True
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[off]

    def _automaton(self, x: list[int]) -> np.ndarray:
        """Suffix automaton by the online construction; each new symbol adds one state and at most one clone."""
        step: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in x:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        table = np.zeros((len(step), self.width), np.int32)
        for i, row in enumerate(step):
            for c, to in row.items():
                table[i, c] = to
        return table.reshape(-1)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross entropy (bits a symbol) of each text by each language."""
        x, bounds = self.read(texts)
        n = np.diff(bounds)
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = bounds[:-1][doc] + nth * BLOCK
        size = np.minimum(bounds[1:][doc] - first, BLOCK)
        order = np.argsort(-size, kind="stable")
        # Which lane holds the block before each lane's and the one after it (-1: none).
        lane = np.empty(len(doc), np.int64)
        lane[order] = np.arange(len(doc))
        before = np.where(nth > 0, np.roll(lane, 1), -1)[order]
        after = np.where(nth + 1 < blocks[doc], np.roll(lane, -1), -1)[order]
        doc, first, size = doc[order], first[order], size[order]
        phrases = np.zeros((len(texts), len(self.names)))
        if len(doc):
            steps = np.arange(int(size[0]))
            lanes = np.searchsorted(-size, -steps, "left")  # blocks longer than each step
            at = [x[first[:k] + t].astype(np.int32) for t, k in zip(steps.tolist(), lanes.tolist(), strict=True)]
            for i, table in enumerate(self.tables):
                phrases[:, i] = np.bincount(doc, self._phrases(table, at, size, before, after), len(texts))
        return phrases * np.array(self.bits) / np.maximum(n, 1)[:, None]

    def _phrases(self, table: np.ndarray, at: list[np.ndarray], size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block. ``at`` has the symbols of all blocks that are long enough, by step."""
        root = table[: self.width]

        def step(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The states after a symbol, and where a phrase begins: where the last can't go on, and at the root."""
            to = table[state * self.width + c]
            miss = to == 0
            return np.where(miss, root[c], to), miss | (state == 0)

        carried = np.flatnonzero(before >= 0)
        state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
        states, begins = [], []
        for c in at:
            k = len(c)
            state[:k], begin = step(state[:k], c)
            count[:k] += begin
            if len(carried):
                states.append(state[:k].copy())
                begins.append(begin)
        end, more = state.copy(), np.zeros(len(size), np.int64)
        while len(carried):
            live, now, gain, ends = np.arange(len(carried)), end[before[carried]], np.zeros(len(carried), np.int64), state[carried]
            t = 0
            while len(live):
                own = carried[live]
                over = size[own] <= t  # never the same state: the block ends in another one
                ends[live[over]] = now[over]
                live, now, own = live[~over], now[~over], own[~over]
                if not len(live):
                    break
                now, begin = step(now, at[t][own])
                gain[live] += begin.astype(np.int64) - begins[t][own]
                apart = now != states[t][own]
                live, now, t = live[apart], now[apart], t + 1
            more[carried] = gain
            changed = carried[ends != end[carried]]
            end[carried] = ends
            carried = after[changed][after[changed] >= 0]
        return count + more


_built: dict[str, Languages] = {}


def _languages(texts: dict[str, str]) -> Languages:
    """Built once in each worker."""
    key = hashlib.sha256(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Languages(texts)
    return _built[key]


def identify(documents: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score (0.5 to 1: the runner-up's share of the two lowest entropies; 1 with one language)."""
    sent = documents.sparkSession.sparkContext.broadcast(texts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _languages(sent.value)
        for batch, col in slices(batches, "text", SIDE_BY_SIDE):
            rows = col.to_pylist()
            names, score = ["und"] * len(rows), np.zeros(len(rows))
            if m.names:
                e = m.entropies(rows)
                x, bounds = m.read(rows)
                letters = np.concatenate([[0], np.cumsum(x > 0)])
                some = letters[bounds[1:]] > letters[bounds[:-1]]
                best = e.argmin(1)
                for d in np.flatnonzero(some).tolist():
                    names[d] = m.names[best[d]]
                    two = np.partition(e[d], 1)[:2] if len(m.names) > 1 else np.array([0.0, 1.0])
                    score[d] = two[1] / max(two.sum(), 1e-12)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(look, "doc_id bigint, lang_pred string, score double")
