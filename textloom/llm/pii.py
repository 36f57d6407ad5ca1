"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal them.

Each value that the patterns find (an email, address, card or phone number) is a protected entity. Around its mentions
the corpus shows which terms stand near which entity. With N distinct contexts (equal ones, as in copies, count once),
n_e of them around entity e, n_t holding term t and n_et both:

    IC(e) = log2(N / n_e)        PMI(t, e) = log2(n_et * N / (n_e * n_t))

A term discloses e to the degree PMI / IC, which is 1 where every context of the term belongs to e. At
``generalise_at`` and more the term is replaced by its class, at ``remove_at`` and more it is removed, in whichever
document it occurs. An entity that all contexts share (IC 0) is left alone.

Contexts don't show how common a term is elsewhere. The same quotient is therefore taken over the distinct texts of the
whole corpus too, with D of them, d_e that mention e, d_t that hold t anywhere and d_et where t stands near e. All pairs
are judged, those of a single mention too; so that few texts prove less than many, the share of t's texts that are near
e is smoothed by ``PRIOR`` texts that show e as often as the corpus does:

    p(e | t) = (d_et + PRIOR d_e / D) / (d_t + PRIOR)        PMI(t, e) = log2(p(e | t) D / d_e)

A pair counts only if both quotients reach ``generalise_at`` and p(e | t) reaches ``LIKELY``. The last doesn't loosen as
the corpus grows: a term that stands in more texts away from an entity than near it doesn't reveal it.

The passes read each text whole. Shuffled are the texts, once, to find the distinct ones; the terms near mentions; and
counts of words, pre-aggregated a task. Counted are only terms that pass by contexts, first in one of ``PARTS`` parts of
the texts: where a term is found in more texts there than it can have in all and still be likely, it is dropped, and the
other parts count what is left. Which words to count goes out as a bitmap of bounded size. The list of disclosing
terms is broadcast while it holds at most ``BROADCAST_TERMS``; a longer one is joined with the words of all texts
instead.

Defined results: null text is empty; texts without findings come back as they are; repeated rows get a row each and
their contexts count once; only ``doc_id`` and ``text`` are read and other columns are kept by ``sanitise``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._shared import column, materialise, scratch, slices

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that the method adds.
TERM = "term"

#: Words on each side of a mention that make its context.
WINDOW = 8
#: Texts that smooth a share: half a one, as in the Jeffreys prior.
PRIOR = 0.5
GENERALISE_AT, REMOVE_AT = 0.9, 0.995
#: The least share of a term's texts that show the entity.
LIKELY = 0.5
BROADCAST_TERMS = 100_000
#: Bits of the bitmap of words that are counted: so many a term, and in all (8 MB).
BITS_A_TERM, MOST_BITS = 32, 1 << 26
#: Words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: One of so many parts of the texts is counted first.
PARTS = 16

# The base patterns. They are matched leftmost and non-overlapping, in forms that never go over a run of
# characters twice: possessive repeats, and for emails the part before the @ is walked back from it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of each finding in code points, by start, then kind."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """The same value in another spelling is the same entity."""
    return value.lower() if kind == 0 else f"{KINDS[kind]}:" + "".join(_DIGIT.findall(value)) if kind != 1 else f"ip:{value}"


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of a text that no span touches."""
    k = 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        # Spans are ordered by their starts: if this one, the first that ends later, doesn't touch the word, none does.
        if k == len(spans) or spans[k][0] >= m.end():
            yield m


def _contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[list[str]]:
    """For each span the ``WINDOW`` nearest words on each side that are outside all spans, lower-cased."""
    free = [m.span() for m in _outside(text, spans)] if spans else []
    starts = [a for a, _ in free]
    for start, _, end in spans:
        i, j = bisect.bisect_left(starts, start), bisect.bisect_left(starts, end)
        yield [text[a:b].lower() for a, b in free[max(i - WINDOW, 0) : i] + free[j : j + WINDOW]]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def contexts(documents: DataFrame) -> DataFrame:
    """entity, doc (digest of the text), context (digest of its words), terms: one row a mention."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in slices(batches, "text"):
            who, doc, digest, terms = [], [], [], []
            for text in col.to_pylist():
                spans = base_spans(text)
                whole = _digest(text) if spans else 0
                for (start, kind, end), near in zip(spans, _contexts(text, spans), strict=True):
                    near = sorted(set(near))
                    who.append(entity(kind, text[start:end]))
                    doc.append(whole)
                    digest.append(_digest("\0".join(near)))
                    terms.append(near)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(doc, pa.int64()), pa.array(digest, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["entity", "doc", "context", "terms"])

    return documents.select("text").mapInArrow(find, "entity string, doc bigint, context bigint, terms array<string>")


class _Filter:
    """Says of words whether they may be among given terms: two bits for each, in a bitmap of bounded size."""

    def __init__(self, terms: DataFrame) -> None:
        n = terms.count()
        size = min(1 << max(BITS_A_TERM * n - 1, 63).bit_length(), MOST_BITS)
        h = F.xxhash64("term")
        place = terms.select(F.explode(F.array(h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1))).alias("p"))
        words = place.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
        self.bits = np.zeros(size // 64, np.uint64)
        self.bits[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)

    def has(self, words: list[str]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode(errors="replace"), 42) for w in words), np.uint64, len(words))
        ok = np.ones(len(h), bool)
        for p in (h, h >> np.uint64(32)):
            p = p & np.uint64(64 * len(self.bits) - 1)
            ok &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def _words(text: str) -> set[str]:
    """The distinct words of a text, lower-cased as terms are."""
    return set(_WORD.findall(text.lower())) if text.isascii() else {w.lower() for w in set(_WORD.findall(text))}


def text_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, d_t: the distinct texts that hold each of ``terms`` (and some words more); for null, all distinct texts."""
    sent = documents.sparkSession.sparkContext.broadcast(_Filter(terms))

    def rows(held: Counter, texts: int) -> pa.RecordBatch:
        words = list(held)
        kept = [w for w, ok in zip(words, sent.value.has(words), strict=True) if ok]
        return pa.RecordBatch.from_arrays([pa.array([*kept, None], pa.string()), pa.array([*(held[w] for w in kept), texts], pa.int64())], names=["term", "d_t"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        texts = 0
        for _, col in slices(batches, "text"):
            texts += len(col)
            for text in col.to_pylist():
                held.update(_words(text))
                if len(held) > HELD_WORDS:
                    yield rows(held, texts)
                    held, texts = Counter(), 0
        yield rows(held, texts)

    distinct = documents.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    return distinct.mapInArrow(count, "term string, d_t bigint").groupBy("term").agg(F.sum("d_t").alias("d_t"))


def disclosing_terms(documents: DataFrame, at: float = GENERALISE_AT) -> DataFrame:
    """term, degree: the largest PMI / IC over the entities that a term reveals, where it reaches ``at`` both over
    contexts (the degree given) and over the texts of the corpus."""
    seen = materialise(contexts(documents).dropDuplicates(["entity", "doc", "context"]), "contexts")
    total = seen.dropDuplicates(["entity", "context"]).count()
    n_e = seen.groupBy("entity").agg(F.countDistinct("context").alias("n_e"), F.countDistinct("doc").alias("d_e"))
    each = seen.select("entity", "doc", "context", F.explode("terms").alias("term"))
    pairs = each.groupBy("entity", "term").agg(F.countDistinct("context").alias("n_et"), F.countDistinct("doc").alias("d_et"))
    pairs = materialise(pairs, "pairs")
    n_t = pairs.groupBy("term").agg(F.sum("n_et").alias("n_t"))
    all_contexts = F.lit(float(max(total, 1)))
    ic = F.log2(all_contexts / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * all_contexts / (F.col("n_e") * F.col("n_t")))
    near = pairs.join(n_e, "entity").join(n_t, "term").where(ic > 0).withColumn("degree", pmi / ic)
    near = materialise(near.where(F.col("degree") >= at).select("term", "d_et", "d_e", "degree"), "near")
    # First a part of the texts: most words that are common elsewhere show it there, and needn't be counted in the rest.
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(PARTS))
    wanted = materialise(near.groupBy("term").agg(F.max("d_et").alias("most")), "wanted")
    first = materialise(text_counts(documents.where(part == 0), wanted.select("term")), "counts")
    some = F.coalesce("d_t", F.lit(0))
    left = materialise(wanted.join(first, "term", "left").where(F.col("most") + PRIOR >= LIKELY * (some + PRIOR)).select("term", some.alias("d_1")), "left")
    rest = materialise(text_counts(documents.where(part != 0), left.select("term")), "counts")
    texts = sum(c.where("term is null").agg(F.sum("d_t")).first()[0] or 0 for c in (first, rest))
    counts = left.join(rest, "term", "left").select("term", (F.col("d_1") + some).alias("d_t"))
    all_texts = F.lit(float(max(texts, 1)))
    share = (F.col("d_et") + PRIOR * F.col("d_e") / all_texts) / (F.col("d_t") + PRIOR)
    wide = F.try_divide(F.log2(share * all_texts / F.col("d_e")), F.log2(all_texts / F.col("d_e")))
    return near.join(counts, "term").where((wide >= at) & (share >= LIKELY)).groupBy("term").agg(F.max("degree").alias("degree"))


def _used(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """_key, term: the words of each text, cut as terms are, that may be among ``terms``."""
    sent = keyed.sparkSession.sparkContext.broadcast(_Filter(terms))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            pairs = [(key, w) for key, text in zip(column(batch, "_key").to_pylist(), col.to_pylist(), strict=True) for w in _words(text)]
            kept = [x for x, ok in zip(pairs, sent.value.has([w for _, w in pairs]), strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([w for _, w in kept], pa.string())], names=["_key", "term"])

    return keyed.select("_key", "text").mapInArrow(cut, "_key string, term string")


def _term_spans(text: str, degree: dict[str, float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, degree) of disclosing terms outside the base spans."""
    if not degree or degree.keys().isdisjoint(_words(text)):
        return []
    return [(m.start(), m.end(), d) for m in _outside(text, base) if (d := degree.get(m[0].lower())) is not None]


def placeholder(word: str) -> str:
    """The class that a term is generalised to."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def clean_text(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, float]], remove_at: float = REMOVE_AT) -> str:
    """The text with base findings masked by kind, and terms generalised or removed."""
    cuts = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base] + [(s, e, "" if d >= remove_at else placeholder(text[s:e])) for s, e, d in terms]
    out, at = [], 0
    for s, e, by in sorted(cuts):
        if s < at:  # overlaps what is masked already: the rest of it goes too
            at = max(at, e)
            continue
        out += [text[at:s], by]
        at = e
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """All columns of ``documents`` in a struct ``row``, with spans (array of kind, start, end), base (array of the
    same for base findings) and clean (the sanitised text; null text stays null)."""
    with scratch(documents.sparkSession) as made:
        found = materialise(disclosing_terms(documents, generalise_at), "disclosing")
        made.pop()
    count = found.count()
    source = documents.select("doc_id", "text", F.struct("*").alias("row"))
    span = S.ArrayType(S.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    per_row = count > BROADCAST_TERMS
    sent = None
    if per_row:
        # A row number of its own for each row would need a shuffle; the digest of the text serves as key, as equal
        # texts have equal terms.
        source = source.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
        mine = _used(source, found).join(found, "term").groupBy("_key").agg(F.collect_set(F.struct("term", "degree")).alias("_terms"))
        source = source.join(mine, "_key", "left").drop("_key")
    else:
        sent = documents.sparkSession.sparkContext.broadcast({r["term"]: r["degree"] for r in found.collect()})

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            given = column(batch, "text")
            own = column(batch, "_terms").to_pylist() if per_row else None
            spans, bases, clean = [], [], []
            for i, text in enumerate(col.to_pylist()):
                degree = {x["term"]: x["degree"] for x in own[i] or []} if per_row else sent.value
                base = base_spans(text)
                terms = _term_spans(text, degree, base)
                both = sorted([(s, k, e) for s, k, e in base] + [(s, len(KINDS), e) for s, e, _ in terms])
                name = (*KINDS, TERM)
                spans.append([{"kind": name[k], "start": s, "end": e} for s, k, e in both])
                bases.append([{"kind": name[k], "start": s, "end": e} for s, k, e in base])
                clean.append(None if not given[i].is_valid else clean_text(text, base, terms, remove_at) if both else text)
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(spans, kinds), pa.array(bases, kinds), pa.array(clean, pa.string())], names=["row", "spans", "base", "clean"])

    fields = S.StructType().add("row", source.schema["row"].dataType).add("spans", span).add("base", span).add("clean", "string")
    return source.mapInArrow(mask, fields)
