"""Archives, personal data, toxicity, quality, fingerprints, packing and language: contracts and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import langid, packing, phrases, pii, quality, queries, toxicity, warc

from .test_words_operators import ODD, ODD_SCHEMA, odd

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


# Archives


def test_warc_round_trip_and_revisits(spark):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://b.example/x", big), (2, "http://a.example/x?b=2&a=1", big), (3, None, small), (4, "http://a.example", small), (5, "HTTP://www.a.example:80/X#f", None), (6, "bad url ]", ""), (7, "u", big + "\r\n\r\nWARC/1.0\r\n"), (2, "http://a.example/x?b=2&a=1", big), (None, "n", big), (8, "u", "q" * 5_000_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, offset int").repartition(4)
    index, folder = warc.archive(pages)
    order = [(r.urlkey, r.ts, r.page_id) for r in index.collect()]
    assert sorted(order, key=str) == sorted(((warc.url_key(u), p or 0, p) for p, u, _ in rows), key=str)
    got = sorted(map(tuple, warc.read_back(index, folder).drop("urlkey").collect()), key=str)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        copies = [q for q, _, x in rows if (x or "").encode() == data and q is not None]
        answer = max(copies) if len(data) >= 1000 and p != max(copies) else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if answer else "response", answer))
    assert got == sorted(want, key=str)
    assert warc.archive(pages.limit(0))[0].count() == 0


def test_merged_index_is_in_global_order(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").repartition(6)
    index, _ = warc.archive(pages)
    keys = [(r.urlkey, r.ts, r.page_id) for r in index.orderBy("urlkey", "ts", "page_id").collect()]
    parts = [[(r[1], r[2], r[3]) for r in p] for p in index.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts) and len(keys) == pages.count()


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted((x, i, k) for k, x in enumerate(r)) for i, r in enumerate(runs)]
    assert list(warc.loser_merge(runs)) == sorted(x for r in runs for x in r)


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a1 0.@+-()4b255é9_", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_on_known_values():
    text = "x a.b+c@d-e.co.uk, 4111 1111 1111 1111; +1 (017) 555-7713 and 10.0.0.255 1.2.3.256 a@b @c.d"
    assert [text[s:e] for s, _, e in pii.base_spans(text)] == ["a.b+c@d-e.co.uk", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.255"]
    assert pii.base_spans("1" * 300000) == [] and pii.base_spans("a" * 300000 + "@") == [] and pii.base_spans("+1" + " " * 300000) == []
    assert len(pii.base_spans("+1" + " " * 300 + "234567890123")) == 1


def test_disclosing_terms_are_found_and_masked(spark, monkeypatch):
    rows = [(i, f"the project falcon{'' if i % 2 else ' lead'} is run by a@corp.org in room {i}") for i in range(8)]
    rows += [(100 + i, f"the project is run by p{i}@corp.org in room {i}") for i in range(30)]
    rows += [(200, "Falcon flies"), (201, None), (202, ""), (200, "Falcon flies")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id bigint, text string, term int, degree string")
    terms = {r.term: r.degree for r in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"falcon", "lead"} and abs(terms["falcon"] - 1) < 1e-9
    for most in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        out = sorted(((r.row.doc_id, r.row.degree, r.clean, len(r.spans)) for r in pii.sanitise(docs).collect()), key=str)
        clean = {x[0]: x for x in out}
        assert len(out) == len(rows) and clean[200][2:] == (" flies", 1) and clean[201][2:] == (None, 0)
        assert clean[101][2] == "the project is run by [EMAIL] in room 1"
    assert pii.sanitise(docs.limit(0)).count() == 0
    assert pii.sanitise(odd(spark)).count() == len(ODD)


def test_terms_common_elsewhere_are_left_alone(spark):
    rows = [(i, f"to unsubscribe from falcon list {i} write to a@corp.org now") for i in range(4)]
    rows += [(50 + i, f"write to p{i}@corp.org now") for i in range(20)]
    rows += [(100 + i, f"how does one unsubscribe from page {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert "falcon" in terms and not {"unsubscribe", "from", "how"} & terms
    counts = {r.term: r.d_t for r in pii.text_counts(docs.union(docs), spark.createDataFrame([("unsubscribe",)], "term string")).collect()}
    assert counts[None] == len(rows) and counts["unsubscribe"] == 304


def test_terms_of_single_mentions_are_judged(spark):
    rows = [(i, f"write to p{i}@corp.org now") for i in range(20)] + [(50, "ask zebulon via z@corp.org now")]
    rows += [(100 + i, f"how to write page {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.term for r in pii.disclosing_terms(docs).collect()} == {"ask", "zebulon", "via"}
    # In one more text, without the entity, it is as likely as not that the word means something else.
    more = docs.union(spark.createDataFrame([(999, "zebulon writes page")], docs.schema))
    assert {r.term for r in pii.disclosing_terms(more).collect()} == {"ask", "via"}


def test_joined_terms_are_cut_as_sent_ones(spark, monkeypatch):
    odd_words = ["cafe\u0301s", "m\u00b2", "\u0939\u093f\u0928\u094d\u0926\u0940", "\u0130zmir"]
    rows = [(i, f"{' '.join(odd_words)} falcon {i} a@corp.org") for i in range(10)]
    rows += [(50 + i, f"write to p{i}@corp.org now") for i in range(100)] + [(999, " ".join(odd_words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = []
    for most in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        got.append(sorted((r.row.doc_id, r.clean, [tuple(s) for s in r.spans]) for r in pii.sanitise(docs).collect()))
    assert got[0] == got[1] and len(got[0][-1][2]) > 4


def test_contexts_take_the_nearest_words_outside_spans():
    text = "far " + "w" * 900 + " near a@b.c x1.2.3.4 10.0.0.1 after " + "v" * 700 + " end"
    spans = pii.base_spans(text)
    got = list(pii._contexts(text, spans))
    assert [text[s:e] for s, _, e in spans] == ["a@b.c", "1.2.3.4", "10.0.0.1"]
    assert got[0] == ["far", "w" * 900, "near", "after", "v" * 700, "end"] and got[1] == got[2] == got[0]


def test_pii_query(spark, sf):
    for r in queries.op2_pii(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        base = brute_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]


# Toxicity


def brute_segments(score):
    """All maximal segments by the definition: the best segment, then those left and right of it."""
    best = None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            s = sum(score[i:j])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(score[:i]) + [best] + [(a + j, b + j, x) for a, b, x in brute_segments(score[j:])]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([-3, -1, 2, 5]), max_size=14))
def test_maximal_segments_sum_up_like_the_definition(score):
    got = toxicity.maximal_segments([float(x) for x in score])
    assert sorted(x for *_, x in got) == sorted(float(x) for *_, x in brute_segments(score))
    assert all(abs(sum(score[a:b]) - x) < 1e-9 for a, b, x in got)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert all(r.held_out == (held(d, 3) == 1) and 0 <= r.score <= 1 for d, r in got.items())
    assert sum(p == y for p, y in out) / len(out) > 0.85


def test_toxicity_edges(spark):
    train = spark.createDataFrame([("you vile scum " + w, 1) for w in "abcdefghij"] + [(f"a calm day in {w} town", 0) for w in "abcdefghij"], "text string, label int")
    model = toxicity.fit(train)
    got = {(r.doc_id, r.segments[0].first if r.segments else None) for r in toxicity.score(spark.createDataFrame([(1, "calm calm town vile scum"), (2, None), (3, "")], ODD_SCHEMA), model).collect()}
    assert {d for d, _ in got} == {1, 2, 3}
    assert toxicity.score(odd(spark), model).count() == len(ODD)
    none = toxicity.fit(train.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(odd(spark), none).collect()} == {0.0}


# Quality


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert sum(p == y for p, y in out) / len(out) > 0.9


def test_network_equals_direct_convolution(spark):
    rng = np.random.default_rng(0)
    net = quality.Net(rng.normal(size=(256, quality.VECTOR)), rng.normal(size=(quality.WIDTH * quality.VECTOR, quality.FILTERS)), rng.normal(size=quality.FILTERS), rng.normal(size=quality.FILTERS), 0.3)
    texts = ["", "a", "ab ab ab cd ab", "x" * 256, "y z " * 200, "é" * 1000 + " end"]
    got, bounds = quality.chunk_logits(net, net.tables(), pa.array(texts, pa.large_string()))
    want = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        x = net.vectors[np.append(b, np.zeros(quality.WIDTH, np.uint8))]
        n = max(len(b), 1)
        r = np.stack([x[i : i + quality.WIDTH].reshape(-1) @ net.filters + net.lift for i in range(n)])
        half = quality.CHUNK // 2
        halves = -(-n // half)
        for c in range(max(halves - 1, 1)):
            want.append(np.maximum(r[c * half : c * half + quality.CHUNK].max(0), 0) @ net.out + net.bias)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)
    assert quality.score(odd(spark), net).count() == len(ODD)
    assert {r.score for r in quality.score(odd(spark), 0.5).collect()} == {0.5}


def test_quality_query_against_direct_computation(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit(docs, labels, "quality")
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    for r in docs.orderBy(F.length("text")).limit(30).collect():
        b = np.frombuffer((r.text or "").encode(), np.uint8)
        x = net.vectors[np.append(b, np.zeros(quality.WIDTH, np.uint8))]
        n, half = max(len(b), 1), quality.CHUNK // 2
        seen = np.stack([x[i : i + quality.WIDTH].reshape(-1) @ net.filters + net.lift for i in range(n)])
        logits = [np.maximum(seen[c * half : c * half + quality.CHUNK].max(0), 0) @ net.out + net.bias for c in range(max(-(-n // half) - 1, 1))]
        z = net.mix[0] * np.mean(logits) + net.mix[1] * min(logits) + net.mix[2]
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-z))) < 1e-3 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_training_chunks_cover_whole_texts():
    texts = ["", "ab", "x" * 512, "y" * 513, "z" * 1300]
    chunks, owner = quality.training_chunks(pa.array(texts, pa.large_string()))
    assert owner.tolist() == [0, 1, 2, 3, 3, 4, 4, 4, 4, 4] and [int((c > 0).sum()) for c in chunks] == [0, 2, 512, 512, 257, 512, 512, 512, 512, 276]
    assert quality._sample([5, 9, 3, 2], 8) == [0, 2] and quality._sample([9, 9], 8) == [0] and quality._sample([], 8) == []


# Fingerprints


def test_fingerprints_of_neighbours(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, sf).collect()}
    near, far = [], []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        near.append(got[d].near_edited)
        far.append(got[d].near_next)
    assert np.mean(near) > 0.45 and np.mean(far) < 0.1


def test_fingerprint_does_not_depend_on_company_or_offset(spark):
    texts = [t or "" for _, t in ODD] + ["a" * 500, "ab" * 300, "lorem ipsum dolor " * 40, "b" + "lorem ipsum dolor " * 40]
    together = phrases.sketches(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert (phrases.sketches(pa.array([t], pa.large_string()))[0] == together[i]).all()
    rng = np.random.default_rng(1)
    body = "".join(chr(97 + x) for x in rng.integers(0, 26, 4000))
    names = [set(np.concatenate([n for n, *_ in phrases.phrase_names(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[1:3]]).tolist()) for x in (body, "shift" + body)]
    assert len(names[0] & names[1]) / len(names[0]) > 0.95
    assert phrases.neighbours(odd(spark)).count() == len(ODD)
    assert phrases.neighbours(odd(spark).limit(1)).count() == 1 and phrases.neighbours(odd(spark).limit(0)).count() == 0


# Packing


def test_token_ids_equal_the_tokenizer():
    known = packing._Ids(TOKENIZER)
    odd_texts = ["", " ", "Don't l'eau 'S <|endoftext|> a<|startoftext|>b", "ÀÉ×÷ß été ÿ Ÿ", "a\x85b ẞ İ", "12 4.5__8 (x)y[z]", "日本語 a日b", "\x0b\x0ca\x00b", "🎉 ok", "x" * 3000, "a\tb\nc\r\nd", "é Å", "½ ² ﬁ ’"]
    ids, bounds = packing.token_ids(pa.array(odd_texts, pa.large_string()), known)
    for i, t in enumerate(odd_texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids, t


KNOWN = packing._Ids(TOKENIZER)


def test_tokenizers_that_need_whole_texts_get_them(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "two words": 1, "Two": 2, "words": 3}, "[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    other.save(str(tmp_path / "other.json"))
    known = packing._Ids(str(tmp_path / "other.json"))
    assert KNOWN.by_piece and not known.by_piece
    ids, bounds = packing.token_ids(pa.array(["two words", "", "Two|words"], pa.large_string()), known)
    assert ids.tolist() == [1, 2, 3] and bounds.tolist() == [0, 1, 1, 3]


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet=st.characters(max_codepoint=0x250), max_size=40))
def test_token_ids_of_any_text(text):
    ids, _ = packing.token_ids(pa.array([text], pa.large_string()), KNOWN)
    assert ids.tolist() == KNOWN.tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_keeps_all_pieces_and_never_gets_worse(lengths):
    start = [[i] for i in range(len(lengths))]
    best = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    for bins in (best, packing.local_search(start, lengths, 100)):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(best) <= len(packing.best_fit(lengths, 100))


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    return by


def test_packing_query_and_edges(spark, sf):
    rows = queries.op8_pack(spark, sf).collect()
    by = check_packing(rows, 4096)
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 4096) * 1.02 + 1
    known = packing._Ids(TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        ids = np.array([*known.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert r.length == min(4096, len(ids) - r.start)
    rows = packing.pack(odd(spark), TOKENIZER, 64, shard_pieces=8).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack(odd(spark).limit(0), TOKENIZER).count() == 0


# Language


def brute_phrases(x, y):
    """Longest-match phrases of x in y, by search."""
    count, i = 0, 0
    while i < len(x):
        n = 1
        while i + n < len(x) and x[i : i + n + 1] in y:
            n += 1
        count += 1
        i += n
    return count


@settings(deadline=None, max_examples=25)
@given(st.text(alphabet="abc ", min_size=1, max_size=30), st.text(alphabet="abcd ", min_size=1, max_size=40))
def test_cross_parsing_counts_phrases(known, text):
    known = "a" + known
    m = langid.Languages({"x": known})
    sym = lambda t: bytes(m.read([t])[0].tolist())
    n = len(sym(text))
    got = m.entropies([text])[0, 0] * n / m.bits[0]
    assert round(got, 6) == brute_phrases(sym(text), sym(known))


@pytest.mark.parametrize("block", [1, 3, 16])
def test_cross_parsing_over_block_ends(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    draw = random.Random(block)
    for known in ("ab" * 40, "abcabdabe" * 5, "".join(draw.choice("abc ") for _ in range(200))):
        m = langid.Languages({"x": known, "y": known[::-1] + "e"})
        texts = ["", "a", "ab" * 60, "ba" * 33 + "c", *("".join(draw.choice("abcde ") for _ in range(draw.randrange(150))) for _ in range(12))]
        sym = lambda t: bytes(m.read([t])[0].tolist())
        got = m.entropies(texts)
        for i, t in enumerate(texts):
            for j, name in enumerate(m.names):
                want = brute_phrases(sym(t), sym({"x": known, "y": known[::-1] + "e"}[name]))
                assert round(got[i, j] * max(len(sym(t)), 1) / m.bits[j], 6) == want, (t, name)


def test_language_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = langid.training_text(docs, F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    m = langid.Languages(texts)
    sym = lambda t: bytes(m.read([t])[0].tolist())
    known = {k: sym(v) for k, v in texts.items()}
    got = {r.doc_id: r for r in queries.op9_language(spark, sf).collect()}
    for r in docs.orderBy(F.length("text")).limit(25).collect():
        x = sym(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        e = {k: brute_phrases(x, y) * np.log2(max(len(y), 2)) / len(x) for k, y in known.items()}
        low, following = sorted(e.values())[:2]
        assert got[r.doc_id].lang_pred == min(e, key=lambda k: (e[k], k)) and abs(got[r.doc_id].score - following / (low + following)) < 1e-9


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = [got[r.doc_id].lang_pred == r.lang for r in docs if held(r.doc_id, 4) == 2]
    assert sum(out) / len(out) > 0.97 and all(got[r.doc_id].held_out == (held(r.doc_id, 4) == 2) for r in docs)


def test_language_edges(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 456"), (4, "the cat"), (5, "日本語"), (None, "the"), (4, "the cat")], ODD_SCHEMA)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(table, {"en": "the cat sat on the mat", "fr": "le chat est sur le tapis"}).collect()]
    assert dict(got)[1] == dict(got)[2] == dict(got)[3] == "und" and dict(got)[4] == "en" and len(got) == 7
    assert {r.lang_pred for r in langid.identify(table, {}).collect()} == {"und"}
    assert langid.identify(table.limit(0), {"en": "a"}).count() == 0


def test_training_takes_more_than_heads(spark):
    head = "same heading " * 40
    docs = spark.createDataFrame([(1, head + "quixotic tail", "en"), (1, head + "quixotic tail", "en"), (2, head + "vierte zeile", "de")], "doc_id bigint, text string, lang string")
    got = langid.training_text(docs, F.lit(True))
    assert "quixotic tail" in got["en"] and "vierte zeile" in got["de"]
    long = spark.createDataFrame([(1, "x" * 31_000, "en"), (2, "y" * 31_000, "en"), (3, "z" * 500, "en"), (4, "w" * 99_000, "de")], "doc_id bigint, text string, lang string")
    got = langid.training_text(long, F.lit(True))
    assert sorted(map(len, got["en"].split())) == [500, 31_000] and got["de"] == "w" * langid.TRAIN_CHARS
    for sizes in ([10**6] * 128, [5, 10**6, 7], [0, 3], [], [40_000]):
        cut = langid.pieces(sizes)
        total = sum(b - a for a, b in cut) + max(len(sizes) - 1, 0)
        assert all(0 <= a <= b <= n for (a, b), n in zip(cut, sizes, strict=True)) and total <= langid.TRAIN_CHARS
        assert total == sum(sizes) + max(len(sizes) - 1, 0) or total > langid.TRAIN_CHARS - len(sizes)
    assert len({a for a, _ in langid.pieces([10**6] * 128)}) == 128
