"""Decontamination, near-duplicates and license scan against brute force over whole tables and edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from textloom.llm import decontam, licenses, neardup, queries

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One two three"), (5, "One two three"), (6, "été " * 3000),
    (7, "all rights reserved"), (None, "all rights reserved CC by. cc-BY"), (8, "x" * 200000), (9, "licensed under the apache license version 2 0 " * 2), (10, "one"),
]
ODD_SCHEMA = "doc_id bigint, text string"


def odd(spark):
    """Rows with nulls, empty, long and repeated texts, and columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], ODD_SCHEMA + ", items string, component bigint, n bigint")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(docs, items, size=10):
    out = []
    index = {}
    short = {}
    for name, text in items:
        w = words(text)
        if not w or name is None:
            continue
        for i in range(max(1, len(w) - size + 1)):
            (index if len(w) >= size else short).setdefault(tuple(w[i : i + size]), set()).add(str(name))
    lengths = sorted({len(k) for k in short} | {size})
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in lengths:
                k = tuple(w[i : i + n])
                names = (index if n == size else short).get(k) if len(k) == n else None
                if names:
                    found |= names
                    hit.update(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_decontamination_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(queries.op3_decontaminate(spark, sf)) == sorted(brute_hits(docs, items), key=str)


def test_decontamination_edge_cases(spark, monkeypatch):
    docs = [*ODD, (11, "a b c d e f g h i j k one two"), (12, "b c d e f g h i j k l"), (13, "a b c d e f g h i j"), (16, "a b c z d e f g h i j")]
    items = [("q1", "A b c d e f g h i j k"), ("q1", "A b c d e f g h i j k"), ("q2", "one two"), (None, "one"), ("q3", None), ("q4", "..."), ("q5", "b c x e f g h i j k")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, doc_id bigint")
    table = spark.createDataFrame(docs, ODD_SCHEMA)
    whole = rows(decontam.decontaminate(table, bench))
    want = sorted(brute_hits(docs, items), key=str)
    got = sorted(((r[0], r[1], r[2], len(r[3]), decontam.digest(r[3]), r[2] > 0) for r in whole), key=str)
    assert got == want
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 3)
    assert rows(decontam.decontaminate(table, bench)) == whole
    monkeypatch.setattr(decontam, "HELD", 1)
    assert rows(decontam.decontaminate(table, bench)) == whole
    near = {r.doc_id: r.near_items for r in decontam.decontaminate(table, bench, slop=1).collect()}
    assert near[11] == [] and near[16] == ["q1"]
    assert decontam.decontaminate(table.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(table, bench.limit(0)).collect()} == {0}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_groups(docs, percent=85):
    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets)


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_near_duplicates(spark, sf).collect())) == brute_groups(docs)


def test_near_duplicate_chains_and_edges(spark, monkeypatch):
    word = [f"w{i}" for i in range(400)]
    chain = [(100 - i, " ".join(word[6 * i : 6 * i + 100])) for i in range(40)]  # each linked with the next only
    ring = [(200 + i, " ".join([*word[:50], f"z{i}", *word[51:100]])) for i in range(12)]
    docs = [r for r in ODD if r[0] is not None and r[0] != 5] + [(14, "one two three"), (15, "ONE two  three")] + chain + ring
    for size in (neardup.BLOCK_MEMBERS, 3):
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", size)
        table = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], ODD_SCHEMA + ", items string, component bigint, n bigint").repartition(5)
        assert sorted(map(tuple, neardup.near_duplicates(table).collect())) == brute_groups(docs)
    got = {r.doc_id: r for r in neardup.near_duplicates(odd(spark)).collect()}
    assert got[1].n_shingles == 0 and got[1].kept and got[10].component_id == 4 and got[None].component_id is None
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_near_duplicates_of_a_large_group_whose_pairs_are_mostly_no_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 100)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(700):  # copies with a few words gone or changed alike, so that few shingles are any copy's own
        gone = set(draw.sample(range(1, 149), draw.choice((1, 2, 3, 3, 4))))
        docs.append((i, " ".join(f"x{j % 7}" if j in gone and j % 2 else w for j, w in enumerate(base) if j not in gone or j % 2)))
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(docs, ODD_SCHEMA).repartition(4)).collect()))
    assert got == brute_groups(docs)
    assert len({r[2] for r in got}) > 20


def test_near_duplicates_of_a_document_that_comes_with_two_texts(spark):
    one, two = ([f"{c}{i}" for i in range(100)] for c in "ab")
    docs = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, "x"])), (3, " ".join([*two, "y"])), (0, " ".join(["z", *two])), (9, "else")]
    got = neardup.near_duplicates(spark.createDataFrame(docs, ODD_SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 9)} and len(got) == 6


def test_common_elements_counted_by_either_way(monkeypatch):
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 60, n)) for n in draw.integers(0, 40, 30)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for few, columns in ((4, 4096), (0, 7), (30, 5)):
        monkeypatch.setattr(neardup, "FEW_OWNERS", few)
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        assert neardup.common(np.concatenate(sets), np.repeat(np.arange(30), [len(x) for x in sets]), 30).tolist() == want


def test_license_scan_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + ODD
    table = spark.createDataFrame(docs, ODD_SCHEMA)
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.template_labels), round(r.containment, 9)) for r in licenses.scan(table).collect()}
    window = 2 * max(len(set(words(t))) for _, t in licenses.TEMPLATES)
    want = set()
    for doc, text in docs:
        w = words(text)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels, best = set(), 0.0
        for b in range(0, max(len(w), 1), window // 2):
            block = set(w[b : b + window])
            for label, t in licenses.TEMPLATES:
                t = set(words(t))
                if len(block & t) >= licenses.THRESHOLD * len(t) - 1e-9:
                    labels.add(label)
                    best = max(best, len(block & t) / len(t))
        places = [i for i, _ in at]
        want.add((doc, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), round(best, 9)))
    assert got == want
    assert any(x[6] for x in got)
    assert licenses.scan(odd(spark)).count() == len(ODD)
    assert licenses.scan(table.limit(0)).count() == 0
    assert {tuple(r.template_labels) for r in licenses.scan(table, templates=[("none", "...")]).collect()} == {()}


def test_license_scan_finds_notices_at_every_place(spark):
    mit = ["other", "words", *words(licenses.TEMPLATES[2][1])[2:]]
    docs = [(i, " ".join([f"w{j}" for j in range(i)] + mit + [f"v{j}" for j in range(40)])) for i in range(90)]
    got = {r.doc_id: r.template_labels for r in licenses.scan(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    longest = max(len(words(t)) for _, t in licenses.TEMPLATES)
    for doc, text in docs:
        w = words(text)
        spots = [set(w[i : i + longest]) for i in range(len(w))]
        want = {label for label, t in licenses.TEMPLATES if any(len(b & set(words(t))) >= licenses.THRESHOLD * len(set(words(t))) - 1e-9 for b in spots)}
        assert want == {"mit"} and want <= set(got[doc]), doc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    cols = sorted(got.columns)
    assert sorted((tuple(cell(r[c]) for c in cols) for r in got.collect()), key=str) == sorted((tuple(map(cell, r)) for r in want.select(*cols).fetchall()), key=str)
