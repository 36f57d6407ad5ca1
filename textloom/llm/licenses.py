"""License scan: exact set-similarity join of document blocks with license templates, by containment.

Template words are ordered by how many documents of the corpus hold them, rarest first. A block can contain a share
``threshold`` of a template's word set only if it holds one of the template's first |T| - ceil(t |T|) + 1 words
(prefix filter), has at least ceil(t |T|) words (length filter), and has enough words left behind the first one that
matches (positional filter). Blocks that pass are verified on full sets. Blocks are windows of twice the largest
template's length at half overlap, so any passage as long as a template lies whole in one of them.

The template library is fixed text of this module (or a parameter of bounded size), so it goes out by broadcast.

Defined results: null text is empty; documents without words get zeros and nulls; repeated rows get a row each; a
template without words is left out, and a library without templates finds phrases only;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, slices
from ._words import words

#: Phrases whose words stand consecutively, and the label of each.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Short notices of public licenses, and the label of each.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

#: Templates of fewer words than this need all of them (ceil at the default threshold does it for nine or fewer).
THRESHOLD = 0.9


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text], pa.large_string())).hashes


def frequencies(documents: DataFrame, vocab: np.ndarray) -> dict[int, int]:
    """Documents that hold each word of ``vocab`` (sorted hashes; as many results as words, summed on the executors)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), np.int64)
        for _, col in slices(batches, "text"):
            w = words(col)
            i = np.minimum(np.searchsorted(vocab, w.hashes), len(vocab) - 1)
            hit = vocab[i] == w.hashes
            doc = np.repeat(np.arange(len(col)), np.diff(w.bounds))[hit]
            pairs = np.unique(doc * len(vocab) + i[hit])
            total += np.bincount(pairs % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab))), pa.array(total)], names=["word", "n"])

    sums = documents.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}
    return {int(h): found.get(i, 0) for i, h in enumerate(vocab)}


class _Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float, often: dict[int, int]) -> None:
        self.labels = [name for name, _ in templates]
        self.ordered = [sorted(set(_hashes(text).tolist()), key=lambda h: (often.get(h, 0), h)) for _, text in templates]
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.ordered]
        #: word -> (template, place in its order) for each word of each prefix
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (t, need) in enumerate(zip(self.ordered, self.need, strict=True)):
            for i, h in enumerate(t[: len(t) - need + 1]):
                self.prefix.setdefault(h, []).append((k, i))
        self.keys = np.array(sorted(self.prefix), np.uint64)
        self.sets = [set(t) for t in self.ordered]
        #: Twice the most words, repeated ones counted, of a template.
        self.window = 2 * max((len(_hashes(text)) for _, text in templates), default=1)


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrase places and contained templates of each document.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels and template_labels (sorted arrays),
    containment (the largest share of a template's words that a matching block has, else 0).
    """
    templates = [(label, t) for label, t in templates if len(_hashes(t))]
    vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t) for _, t in templates)]))
    lib = _Templates(templates, threshold, frequencies(documents, vocab) if len(vocab) else {})
    spoken = [(_hashes(p), label) for p, label in phrases.items()]
    step = lib.window // 2

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            w = words(col)
            h, n = w.hashes, np.diff(w.bounds)
            doc = np.repeat(np.arange(len(n)), n)
            base = np.zeros(len(n), np.int64)
            first, last = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1, np.int64)
            said: list[set[str]] = [set() for _ in n]
            for p, label in spoken:
                ok = np.ones(max(len(h) - len(p) + 1, 0), bool)
                for i, x in enumerate(p):
                    ok &= h[i : len(h) - len(p) + 1 + i] == x
                at = np.flatnonzero(ok)
                at = at[doc[at] == doc[at + len(p) - 1]]
                np.add.at(base, doc[at], 1)
                np.minimum.at(first, doc[at], at - w.bounds[doc[at]])
                np.maximum.at(last, doc[at], at - w.bounds[doc[at]])
                for d in set(doc[at].tolist()):
                    said[d].add(label)
            labels: list[set[str]] = [set() for _ in n]
            share = np.zeros(len(n))
            at = np.flatnonzero(lib.keys[np.minimum(np.searchsorted(lib.keys, h), len(lib.keys) - 1)] == h) if len(lib.keys) else np.zeros(0, np.int64)
            tried: set[tuple[int, int, int]] = set()
            sets: dict[tuple[int, int], set[int]] = {}
            for i in at.tolist():
                d = int(doc[i])
                rel, size = i - int(w.bounds[d]), int(n[d])
                for b in {max(0, rel // step - 1), rel // step}:
                    if (d, b) not in sets:
                        sets[d, b] = set(h[w.bounds[d] + b * step : w.bounds[d] + min(size, b * step + lib.window)].tolist())
                    block = sets[d, b]
                    for k, rank in lib.prefix[int(h[i])]:
                        if (d, b, k) in tried or len(block) < lib.need[k]:
                            continue
                        ahead = sum(x in block for x in lib.ordered[k][:rank])
                        if ahead + len(lib.ordered[k]) - rank < lib.need[k]:
                            continue
                        tried.add((d, b, k))
                        common = len(lib.sets[k] & block)
                        if common >= lib.need[k]:
                            labels[d].add(lib.labels[k])
                            share[d] = max(share[d], common / len(lib.sets[k]))
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array(n), pa.array(base), pa.array(first, mask=base == 0), pa.array(last, mask=base == 0), pa.array([sorted(x) for x in said], text), pa.array([sorted(x) for x in labels], text), pa.array(share)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "template_labels", "containment"],
            )

    return documents.select("doc_id", "text").mapInArrow(look, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, template_labels array<string>, containment double")
