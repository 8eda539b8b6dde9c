"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A block is a run of words, over line feeds too; a template is met where a run of at most SPREAD times its words holds,
in the template's order, at least THRESHOLD of its distinct words. So neither wrapping nor a few other words between
hide a notice, and words scattered over a paragraph don't make one. The join is exact: windows that overlap by half and
hold any such run whole are candidates; template words are ordered by how many documents of the whole corpus hold them,
rarest first; a window that reaches the needed overlap must hold one of the template's first (size - needed + 1) words
(prefix), have enough template words (length), and leave enough of both orders behind that word (position); what is
left is verified by the longest ascending run of places. The order comes from a first pass over all documents that
returns one count for each template word.

Base labels come from fixed phrases at every place their words stand consecutively.

Defined cases: null counts as empty. A document without words has zero counts, null places and empty labels. The
score is 1 with a base phrase, else the best share of a template that reaches the threshold, else 0. Repeated rows are
scanned each; ids are handed on as they are, null too. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_map

# fixed values: the contract's phrases and labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("reserved", "copyright all rights reserved"),
]
THRESHOLD = 0.8
SPREAD = 1.5

_SEPARATORS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)
_BASE = [(re.compile(rb"(?<= )%s(?= )" % p.encode()), label) for p, label in PHRASES.items()]


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, separators as spaces."""
    return (text or "").encode().translate(_SEPARATORS)


class Index:
    """Prefix index of the templates under a global order of their words."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD) -> None:
        self.rank = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t.encode().split()}, key=lambda w: (frequency.get(w, 0), w)))}
        #: label, place of each distinct word in the template, words that are needed, longest run.
        self.templates: list[tuple[str, dict[bytes, int], int, int]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            every = text.encode().split()
            places = {w: i for i, w in enumerate(dict.fromkeys(every))}
            words = sorted(places, key=self.rank.__getitem__)
            needed = math.ceil(threshold * len(words) - 1e-9)
            self.templates.append((label, places, needed, math.ceil(SPREAD * len(every))))
            for at, word in enumerate(words[: len(words) - needed + 1]):
                self.prefix[word].append((len(self.templates) - 1, at))
        self.vocabulary = frozenset(self.rank)
        self.first = frozenset(self.prefix)
        self.half = max((run for *_, run in self.templates), default=1)

    def candidates(self, window: set[bytes]) -> Iterator[int]:
        """Templates of which the window holds the needed words, in any order."""
        own = sorted(window & self.vocabulary, key=self.rank.__getitem__)
        seen = set()
        for j, word in enumerate(own):
            for t, i in self.prefix.get(word, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared word in the order: what follows bounds the overlap
                _, places, needed, _ = self.templates[t]
                if len(own) < needed or min(len(places) - i, len(own) - j) < needed:
                    continue
                if len(places.keys() & window) >= needed:
                    yield t

    def best(self, t: int, words: list[bytes]) -> int:
        """Most words of the template that a run of the words, no longer than allowed, holds in the template's order."""
        _, places, _, run = self.templates[t]
        found = [(i, places[w]) for i, w in enumerate(words) if w in places]
        most = 0
        for k, (start, _) in enumerate(found):
            tails: list[int] = []
            for i, place in found[k:]:
                if i >= start + run:
                    break
                at = bisect_left(tails, place)
                tails[at : at + 1] = [place]
            most = max(most, len(tails))
        return most

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """(label, share) of every template that a run of the words meets."""
        for lo in range(0, max(1, len(words) - self.half), self.half):
            window = words[lo : lo + 2 * self.half]
            distinct = set(window)
            if not self.first.isdisjoint(distinct):
                for t in self.candidates(distinct):
                    label, places, needed, _ = self.templates[t]
                    if (most := self.best(t, window)) >= needed:
                        yield label, most / len(places)


def scan(text: bytes, index: Index) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a normalised text."""
    words = text.split()
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for pattern, label in _BASE:
        found = [m.start() for m in pattern.finditer(joined)]
        if found:
            base.add(label)
            starts += found
    first = joined.count(b" ", 0, min(starts)) - 1 if starts else None
    last = joined.count(b" ", 0, max(starts)) - 1 if starts else None
    labels, score = set(base), 1.0 if base else 0.0
    if not index.first.isdisjoint(words):
        for label, share in index.matches(words):
            labels.add(label)
            score = max(score, share)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each word of the vocabulary, over all of docs; the result has the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(vocabulary.intersection(normalised(text.as_py()).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = text_map(docs.select(text_col), run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    chosen = TEMPLATES if templates is None else templates
    vocabulary = frozenset(w for _, t in chosen for w in t.encode().split())
    index = Index(chosen, word_frequencies(docs, vocabulary, text_col), threshold)
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for batch in batches:
            rows = [scan(normalised(t.as_py()), index) for t in batch.column(1)]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return text_map(docs.select(id_col, text_col), run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


