"""License scans by an exact set-similarity join with license templates.

Words are runs of letters, digits and non-ASCII characters with A-Z
lower-cased. Blocks are windows of BLOCK words, every half block, so each run
of up to half a block lies whole in one. A block meets a template when it holds
at least the share ``threshold`` of the template's distinct words. The join is
exact and filtered: template words are ordered by their frequency over all
documents, rarest first; a block can only qualify if it holds a word of the
template's prefix (|T| - need + 1 words), if it has at least ``need`` words of
the templates' vocabulary, and if behind the first match enough words of either
order are left. Then the overlap is counted in full.

Beside the join's labels, plain phrases give base labels.

Defined cases: null text is empty and has no words, no label and score 0;
blocks never cross documents; repeated rows and ids are scanned one by one; an
empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import table

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that public licenses ask to be shown.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Shared under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
BLOCK = 64
THRESHOLD = 0.85

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of all phrase places and the phrases' labels."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at, seen, word = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)      # blanks before a place number its first word
            seen = at
            places.append(word)
            labels.add(label)
            at = line.find(wanted, at + 1)
    return places, labels


class TemplateIndex:
    """Templates with words numbered by global frequency, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(words_of(text))) for label, text in templates]
        vocabulary = sorted(set().union(*[s for _, s in sets]), key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.templates = []
        for label, s in sets:
            order = sorted(self.number[w] for w in s)
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            self.templates.append((label, order, frozenset(order), need))
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (_, order, _, need) in enumerate(self.templates):
            for p, w in enumerate(order[:len(order) - need + 1]):
                self.prefixes.setdefault(w, []).append((t, p))

    def matches(self, block: list[int]) -> Iterator[tuple[str, float]]:
        """Templates met by a block (its vocabulary words, distinct, in order)."""
        tried = set()
        held = set(block)
        for q, w in enumerate(block):
            for t, p in self.prefixes.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)        # the first match is the rarest common word
                label, order, members, need = self.templates[t]
                if len(block) < need or 1 + min(len(order) - p - 1, len(block) - q - 1) < need:
                    continue
                common = len(members & held)
                if common >= need:
                    yield label, common / len(order)

    def scan(self, words: list[bytes], block: int = BLOCK) -> tuple[set[str], float]:
        numbers = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        at = np.flatnonzero(numbers >= 0)
        labels, best = set(), 0.0
        if not any(int(w) in self.prefixes for w in set(numbers[at].tolist())):
            return labels, best
        half = block // 2
        for b in sorted({int(x) for x in at // half} | {int(x) - 1 for x in at // half if x > 0}):
            i, j = np.searchsorted(at, (b * half, b * half + block))
            for label, score in self.matches(sorted(set(numbers[at[i:j]].tolist()))):
                labels.add(label)
                best = max(best, score)
        return labels, best


def _count_vocabulary(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = dict.fromkeys(vocabulary, 0)
            for text in batch.column(0):
                for w in vocabulary.intersection(words_of(text.as_py())):
                    n[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())],
                                             names=["word", "n"])

    return run


def vocabulary_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Documents holding each template word, over all documents (as many rows
    as the templates have words)."""
    vocabulary = frozenset().union(*[words_of(t) for _, t in templates])
    rows = (docs.select("text").mapInArrow(_count_vocabulary(vocabulary), "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    return {bytes(r["word"]): r["n"] for r in rows}


def _scan_batches(index: TemplateIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, base = base_places(words)
                found, score = index.scan(words)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base)), ",".join(sorted(base | found)), score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()),
                        strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    templates = templates or TEMPLATES
    index = TemplateIndex(templates, vocabulary_frequency(docs, templates), threshold)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan_batches(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                              "base_labels string, labels string, score double")


def op9_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
