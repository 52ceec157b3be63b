"""Operator 1: license scan by an exact set-similarity join of text blocks with templates.

Templates are small sets of words. The document frequencies of their words, counted over all documents,
give one global order, rare words first. A block can only reach containment t of a template of m words if
one of the template's m - ceil(t m) + 1 rarest words is in it (prefix filter), if it has at least
ceil(t m) words of the template at all (length filter), and if the words that come after the one found, in
the global order, together with those found before, are enough (positional filter); what is left is verified
on the text.

Blocks are windows of consecutive words, wherever lines end: for phrases of as many words as the phrase has,
which must be its words in order; for notices of as many as the notice has over the threshold, rounded
down, of which ``threshold`` of the notice's distinct words must be in the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import FOLDED_VALUE, PLAIN, Words, arrow_batches, table, text_slices

#: Phrases whose words stand consecutively, and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices: a block that holds most of a notice's words has its label. Fixed values, the public notices' own words.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the mit license": "mit-notice",
    "released under the mit license": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "licensed under the gnu lesser general public license version": "lgpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "all rights reserved": "reserved-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license": "apache-full",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
    "or the use or other dealings in the software": "mit-full",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution": "bsd-full",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
    "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu general public license for more details": "gpl-full",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-full",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-notice",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
    "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-notice",
    "distributed under the boost software license version 1 0": "boost-notice",
}
THRESHOLD = 0.9
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, with A-Z in lower case."""
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """One phrase (``ordered``) or notice, its distinct words rare first, how many a block must hold, and words of a block."""

    label: str
    words: tuple[bytes, ...]
    ordered: bool
    rare: tuple[bytes, ...] = field(default=())
    needed: int = 0
    reach: int = 0

    def prepared(self, frequency: dict[bytes, int], threshold: float) -> Template:
        rare = tuple(sorted(set(self.words), key=lambda w: (frequency.get(w, 0), w)))
        share = 1.0 if self.ordered else threshold
        return Template(self.label, self.words, self.ordered, rare, max(1, ceil(share * len(rare) - 1e-9)), int(len(self.words) / max(share, 0.01) + 1e-9))

    @property
    def prefix(self) -> int:
        """So many of the rarest words: any block that qualifies holds one of them."""
        return len(self.rare) - self.needed + 1


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[Template]:
    return [Template(label, tuple(words_of(text.encode())), ordered) for source, ordered in ((phrases, True), (notices, False)) for text, label in source.items()]


class Vocabulary:
    """Words of templates by number, found by their hashes."""

    def __init__(self, words: set[bytes]):
        self.words = sorted(words)
        text = b" ".join(self.words)
        hashes = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PLAIN, FOLDED_VALUE).hash
        order = np.argsort(hashes)
        self._hashes, self._number = hashes[order], order
        self.of = {w: k for k, w in enumerate(self.words)}

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 of a word that no template has."""
        if not len(self._hashes):
            return np.full(len(words.hash), -1)
        at = np.minimum(np.searchsorted(self._hashes, words.hash), len(self._hashes) - 1)
        return np.where(self._hashes[at] == words.hash, self._number[at], -1)


def word_frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands, over all documents."""
    size = len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(0)):
                words = Words(data, offsets, PLAIN, FOLDED_VALUE)
                number, text = vocabulary.numbers(words), np.repeat(np.arange(j - i), np.diff(words.first))
                total += np.bincount(np.unique(text[number >= 0] * size + number[number >= 0]) % size, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["word", "n"])

    if not size:
        return {}
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary.words[r.word]: r.n for r in rows}


@dataclass(frozen=True)
class Found:
    """A template in a text: its number, the first word and the one after the last, and the containment."""

    template: Template
    text: int
    first: int
    end: int
    share: float


class Index:
    """Finds templates in runs of texts, all words of a run at a time."""

    def __init__(self, prepared: list[Template], vocabulary: Vocabulary):
        self._templates, self._vocabulary = prepared, vocabulary

    def scan(self, data: np.ndarray, words: Words) -> list[Found]:
        number = self._vocabulary.numbers(words)
        at = np.flatnonzero(number >= 0)
        text = np.searchsorted(words.first, at, "right") - 1
        found, raw = [], data.tobytes() if len(at) else b""
        for t in self._templates if len(at) else ():
            rank = np.full(len(self._vocabulary.words), -1)
            rank[[self._vocabulary.of[w] for w in t.rare]] = np.arange(len(t.rare))
            own = rank[number[at]]
            mine = own >= 0
            if (own[mine] < t.prefix).any():
                found += self._phrases(t, number, at[mine], own[mine], text[mine], words.first) if t.ordered else self._notices(t, at[mine], own[mine], text[mine])
        return [f for f in found if self._verified(f, raw, words)]

    def _phrases(self, t: Template, number: np.ndarray, at: np.ndarray, rank: np.ndarray, text: np.ndarray, first: np.ndarray) -> list[Found]:
        """Windows in which the rarest word stands where the phrase has it, and all words then in order."""
        place, size = t.words.index(t.rare[0]), len(t.words)
        lead = rank == 0
        begin, text = at[lead] - place, text[lead]
        fits = (begin >= first[text]) & (begin + size <= first[text + 1])
        begin, text = begin[fits], text[fits]
        for k, w in enumerate(t.words):
            same = number[begin + k] == self._vocabulary.of[w]
            begin, text = begin[same], text[same]
        return [Found(t, n, a, a + size, 1.0) for a, n in zip(begin.tolist(), text.tolist(), strict=True)]

    @staticmethod
    def _notices(t: Template, at: np.ndarray, rank: np.ndarray, text: np.ndarray) -> list[Found]:
        """The best window of each run of overlapping windows that hold enough words."""
        m, reach = len(t.rare), t.reach
        place = at + text * reach  # so far apart that no window holds words of two texts
        prefix = place[rank < t.prefix]
        after = np.minimum(np.searchsorted(prefix, place), len(prefix) - 1)
        near = (np.abs(prefix[after] - place) < reach) | (np.abs(prefix[np.maximum(after - 1, 0)] - place) < reach)
        place, rank, text = place[near], rank[near], text[near]
        tile = place // reach
        tiles, count = np.unique(np.unique(tile * m + rank) // m, return_counts=True)
        both = count + np.concatenate([np.where(np.diff(tiles) == 1, count[1:], 0), [0]])  # a window lies in its first word's tile and the next
        enough = both[np.searchsorted(tiles, tile)] >= t.needed
        begin, text = place[enough], text[enough]
        common, last = np.zeros(len(begin), np.int64), begin.copy()
        for k in range(m):  # rare words first
            where = place[rank == k]
            nearest = np.append(where, np.iinfo(np.int64).max)[np.searchsorted(where, begin)]
            has = nearest < begin + reach
            common, last = common + has, np.where(has, np.maximum(last, nearest), last)
            alive = common + (m - 1 - k) >= t.needed
            begin, text, common, last = begin[alive], text[alive], common[alive], last[alive]
        if not len(begin):
            return []
        run = np.cumsum(np.concatenate([[False], np.diff(begin) >= reach]))
        order = np.lexsort((begin, last - begin, -common, run))
        best = order[np.concatenate([[True], np.diff(run[order]) != 0])]
        return [Found(t, n, a - n * reach, b - n * reach + 1, c / m) for n, a, b, c in zip(*(x[best].tolist() for x in (text, begin, last, common)), strict=True)]

    @staticmethod
    def _verified(f: Found, raw: bytes, words: Words) -> bool:
        """Whether the words that stand there are those that the hashes told."""
        there = words_of(raw[words.starts[f.first] : words.ends[f.end - 1]])
        return tuple(there) == f.template.words if f.template.ordered else len(set(there).intersection(f.template.rare)) >= f.template.needed


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find every license phrase and notice in whole texts; one row for each row of ``docs``.

    Returns the id, n_words, n_base (places of phrases), first_word and last_word (the smallest and largest
    word where one starts, else null), base_labels and labels (distinct, sorted, comma-joined; the latter
    with those of notices), score (the largest containment found, 0 if none, 1 for a phrase) and notices,
    an array of (label, containment, block's first and end byte). A null text counts as empty; empty texts
    and tables have no places; other columns are ignored; repeated rows give repeated results. No shuffle
    but that of the templates' word counts.
    """
    arrow_batches(docs.sparkSession)
    plain = templates(phrases, notices)
    vocabulary = Vocabulary({w for t in plain for w in t.words})
    frequency = word_frequencies(docs, vocabulary, text_col)
    index = Index([t.prepared(frequency, threshold) for t in plain if t.words], vocabulary)
    kind = pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def row(found: list[Found], words: Words, first: int, offset: int) -> tuple:
        places, blocks = [f.first - first for f in found if f.template.ordered], [f for f in found if not f.template.ordered]
        base = {f.template.label for f in found if f.template.ordered}
        spans = [{"label": f.template.label, "containment": f.share, "start": int(words.starts[f.first] - offset), "end": int(words.ends[f.end - 1] - offset)} for f in blocks]
        score = 1.0 if places else max((f.share for f in blocks), default=0.0)
        return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f.template.label for f in blocks})), score, sorted(spans, key=lambda x: (x["start"], x["label"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, PLAIN, FOLDED_VALUE)
                found: dict[int, list[Found]] = {}
                for f in index.scan(data, words):
                    found.setdefault(f.text, []).append(f)
                rows = [row(found[k], words, int(words.first[k]), int(offsets[k])) if k in found else (0, None, None, "", "", 0.0, []) for k in range(j - i)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(words.first)), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, containment: double, start: long, end: long>>").withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("notices")
