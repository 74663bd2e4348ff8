"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

The templates' words are put in one global order, rarest first, by the number of documents of the whole corpus that have
them. A block that contains at least ``need`` of a template's words must have one of its first |T| - need + 1 words (prefix
filter), so only windows around those words are looked at. Phrases are templates of the block "whole
document" with containment 1; an exact look at the places where their words stand consecutively follows.

Blocks are all windows of ``span`` times the template's number of words, over the whole text: line ends are nothing but
separators. A template's words that name its license (``NAMES``) have to be in the block, whatever else may be missing.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import Counter, deque
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import hidden

#: Phrases and their labels. Fixed values.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: License statements and their labels. Fixed values.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)

#: Words that tell a license from others: a block of a template that has one has it too. Fixed values.
NAMES = frozenset(("apache", "mit", "nc", "sa", "attribution", "mozilla"))

#: A-Z become a-z; a-z, 0-9 and all bytes of non-ASCII characters stay; every other ASCII character separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


class Templates:
    """The templates as word sets in the global order, and the index of their prefixes."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]], threshold: float, seen: Mapping[str, int], span: int) -> None:
        def rank(w: bytes) -> tuple[int, bytes]:
            return seen.get(w.decode(), 0), w

        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.rarest = [min(p, key=rank) for p, _ in self.phrases]
        self.sets = [(label, sorted(set(words_of(t.encode())), key=rank)) for label, t in templates]
        self.need = [math.ceil(threshold * len(t)) for _, t in self.sets]
        self.at = [frozenset(t) for _, t in self.sets]
        self.names = [[w for w in t if w.decode() in NAMES] for _, t in self.sets]
        self.width = [span * len(words_of(t.encode())) for _, t in templates]
        self.prefix: dict[bytes, list[int]] = {}
        for k, (_, t) in enumerate(self.sets):
            for w in t[: len(t) - self.need[k] + 1]:
                self.prefix.setdefault(w, []).append(k)
        self.watched = frozenset(self.prefix) | frozenset(self.rarest)
        self.vocabulary = frozenset(w for _, t in self.sets for w in t)

    def places(self, words: list[bytes], met: set[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of every place where a phrase's words stand consecutively."""
        found = []
        for (phrase, label), rare in zip(self.phrases, self.rarest, strict=True):
            if rare in met:
                shift, n = phrase.index(rare), len(phrase)
                found += [(i - shift, i - shift + n - 1, label) for i, w in enumerate(words) if w == rare and i >= shift and words[i - shift : i - shift + n] == phrase]
        return found

    def blocks(self, words: list[bytes], met: set[bytes]) -> list[tuple[int, int, str, float]]:
        """(first, last, label, containment) of the blocks that contain enough of a template; of overlapping ones with a label the best."""
        if not met & self.prefix.keys():
            return []
        near: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.prefix.get(w, ()):
                near.setdefault(k, []).append(i)
        hits: dict[str, list[tuple[float, int, int]]] = {}
        for k, at in near.items():
            hits.setdefault(self.sets[k][0], []).extend(self.windows(k, words, at))
        found = []
        for label, all_of in hits.items():
            taken: list[tuple[int, int]] = []  # in order, none overlaps another
            for c, first, last in sorted(all_of, key=lambda h: (-h[0], h[2], -h[1])):
                j = bisect(taken, (first, last))
                if (j == 0 or taken[j - 1][1] < first) and (j == len(taken) or taken[j][0] > last):
                    taken.insert(j, (first, last))
                    found.append((first, last, label, c))
        return sorted(found)

    def windows(self, k: int, words: list[bytes], near: list[int]) -> Iterator[tuple[float, int, int]]:
        """(containment, first, last) of the windows around the places ``near`` that have enough of template k and its names, each without spare words at its start."""
        own, width, need, names, size = self.at[k], self.width[k], self.need[k], self.names[k], len(self.sets[k][1])
        held: deque[tuple[int, bytes]] = deque()
        n: Counter[bytes] = Counter()
        done = -1
        for p in near:
            for i in range(max(done + 1, p - width + 1), min(len(words), p + width)):
                done = i
                w = words[i]
                if w not in own:
                    continue
                held.append((i, w))
                n[w] += 1
                while held[0][0] <= i - width or n[held[0][1]] > 1:
                    old = held.popleft()[1]
                    n[old] -= 1
                    if not n[old]:
                        del n[old]
                if len(n) >= need and all(x in n for x in names):
                    yield len(n) / size, held[0][0], i


def template_word_counts(docs: DataFrame, words: frozenset[bytes], text_col: str = "text") -> dict[str, int]:
    """For each of the templates' words, how many documents have it. Only these few counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in _texts(batch, 0):
                seen.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = hidden(docs, [text_col]).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.85,
    span: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` lists what was found by template: label, first and last word, containment. ``labels`` joins the labels of
    phrases and of blocks. ``score`` is 1 with a phrase, else the best containment, 0 where nothing was found.

    Null and empty texts have no words: counts 0, places null, labels empty, score 0. Null ids are kept, repeated rows
    are scanned each, an empty table gives an empty result, and extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = Templates(phrases, templates, threshold, {}, span)
    every = known.vocabulary | {w for p, _ in known.phrases for w in p}
    seen = template_word_counts(docs, every, text_col)
    block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
    schema = f"{id_col} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label:string,first:bigint,last:bigint,containment:double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(phrases, templates, threshold, seen, span)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in _texts(batch, 1):
                words = words_of(text)
                met = set(t.watched.intersection(words))
                base = t.places(words, met) if met else []
                found = t.blocks(words, met) if met else []
                own = {x[2] for x in base}
                row = (
                    len(words),
                    len(base),
                    min((x[0] for x in base), default=None),
                    max((x[0] for x in base), default=None),
                    ",".join(sorted(own)),
                    ",".join(sorted(own | {x[2] for x in found})),
                    1.0 if base else max((x[3] for x in found), default=0.0),
                    [{"label": x[2], "first": x[0], "last": x[1], "containment": x[3]} for x in found],
                )
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return hidden(docs, [id_col, text_col]).mapInArrow(scan, schema)
