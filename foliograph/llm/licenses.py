"""License notices by an exact set-similarity join of text blocks with templates.

A block, a line of a document or a window of its words, matches a template when it holds at least a
given share of the template's distinct words (containment). The join is exact
and filtered: words are ordered by how many blocks of the whole corpus hold
them, rarest first; a match must share one of the template's first
``|t| - c + 1`` words (prefix filter, ``c`` the number of words required), must
have ``c`` words (length filter), and from the first shared word on enough
words must be left on both sides (positional filter). What passes is counted.
The templates are a fixed, short list, so documents stream past them without
being shuffled; the frequencies are counted over all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import ASCII_LOWER, small_batches, table, text_bytes, windows

#: Phrases of the base labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short forms of public license notices, and their labels.
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-notice", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("apache-2.0-terms", "you may not use this file except in compliance with the license"),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-notice", "licensed under cc by 4 0"),
    ("cc-by-sa-notice", "licensed under cc by sa 4 0"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-nd-notice", "licensed under cc by nd 4 0"),
    ("cc0-notice", "to the extent possible under law the author has waived all copyright and related rights"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
THRESHOLD = 0.8
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in ASCII_LOWER)


def words(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes above ASCII, after A-Z is lower-cased."""
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # rarest first
    needed: int
    length: int  # words with repetitions


class Templates:
    """The templates under a global order of words, with the prefixes indexed."""

    def __init__(self, frequency: dict[bytes, int], threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.order = lambda w: (frequency.get(w, 0), w)
        self.all: list[Template] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            own = tuple(sorted(set(words(text.encode())), key=self.order))
            needed = max(1, -(-round(threshold * len(own) * 1e9) // 10**9))
            for at in range(len(own) - needed + 1):
                self.prefix[own[at]].append((len(self.all), at))
            self.all.append(Template(label, own, needed, len(words(text.encode()))))
        self.rare = frozenset(self.prefix)
        self.known = frozenset(w for t in self.all for w in t.words)

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of the templates that a block of distinct words holds."""
        if self.rare.isdisjoint(block):
            return
        own = sorted(block & self.known, key=self.order)  # other words count for no template
        place = {w: i for i, w in enumerate(own)}
        seen = set()
        for w in own:
            for n, at in self.prefix.get(w, ()):
                t = self.all[n]
                if n in seen:
                    continue
                seen.add(n)  # the first shared word decides: a later one leaves less on both sides
                if len(own) < t.needed or 1 + min(len(t.words) - at - 1, len(own) - place[w] - 1) < t.needed:
                    continue
                shared = len(block.intersection(t.words))
                if shared >= t.needed:
                    yield t.label, shared / len(t.words)


def wrapped(index: Templates, own: list[bytes]) -> Iterator[tuple[str, float]]:
    """(label, best containment) of the templates that some window of a text's words, as long as the template, holds."""
    held = index.known.intersection(own)
    for t in index.all:
        wanted = held.intersection(t.words)
        if len(wanted) < t.needed:
            continue
        inside: Counter[bytes] = Counter()
        spots, first, best = [i for i, w in enumerate(own) if w in wanted], 0, 0
        for spot in spots:
            inside[own[spot]] += 1
            while spots[first] <= spot - t.length:
                inside[own[spots[first]]] -= 1
                if not inside[own[spots[first]]]:
                    del inside[own[spots[first]]]
                first += 1
            best = max(best, len(inside))
        if best >= t.needed:
            yield t.label, best / len(t.words)


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """For each word of a template, the number of blocks of all documents that hold it."""
    known = frozenset(w for _, text in TEMPLATES for w in words(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in windows(batches, "body"):
            for body in batch.column(0).to_pylist():
                for line in body.split(b"\n"):
                    counts.update(known.intersection(line.translate(_WORDS).split()))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    rows = docs.select(text_bytes(text_col).alias("body")).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the templates' words


def places(own: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word positions at which a phrase's words stand one after the other."""
    found, at = [], 0
    head, rest = phrase[0], phrase[1:]
    while True:
        try:
            at = own.index(head, at)
        except ValueError:
            return found
        if own[at + 1 : at + len(phrase)] == rest:
            found.append(at)
        at += 1


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks).

    ``blocks`` lists every matching line as struct<line, label, containment>;
    ``labels`` and ``score`` also count notices that are wrapped over lines,
    by windows of words as long as the template. ``score`` is 1 with a base
    label and else the best containment of any line or window, 0 without a
    match. Null is the empty text; rows with null or repeated ids give a row
    each, and an empty table none; texts of any length are read whole. Several
    templates with one label give the label once, of equally good lines all are
    listed, in order.
    """
    small_batches(docs.sparkSession)
    templates = Templates(frequencies(docs, text_col), threshold)
    frequency = {w: n for w, n in ((w, templates.order(w)[0]) for w in templates.known)}
    phrases = [([w for w in words(p.encode())], label) for p, label in PHRASES]
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<line: long, label: string, containment: double>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(frequency, threshold)
        block = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block]
        for batch in windows(batches, "body"):
            out = []
            for body in batch.column(1).to_pylist():
                plain = body.translate(_WORDS)
                own = plain.split()
                at = {label: places(own, phrase) for phrase, label in phrases if phrase[-1] in plain}
                starts = [p for found in at.values() for p in found]
                base = {label for label, found in at.items() if found}
                held = []
                if not index.rare.isdisjoint(own):
                    for n, line in enumerate(body.split(b"\n")):
                        held += [(n, label, share) for label, share in index.matches(set(line.translate(_WORDS).split()))]
                across = list(wrapped(index, own)) if b"\n" in body else []
                best = 1.0 if base else max((share for *_, share in [*held, *across]), default=0.0)
                labels = base.union((label for _, label, _ in held), (label for label, _ in across))
                out.append(
                    (
                        len(own), len(starts), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base)), ",".join(sorted(labels)), best,
                        [{"line": n, "label": label, "containment": share} for n, label, share in held],
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: license phrases, labels and score of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("blocks")
