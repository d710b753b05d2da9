"""Licence scan with a generalised suffix automaton of licence words.

The automaton of all templates is a few thousand states, built once per worker. A text is streamed through it word by
word, which gives the matching statistics: how long the longest run of words ending here is that stands in a template.
Words outside the templates, and pairs of words that follow each other in no template, end every longer match, so the
stream is cut there with NumPy and only the pieces between are walked in Python. Where a piece holds a long match, all its
long runs with all their places in the templates are chained per template into covered spans; short phrases are places where the walk has just read a whole phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.text import ALNUM_BYTES, Chunk, chunks, find_words, word_hashes

# Base phrases with their labels, and passages of public licence texts with theirs.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
        "general public license along with this program",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means",
    ),
)

#: Words of a match that takes part in a chain; words of text that a chain may leave out between two matches; share of a
#: template's words that makes a finding.
LONG_MATCH, MOST_GAP, LEAST_COVER = 5, 40, 0.3
#: Score of a base phrase alone.
PHRASE_SCORE = 0.6


@dataclass
class State:
    length: int
    link: int = -1
    follow: dict[int, int] = field(default_factory=dict)
    #: Phrases that end here whatever the length read, and those that need that length.
    always: tuple[int, ...] = ()
    own: tuple[tuple[int, int], ...] = ()


class Automaton:
    """Generalised suffix automaton over word numbers. Phrases and templates are sequences alike."""

    def __init__(self, phrases: tuple, templates: tuple):
        self.phrases, self.templates = phrases, templates
        sequences = [text.split() for text, _ in phrases] + [text.split() for _, text in templates]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.states = [State(0)]
        coded = [[self.words[w] for w in s] for s in sequences]
        for sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        order = sorted(range(1, len(self.states)), key=lambda i: -self.states[i].length)
        for p, sequence in enumerate(coded[: len(phrases)]):
            at = 0
            for word in sequence:
                at = self.states[at].follow[word]
            self.states[at].own += ((p, len(sequence)),)
        for i in reversed(order):
            state = self.states[i]
            if state.link > 0:
                above = self.states[state.link]
                state.always = above.always + tuple(p for p, _ in above.own)
        self.lengths = [len(s) for s in coded]
        #: Every place (template, position) of a word, and the words that are phrases.
        self.places: dict[int, list[tuple[int, int]]] = {}
        for number in range(len(phrases), len(coded)):
            for at, word in enumerate(coded[number]):
                self.places.setdefault(word, []).append((number, at))
        self.singles = [s[0] for s in coded[: len(phrases)] if len(s) == 1]
        self.pairs = np.unique([a * len(self.words) + b for s in coded for a, b in zip(s, s[1:], strict=False)])
        text = " ".join(self.words)
        chunk = next(chunks(pa.array([text])))
        hashes = word_hashes(chunk, find_words(chunk, ALNUM_BYTES))
        order_ = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order_], order_

    def _extend(self, last: int, word: int) -> int:
        """Add one word behind the sequence that ends in ``last``; returns the state of the longer sequence."""
        states = self.states
        if word in states[last].follow:
            have = states[last].follow[word]
            return have if states[have].length == states[last].length + 1 else self._split(last, word, have)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].follow:
            states[at].follow[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            have = states[at].follow[word]
            states[new].link = have if states[have].length == states[at].length + 1 else self._split(at, word, have)
        return new

    def _split(self, at: int, word: int, have: int) -> int:
        """Give the shorter strings of ``have``, those read from ``at``, a state of their own."""
        states = self.states
        copy = len(states)
        states.append(State(states[at].length + 1, states[have].link, dict(states[have].follow)))
        states[have].link = copy
        while at >= 0 and states[at].follow.get(word) == have:
            states[at].follow[word] = copy
            at = states[at].link
        return copy

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashed words, -1 outside the templates."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the matching statistics along a piece of text."""
        states = self.states
        state = length = 0
        for i, word in enumerate(codes):
            while state and word not in states[state].follow:
                state = states[state].link
                length = states[state].length
            if word in states[state].follow:
                state = states[state].follow[word]
                length += 1
            yield i, state, length

    def runs(self, codes: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(template, position, template position, words) of every maximal run that a piece shares with a place of a template."""
        open_: dict[tuple[int, int], int] = {}
        for i, word in enumerate([*codes, -1]):
            here = {(number, at): open_.pop((number, at - 1), 0) + 1 for number, at in self.places.get(word, ())}
            for (number, at), n in open_.items():
                if n >= LONG_MATCH:
                    yield number, i - n, at - n + 1, n
            open_ = here


@lru_cache(maxsize=4)
def automaton(phrases: tuple, templates: tuple) -> Automaton:
    return Automaton(phrases, templates)


Match = tuple[int, int, int]


def best_chain(matches: list[Match]) -> tuple[int, list[tuple[int, int]]]:
    """Words covered by the best chain of (text start, template start, words), and the spans of text that it takes.

    A match continues a chain when it ends behind it in text and template, without too large a gap; what overlaps counts
    once. Of equal chains the one nearest the middle is taken, so that many copies halve the matches left."""
    order = sorted(matches, key=lambda m: (m[0] + m[2], m[1] + m[2], m[2]))
    covered, before, skipped = [], [], []
    for i, (at, place, n) in enumerate(order):
        most, last, less = n, -1, 0
        for j in range(i - 1, -1, -1):
            text_end, template_end = order[j][0] + order[j][2], order[j][1] + order[j][2]
            if at - text_end > MOST_GAP:
                break
            skip = max(0, text_end - at, template_end - place)
            if skip < n and text_end < at + n and covered[j] + n - skip > most:
                most, last, less = covered[j] + n - skip, j, skip
        covered.append(most)
        before.append(last)
        skipped.append(less)
    top = max(covered)
    at = min((i for i, c in enumerate(covered) if c == top), key=lambda i: abs(2 * i - len(order)))
    spans = []
    while at >= 0:
        spans.append((order[at][0] + skipped[at], order[at][0] + order[at][2]))
        at = before[at]
    return top, spans[::-1]


def clipped(matches: list[Match], low: int, high: int) -> list[Match]:
    """The parts of matches that lie in a span of text and are long enough."""
    cut = [(max(at, low), place + max(low - at, 0), min(at + n, high) - max(at, low)) for at, place, n in matches]
    return [m for m in cut if m[2] >= LONG_MATCH]


def all_chains(matches: list[Match], least: float) -> list[tuple[int, int, int]]:
    """(words covered, first, last) of every chain that covers ``least`` words: the best first, then those of the text it leaves."""
    found, left, end = [], [], 0
    for match in sorted(matches):
        # No chain bridges a wide gap, so each part is searched alone.
        if not left or match[0] - end > MOST_GAP:
            left.append([])
        left[-1].append(match)
        end = max(end, match[0] + match[2])
    while left:
        some = left.pop()
        if len({at + k for at, _, n in some for k in range(n)}) < least:
            continue
        covered, spans = best_chain(some)
        if covered < least:
            continue
        found.append((covered, spans[0][0], spans[-1][1]))
        edges = [min(m[0] for m in some), *[x for span in spans for x in span], max(m[0] + m[2] for m in some)]
        left += [part for a, b in zip(edges[::2], edges[1::2], strict=True) if (part := clipped(some, a, b))]
    return found


def scan_row(machine: Automaton, pieces: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """Phrase places (phrase, first word) and template findings (template, first, last word, cover) of one text."""
    places: list[tuple[int, int]] = []
    matches: dict[int, list[Match]] = {}
    n_phrases = len(machine.phrases)

    for offset, codes in pieces:
        longest = 0
        for i, state, length in machine.walk(codes):
            here = machine.states[state]
            for p in here.always:
                places.append((p, offset + i - machine.lengths[p] + 1))
            for p, n in here.own:
                if length >= n:
                    places.append((p, offset + i - n + 1))
            longest = max(longest, length)
        if longest >= LONG_MATCH:
            for number, at, place, n in machine.runs(codes):
                matches.setdefault(number, []).append((offset + at, place, n))
    found = []
    for number, some in matches.items():
        size = machine.lengths[number]
        found += [(number - n_phrases, first, last, covered / size) for covered, first, last in all_chains(some, LEAST_COVER * size)]
    return places, found


def pieces_of(machine: Automaton, chunk: Chunk) -> tuple[np.ndarray, dict[int, list[tuple[int, list[int]]]]]:
    """Word count of each row, and for each row with any the runs of words whose neighbours follow each other in a template."""
    words = find_words(chunk, ALNUM_BYTES)
    codes = machine.codes(word_hashes(chunk, words))
    counts = np.diff(words.row_first)
    out: dict[int, list[tuple[int, list[int]]]] = {}
    if not len(codes):
        return counts, out
    pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * len(machine.words) + codes[1:], -1)
    joined = np.isin(pair, machine.pairs)
    inner = words.row_first[(words.row_first > 0) & (words.row_first < len(codes))]
    joined[inner - 1] = False
    edges = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    rows = words.row_of()
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if machine.singles:
        # A word that is a whole phrase is a piece also where it stands alone.
        inside = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
        alone = np.flatnonzero(np.isin(codes, machine.singles) & ~inside)
        first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
    for a, b in zip(first, last, strict=True):
        row = int(rows[a])
        out.setdefault(row, []).append((int(a - words.row_first[row]), codes[a : b + 1].tolist()))
    return counts, out


FINDING = pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
PLACE = pa.struct([("label", pa.string()), ("first", pa.int64())])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per input row: key, n_words, phrases (label and first word of every place), findings (template, covered
    span of words, last exclusive, share of the template's words), one for every chain that covers enough.

    Null and empty texts have no words and no findings; equal texts have equal ones. Phrases may overlap; each place
    counts. Chains of one template share no word of the text. An empty table gives no rows. Only key and text are
    read, so other columns may have any name. Rows are streamed: memory holds one piece of a batch at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases, templates)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                counts, pieces = pieces_of(machine, chunk)
                places: list = [[]] * chunk.rows
                findings: list = [[]] * chunk.rows
                for row, some in pieces.items():
                    spots, found = scan_row(machine, some)
                    places[row] = [{"label": phrases[p][1], "first": at} for p, at in sorted(spots, key=lambda x: (x[1], x[0]))]
                    findings[row] = [{"template": templates[t][0], "first": a, "last": b, "cover": c} for t, a, b, c in sorted(found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__key").slice(chunk.first, chunk.rows),
                        pa.array(counts.astype(np.int64)),
                        pa.array(places, type=pa.list_(PLACE)),
                        pa.array(findings, type=pa.list_(FINDING)),
                    ],
                    names=["__key", "n_words", "phrases", "findings"],
                )

    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["__key"].dataType.simpleString()
    out = "n_words long, phrases array<struct<label:string,first:bigint>>, findings array<struct<template:string,first:bigint,last:bigint,cover:double>>"
    return source.mapInArrow(scan, f"__key {kind}, {out}").withColumnRenamed("__key", key)


def license_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels, counts and a score (the best template cover, or that of a phrase alone) per row."""
    found = scan_licenses(docs, key, text)
    base = F.transform("phrases", lambda p: p["label"])
    more = F.transform("findings", lambda f: f["template"])
    starts = F.transform("phrases", lambda p: p["first"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    cover = F.coalesce(F.array_max(F.transform("findings", lambda f: f["cover"])), F.lit(0.0))
    return found.select(
        key,
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.least(F.lit(1.0), F.greatest(cover, F.when(F.size("phrases") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0)))).alias("score"),
        "findings",
    )
