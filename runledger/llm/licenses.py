"""Licence scans by a generalised suffix automaton.

The automaton holds every run of words of the licence templates. A text is
streamed through it word by word, which gives its matching statistics: at each
word the length of the longest run ending there that occurs in some template.
Long matches are chained per template, in order in both the text and the
template, into spans; the share of a template's words that a span covers is its
coverage. The automaton depends on the templates alone and is built once per
Python worker.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import folded_words, id_and_text, map_batches, texts_of

# The phrases of the base scan, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of licence notices, by label.
TEMPLATES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at",
    ),
    ("mit-notice", "Released under the MIT License."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: Words that a match needs to become part of a chain.
SEED_WORDS = 2
#: Words of the text that may lie between two chained matches.
CHAIN_GAP = 6
#: Share of a template that a span covers to give its label.
LABEL_COVERAGE = 0.8

SPAN = "struct<label: string, first: int, last: int, coverage: double>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    f" base_labels string, labels string, score double, spans array<{SPAN}>"
)


class LicenceAutomaton:
    """Suffix automaton of several word sequences; a match never runs from one into the next."""

    def __init__(self, sequences: list[list[bytes]]):
        self.sequences = sequences
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].append((number, place))
        #: Template places at which the runs of a state end, its own and those of longer runs.
        self.ends = [set(e) for e in ends]
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def state_of(self, words: list[bytes]) -> int:
        """The state that a run of template words leads to."""
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        found = self.next[last].get(word)
        if found is not None and self.length[found] == self.length[last] + 1:
            return found
        if found is not None:
            return self._split(last, found, word, ends)
        new = self._state({}, self.length[last] + 1, 0, ends)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            onto = self.next[at][word]
            if self.length[onto] != self.length[at] + 1:
                onto = self._split(at, onto, word, ends)
            self.link[new] = onto
        return new

    def _split(self, at: int, onto: int, word: bytes, ends: list) -> int:
        """The part of state ``onto`` whose runs are no longer than those after ``at``."""
        part = self._state(dict(self.next[onto]), self.length[at] + 1, self.link[onto], ends)
        self.link[onto] = part
        while at != -1 and self.next[at].get(word) == onto:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def _state(self, following: dict, length: int, link: int, ends: list) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        ends.append([])
        return len(self.next) - 1

    def walk(self, words: list[bytes], start: int, end: int):
        """Matching statistics of ``words[start:end]``: place, length and state of each match."""
        state = size = 0
        nexts, links, lengths = self.next, self.link, self.length
        for place in range(start, end):
            word = words[place]
            while True:
                to = nexts[state].get(word)
                if to is not None:
                    state, size = to, size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = links[state]
                size = lengths[state]
            yield place, size, state


class Scanner:
    """Finds phrases and template spans in the words of a text."""

    def __init__(self):
        self.phrases = [p.encode().split() for p in PHRASES]
        self.phrase_labels = list(PHRASES.values())
        self.labels = [label for label, _ in TEMPLATES]
        templates = [folded_words(text.encode()) for _, text in TEMPLATES]
        self.automaton = LicenceAutomaton(self.phrases + templates)
        self.vocabulary = {w for s in self.automaton.sequences for w in s}
        #: By state, the phrases (length, label) that are suffixes of its longest run.
        own = defaultdict(list)
        for words, label in zip(self.phrases, self.phrase_labels, strict=True):
            own[self.automaton.state_of(words)].append((len(words), label))
        links, lengths = self.automaton.link, self.automaton.length
        self.ending: dict[int, list[tuple[int, str]]] = {0: []}
        for state in sorted(range(1, len(links)), key=lengths.__getitem__):
            self.ending[state] = self.ending[links[state]] + own[state]

    def scan(self, words: list[bytes]):
        """Places of base phrases as (first, last, label), and spans as (label, first, last, coverage)."""
        known = self.vocabulary
        found: list[tuple[int, int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        inside = [i for i, w in enumerate(words) if w in known]
        # Only runs of words that some template has can match at all.
        runs, at = [], 0
        while at < len(inside):
            start = end = inside[at]
            while at < len(inside) and inside[at] == end:
                at, end = at + 1, end + 1
            if end - start >= SEED_WORDS:
                runs.append((start, end))
        for start, end in runs:
            previous = (0, 0, 0)
            for place, size, state in self.automaton.walk(words, start, end):
                for long, label in self.ending[state]:
                    if size >= long:
                        found.append((place - long + 1, place, label))
                if size <= previous[1]:
                    self._keep(matches, *previous)
                previous = (place, size, state)
            self._keep(matches, *previous)
        return sorted(found), self._chains(matches)

    def _keep(self, matches, place: int, size: int, state: int) -> None:
        """Note a match that does not go on, once for each place of the templates it occurs at."""
        if size >= SEED_WORDS:
            for number, stop in self.automaton.ends[state]:
                if number >= len(self.phrases):
                    matches[number].append((place, stop, size))

    def _chains(self, matches):
        spans = []
        for number, seeds in matches.items():
            total = len(self.automaton.sequences[number])
            seeds.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain to here, its first word
            ends_at: dict[int, tuple[int, int, int]] = {}
            for k, (place, stop, size) in enumerate(seeds):
                first = place - size + 1
                covered, begin = size, first
                for j in range(k - 1, -1, -1):
                    other, other_stop, _ = seeds[j]
                    if other < first - CHAIN_GAP - 1:
                        break
                    if other_stop >= stop or other >= place:
                        continue
                    # The part of this match that lies behind the other in both.
                    fresh = min(size, place - other, stop - other_stop)
                    if best[j][0] + fresh > covered:
                        covered, begin = best[j][0] + fresh, best[j][1]
                best.append((covered, begin))
                if covered > ends_at.get(begin, (0, 0, 0))[0]:
                    ends_at[begin] = (covered, begin, place)
            for covered, begin, place in ends_at.values():
                spans.append((self.labels[number - len(self.phrases)], begin, place, min(1.0, covered / total)))
        return sorted(spans)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def scan_licences(docs: DataFrame) -> DataFrame:
    """Base phrases, labels and covered template spans of every whole text.

    ``n_words`` words; ``n_base`` places of phrases with the first and last word
    they start at (null without one); ``base_labels`` and ``labels`` sorted and
    comma-joined, the latter with templates covered by :data:`LABEL_COVERAGE` or
    more; ``score`` the greatest coverage of any template or phrase; ``spans``
    all chains with their word range and coverage. Null and empty texts have no
    words, empty labels and score 0. Rows are independent, so null ids, repeated
    rows and further columns have no effect; an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan = scanner().scan
        out: list[list] = [[] for _ in range(8)]
        for data in texts_of(batch.column(1)):
            words = folded_words(data)
            found, spans = scan(words)
            base = {label for _, _, label in found}
            full = {label for label, _, _, coverage in spans if coverage >= LABEL_COVERAGE}
            row = (
                len(words),
                len(found),
                found[0][0] if found else None,
                found[-1][0] if found else None,
                ",".join(sorted(base)),
                ",".join(sorted(base | full)),
                1.0 if found else max((s[3] for s in spans), default=0.0),
                [dict(zip(("label", "first", "last", "coverage"), s, strict=True)) for s in spans],
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        span = pa.struct(
            [("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64())]
        )
        kinds.append(pa.list_(span))
        arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return map_batches(id_and_text(docs), work, SCHEMA)


def digests(scanned: DataFrame) -> DataFrame:
    """The scan's columns with the number of spans in place of the spans."""
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").alias("n_spans"),
    )
