"""License notices in documents: matching statistics against a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import map_batches, plain_bytes

# Phrases that count wherever they stand, with their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices of common licenses, as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words of a match that counts as long, words that a chain may skip, share of a template that gives its label.
LONG = 3
GAP = 6
COVERED = 0.8


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with the places of each state in them.

    ``vocabulary`` numbers the words; ``follows`` tells which two words stand side by side in any
    sequence. ``ends[s]`` holds (sequence, last word) of the strings of state s; ``phrases[s]`` the
    phrases, as (words, label), that end every string of s that is long enough.
    """

    sequences: list[list[bytes]]
    marked: dict[int, str]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        places: dict[int, set[tuple[int, int]]] = {}
        finals: dict[int, tuple[int, str]] = {}
        for k, words in enumerate(self.sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                places.setdefault(last, set()).add((k, at))
            if k in self.marked:
                finals[last] = (len(words), self.marked[k])
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            here = places.get(state, set())
            self.ends[state] = sorted(here)
            if self.link[state] > 0:
                places.setdefault(self.link[state], set()).update(here)
        self.phrases: list[list[tuple[int, str]]] = []
        for state in range(len(self.step)):
            held, up = [], state
            while up > 0:
                if up in finals:
                    held.append(finals[up])
                up = self.link[up]
            self.phrases.append(held)
        size = len(self.vocabulary)
        self.follows = np.zeros((size + 1, size + 1), bool)
        for words in self.sequences:
            ids = [self.vocabulary[w] for w in words]
            self.follows[ids[:-1], ids[1:]] = True

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence read so far and one more word."""
        known = self.step[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.step[at]:
            self.step[at][word] = state
            at = self.link[at]
        if at != -1:
            target = self.step[at][word]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return state

    def _split(self, at: int, word: int, state: int) -> int:
        """Give the shorter strings of ``state`` a state of their own."""
        short = self._new(self.length[at] + 1, dict(self.step[state]), self.link[state])
        self.link[state] = short
        while at != -1 and self.step[at].get(word) == state:
            self.step[at][word] = short
            at = self.link[at]
        return short

    def matches(self, words: Sequence[bytes]) -> Iterator[tuple[int, int, int, bool]]:
        """Matching statistics of a text, where they exceed one word.

        Yields (position, length of the longest match that ends there, its state, whether the next
        word does not continue it). Where two neighbouring words stand side by side in no sequence a
        match can't run across, so only stretches without such a gap are fed to the automaton.
        """
        if len(words) < 2:
            return
        size = len(self.vocabulary)
        ids = np.fromiter((self.vocabulary.get(w, size) for w in words), np.int64, len(words))
        joined = np.concatenate([[False], self.follows[ids[:-1], ids[1:]], [False]])
        turns = np.flatnonzero(np.diff(joined.astype(np.int8)))
        for first, last in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            state, length = 0, 0
            found: list[tuple[int, int, int]] = []
            for at in range(first, last + 1):
                word = int(ids[at])
                while state and word not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
                state = self.step[state][word]
                length += 1
                found.append((at, length, state))
            for i, (at, length, state) in enumerate(found):
                if length > 1:
                    yield at, length, state, i + 1 == len(found) or found[i + 1][1] <= length


def _words(text: str | None) -> list[bytes]:
    return plain_bytes(text).split()


def automaton(phrases=PHRASES, templates=TEMPLATES) -> SuffixAutomaton:
    """The automaton of all templates and phrases; templates come first."""
    sequences = [_words(t) for _, t in templates] + [_words(p) for p, _ in phrases]
    labels = {len(templates) + k: label for k, (_, label) in enumerate(phrases)}
    return SuffixAutomaton(sequences, labels)


@dataclass
class Chain:
    """Matches in the same order in text and template: spans of both, and template words matched."""

    template: int
    first: int
    last: int
    upto: int
    matched: int


def chains(matches: Sequence[tuple[int, int, list[tuple[int, int]]]], gap: int, templates: int) -> list[Chain]:
    """Chain long matches (first word, words, places in templates), given in text order.

    A match continues the chain of its template if it begins at most ``gap`` words after it, in the
    text and in the template; where it overlaps, only its new words count. Otherwise it opens a chain.
    """
    open_chains: dict[int, Chain] = {}
    closed: list[Chain] = []
    for first, length, places in matches:
        by_template: dict[int, list[int]] = {}
        for template, end in places:
            if template < templates:
                by_template.setdefault(template, []).append(end)
        for template, ends in by_template.items():
            chain = open_chains.get(template)
            if chain and first - chain.last <= gap + 1:
                later = [e for e in ends if chain.upto < e <= chain.upto + length + gap]
                if later:
                    end = later[0]
                    fresh = min(length, end - chain.upto, first + length - 1 - chain.last)
                    if fresh > 0:
                        chain.last, chain.upto, chain.matched = first + length - 1, end, chain.matched + fresh
                        continue
            if chain:
                closed.append(chain)
            open_chains[template] = Chain(template, first, first + length - 1, ends[0], length)
    return closed + list(open_chains.values())


_SPANS = "array<struct<label:string,first:long,last:long,coverage:double>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
)


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    long: int = LONG,
    gap: int = GAP,
    covered: float = COVERED,
) -> DataFrame:
    """Every document with the places of phrases and the chained spans of license templates.

    Words are ASCII letters and digits, A-Z lower-cased, and all characters beyond ASCII. The
    automaton of the given texts, a parameter, is built in each task; documents stream through it
    and stay where they are.

    Returns doc_id, ``n_words``, ``places`` (label and first word of each phrase) and ``spans`` (label,
    first and last word, share of the template that the chain covers; every chain of long matches).
    A phrase counts wherever its words stand consecutively. An empty or null text has neither;
    repeated rows are judged each by itself; an empty table gives an empty result.
    """
    phrases, templates = tuple(phrases), tuple(templates)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases, templates)
        sizes = [len(s) for s in machine.sequences]
        for batch in batches:
            counts, places, spans = [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                counts.append(len(words))
                here: list[dict] = []
                matches: list[tuple[int, int, list[tuple[int, int]]]] = []
                for at, length, state, ends in machine.matches(words):
                    here += [{"label": label, "first": at - n + 1} for n, label in machine.phrases[state] if n <= length]
                    if ends and length >= long:
                        matches.append((at - length + 1, length, machine.ends[state]))
                places.append(here)
                spans.append(
                    [
                        {"label": templates[c.template][0], "first": c.first, "last": c.last, "coverage": c.matched / sizes[c.template]}
                        for c in chains(matches, gap, len(templates))
                    ]
                )
            place_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(spans, _SPAN_TYPE)],
                names=["doc_id", "n_words", "places", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(
        rows, judge, f"doc_id long, n_words long, places array<struct<label:string,first:long>>, spans {_SPANS}"
    )


def op3_license_notices(spark, sf_dir: str) -> DataFrame:
    """License phrases and covered templates of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    own = F.transform(F.filter("spans", lambda s: s["coverage"] >= COVERED), lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.first")).alias("first_word"),
        F.array_max(F.col("places.first")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0))))
        .alias("score"),
    )
