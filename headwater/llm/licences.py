"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds all templates and base phrases. A text is streamed through it: after every word, the length of the
longest run of words that ends there and occurs in some template (the matching statistics). Runs that cannot grow are
matches; those of three words or more are chained, per template, in the order of both sides, into spans. A template's
label holds where a chain covers enough of its words. Base phrases are templates too, and each place counts.

Only stretches whose neighbouring words stand next to each other in some template are streamed: elsewhere the
matching statistics are one or zero, told from the word hashes alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.shared import tidy

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label -> notices that state it: short public notices and opening sentences of well-known licences. Whole texts stand beside them (``whole_texts``).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl-3.0": (
        "licensed under the gnu general public license version 3",
        "either version 3 of the license or at your option any later version",
    ),
    "gpl-2.0": ("gnu general public license version 2", "either version 2 of the license or at your option any later version"),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "cc-by-4.0": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0",),
    "cc0": ("cc0 1 0 universal public domain dedication", "dedicated to the public domain"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "no-reproduction": ("no part of this publication may be reproduced distributed or transmitted in any form or by any means without prior written permission",),
}



def whole_texts() -> dict[str, tuple[str, ...]]:
    """Label -> whole public licence texts or notices: the files of ``licence_texts``, named by label and, where it has several, a number after two dashes."""
    found: dict[str, tuple[str, ...]] = {}
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            label = file.name.removesuffix(".txt").split("--")[0]
            found[label] = (*found.get(label, ()), file.read_text(encoding="utf-8"))
    return found


def all_templates() -> dict[str, tuple[str, ...]]:
    whole = whole_texts()
    return {label: (*TEMPLATES.get(label, ()), *whole.get(label, ())) for label in (*TEMPLATES, *(k for k in whole if k not in TEMPLATES))}


LEAST_MATCH = 3
#: Share of a template's words that a chain has to cover, and words that it may skip between two matches.
COVER, GAP = 0.8, 4


class Automaton:
    """Suffix automaton over word numbers; a separator that no text has stands between templates."""

    def __init__(self, templates: list[tuple[str, list[int]]], phrases: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for _, t in templates]
        for t, (_, tokens) in enumerate([*templates, *(("", p) for p in phrases)]):
            last = 0
            for place, token in enumerate(tokens):
                last = self._add(last, token, ends)
                if t < len(templates):
                    ends[last].add((t, place))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for number, tokens in enumerate(phrases):
            s = 0
            for token in tokens:
                s = self.next[s][token]
            self.phrases[s].append((number, len(tokens)))
        for s in reversed(order):
            if self.link[s] > 0:
                self.phrases[s] = self.phrases[s] + self.phrases[self.link[s]]

    def _add(self, last: int, token: int, ends: list) -> int:
        """Extend by one token; where the transition is there already (a later template), split it if it is too long."""
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q, ends)
        new = self._state(self.length[last] + 1, {}, ends)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q, ends)
        return new

    def _state(self, length: int, following: dict, ends: list) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int, ends: list) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), ends)
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, matching statistic) after every token."""
        state = size = 0
        for i, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            yield i, state, size


def chains(matches: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(template, first word, last word, covered words) from matches (template, text end, template end, length).

    For every match, the best chain that ends in it: earlier in the text and in the template, at most ``GAP`` words
    skipped in the text; overlaps count once.
    """
    by: dict[int, list[tuple[int, int, int]]] = {}
    for t, end, place, size in matches:
        by.setdefault(t, []).append((end, place, size))
    for t, own in by.items():
        own.sort()
        ends = [end for end, _, _ in own]
        best: list[tuple[int, int]] = []  # covered words, first word
        for i, (end, place, size) in enumerate(own):
            covered, first = size, end - size + 1
            for j in range(bisect_left(ends, end - size - GAP), i):
                e, p, _ = own[j]
                new = min(size, end - e, place - p)
                if e < end and p < place and new > 0 and best[j][0] + new > covered:
                    covered, first = best[j][0] + new, best[j][1]
            best.append((covered, first))
            yield t, first, end, covered


def outdone(spans: dict[tuple[str, int], tuple[int, float, int]]) -> dict[tuple[str, int], tuple[int, float, int]]:
    """``spans`` ((label, first word): (last word, share, words)) without those that another label's explains better.

    Kindred licences differ by a few words, so one text covers the templates of several: of spans that share more than half of
    their words, one that is covered by a smaller share and by no more words than the other's gives way. Ties stay.
    """
    kept = {}
    for (label, first), (last, share, covered) in spans.items():
        half = (last - first + 1) / 2
        if not any(k != label and s > share and c >= covered and min(last, e) - max(first, b) + 1 > half for (k, b), (e, s, c) in spans.items()):
            kept[label, first] = (last, share, covered)
    return kept


class Scanner:
    """Vocabulary, automaton and the table of neighbouring words, built once per Python worker."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, base: dict[str, str] = BASE):
        templates = all_templates() if templates is None else templates
        self.base = list(base.values())
        texts = [(label, text) for label, all_of in templates.items() for text in all_of]
        w = W.words(pa.array([t for _, t in texts] + list(base)), ascii_only=True)
        self.vocabulary = np.unique(w.hash)
        numbers = np.searchsorted(self.vocabulary, w.hash)
        lists = [numbers[a:b].tolist() for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        self.automaton = Automaton([(label, t) for (label, _), t in zip(texts, lists, strict=False)], lists[len(texts) :])
        size = len(self.vocabulary)
        self.adjacent = np.zeros((size + 1, size + 1), bool)
        for t in lists:
            self.adjacent[t[:-1], t[1:]] = True
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The word's number, or one past the last."""
        out = np.full(len(hashes), len(self.vocabulary), np.int64)
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out

    def scan(self, numbers: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Per text: (base places, first start, last start, base labels, labels, score, spans)."""
        joined = self.adjacent[numbers[:-1], numbers[1:]] if len(numbers) > 1 else np.zeros(0, bool)
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(numbers))]
        joined[edge - 1] = False
        place = np.flatnonzero(joined)
        breaks = np.flatnonzero(np.diff(place) != 1) + 1
        begin = place[np.concatenate([[0], breaks])] if len(place) else place
        stop = place[np.concatenate([breaks - 1, [len(place) - 1]])] + 2 if len(place) else place
        doc = np.searchsorted(offsets, begin, "right") - 1
        base: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        matches: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        a = self.automaton
        for b, e, d in zip(begin.tolist(), stop.tolist(), doc.tolist(), strict=True):
            at, held = b - int(offsets[d]), (0, 0, 0)
            for i, state, size in a.stream(numbers[b:e].tolist()):
                for phrase, n in a.phrases[state]:
                    if n <= size:
                        base[d].append((phrase, at + i - n + 1))
                if size <= held[2] and held[2] >= LEAST_MATCH:
                    matches[d] += [(t, at + held[0], p, held[2]) for t, p in a.ends[held[1]]]
                held = (i, state, size)
            if held[2] >= LEAST_MATCH:
                matches[d] += [(t, at + held[0], p, held[2]) for t, p in a.ends[held[1]]]
        return [self._result(x, y) for x, y in zip(base, matches, strict=True)]

    def _result(self, base: list[tuple[int, int]], matches: list[tuple[int, int, int, int]]) -> tuple:
        starts = [s for _, s in base]
        own = sorted({self.base[p] for p, _ in base})
        spans: dict[tuple[str, int], tuple[int, float, int]] = {}
        for t, first, last, covered in chains(matches) if matches else ():
            share = covered / self.automaton.sizes[t]
            key = (self.automaton.labels[t], first)
            if share >= COVER and (share, covered) >= spans.get(key, (0, 0.0, 0))[1:]:
                spans[key] = (last, share, covered)
        spans = outdone(spans)
        found = sorted({label for label, _ in spans} | set(own))
        score = 1.0 if own else max((share for _, share, _ in spans.values()), default=0.0)
        listed = [{"label": k[0], "first_word": k[1], "last_word": v[0], "cover": v[1]} for k, v in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0]))]
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(found), min(1.0, score), listed


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, cover: double>>"
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            w = W.words(W.as_strings(piece.column("text")), ascii_only=True)
            rows = own.scan(own.number(w.hash), w.offsets)
            columns = [piece.column("doc_id"), pa.array(np.diff(w.offsets), pa.int64()), *(pa.array([r[i] for r in rows], _TYPES[i + 2]) for i in range(7))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, their labels, all labels, a score and the covered spans.

    score: 1 with a base phrase, else the largest share of a template that a span covers. Null, empty and word-less
    texts: zeros, nulls and empty labels. Ids are cast to long; null ids and repeated rows keep their rows. A very long text is streamed
    whole, only its stretches of neighbouring licence words. Of kindred licences the best covered counts, ties all. An empty table gives none;
    other columns, whatever their names, are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_scan), SCHEMA)
