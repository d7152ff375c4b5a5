"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens.

Texts are streamed through one automaton of all templates.  At each word the automaton knows the longest run of
words, ending there, that stands somewhere in a template.  Maximal runs of at least ``min_run`` words become
matches; matches of one template that follow each other in the text and in the template are chained into a covered
span.  A chain that covers at least ``min_cover`` of its template gives the template's label.  Base phrases are
templates that must be met word for word; each place counts.

Defined results: a null or empty text has no words, no places (null first and last word), no labels and score 0;
repeated rows are scanned one by one; ties between chains go to the earlier one in the text, between templates to
the first in the list; the result's columns are named here, so extra columns of the input cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import pieces, quoted

BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of public licence texts and of the notices that name them, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
)

#: Bytes of words: digits, letters and all of UTF-8 beyond ASCII; A-Z are lower-cased, others separate words.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return data.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over words; a separator that no text holds ends each template."""

    def __init__(self, templates: Iterable[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [[]]
        for t, words in enumerate(templates):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                self.places[last].append((t, k))
        # A state's runs also end where those of the states that link to it end.
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]
        self.places = [sorted(set(p)) for p in self.places]

    def _new(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state of the runs of ``p`` followed by ``w``, all of them no longer than ``length[p] + 1``."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # of an earlier template
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        self.link[state] = self._split(p, w) if p >= 0 else 0
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: Iterable[tuple[str, str]], min_run: int, min_cover: float) -> None:
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(words_of(t.encode()), label) for label, t in templates]
        self.automaton = Automaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])
        self.vocabulary = frozenset(w for words, _ in self.phrases + self.templates for w in words)
        self.min_run, self.min_cover = min_run, min_cover
        a, whole = self.automaton, len(self.phrases)
        # Phrases that are a suffix of a state's longest run: those of the state itself and of the states it links to.
        self.ends = [[(t, k + 1) for t, k in p if t < whole and k + 1 == len(self.phrases[t][0]) == n] for p, n in zip(a.places, a.length)]
        for s in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            self.ends[s] = self.ends[s] + self.ends[a.link[s]]
        self.spots = [[(t - whole, k) for t, k in p if t >= whole] for p in a.places]

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(words, places (start, phrase), maximal matches (start, words, state)) of one text."""
        a = self.automaton
        following, link, length, ends = a.next, a.link, a.length, self.ends
        known = self.vocabulary
        n, places, matches = 0, [], []
        state = run = 0
        before = -2  # the last word that was in the vocabulary
        for piece in pieces(data):
            words = words_of(piece)
            for k in [k for k, w in enumerate(words) if w in known]:
                at, w = n + k, words[k]
                if at != before + 1:
                    if run >= self.min_run:
                        matches.append((before + 1 - run, run, state))
                    state = run = 0
                before = at
                old, old_run = state, run
                while state and w not in following[state]:
                    state = link[state]
                    run = length[state]
                to = following[state].get(w)
                if to is None:
                    run = 0
                else:
                    state, run = to, run + 1
                if old_run >= self.min_run and run <= old_run:  # it could not be made longer
                    matches.append((at - old_run, old_run, old))
                for t, size in ends[state]:
                    if size <= run:
                        places.append((at + 1 - size, t))
            n += len(words)
        if run >= self.min_run:
            matches.append((before + 1 - run, run, state))
        return n, places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Chains of matches by template that cover enough of it: template, label, start and end word, cover."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, run, state in matches:
            for t, last in self.spots[state]:
                if last + 1 - run >= 0:
                    by.setdefault(t, []).append((start, last + 1 - run, run))
        out = []
        for t, found in sorted(by.items()):
            size = len(self.templates[t][0])
            for first, end, covered in chains(found, size):
                if covered >= self.min_cover * size:
                    out.append({"template": t, "label": self.templates[t][1], "start": first, "end": end, "cover": covered / size})
        return out

    def report(self, data: bytes | None) -> tuple:
        n, places, matches = self.scan(data or b"")
        spans = self.spans(matches)
        base = sorted({self.phrases[t][1] for _, t in places})
        labels = sorted({*base, *(s["label"] for s in spans)})
        starts = [s for s, _ in places]
        score = 1.0 if places else max((s["cover"] for s in spans), default=0.0)
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


def chains(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """(start, end, words covered) of chains: each match follows the chain's last one in text and template, within
    twice the template's size.  Among open chains the one that reaches furthest in the template is continued; a
    binary search finds it, so that many matches stay cheap."""
    done: list[tuple[int, int, int]] = []
    open_: list[list[int]] = []  # [template end, text start, text end, covered], by template end
    for start, at, run in sorted(found):
        done += [(c[1], c[2], c[3]) for c in open_ if start - c[1] > 2 * size]
        open_ = [c for c in open_ if start - c[1] <= 2 * size]
        k = bisect_right(open_, at, key=lambda c: c[0]) - 1
        while k >= 0 and open_[k][2] > start:
            k -= 1
        if k >= 0:
            c = open_.pop(k)
            c = [at + run, c[1], start + run, c[3] + run]
        else:
            c = [at + run, start, start + run, run]
        open_.insert(bisect_right(open_, c[0], key=lambda x: x[0]), c)
    return sorted(done + [(c[1], c[2], c[3]) for c in open_])


SPAN = "array<struct<template:int,label:string,start:bigint,end:bigint,cover:double>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", *, phrases: dict[str, str] = BASE_PHRASES, templates=TEMPLATES, min_run: int = 3, min_cover: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans of each row."""
    narrow = docs.select(quoted(key).alias("doc_id"), quoted(text).cast("string").cast("binary").alias("data"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, min_run, min_cover))  # as large as the templates
    span = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.value.report(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return narrow.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPAN}")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
