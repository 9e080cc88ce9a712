"""Licence scans with a positional index of rare template words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Each template keeps the places of its
rarest words, by document frequency over the whole corpus. Where a text has such a word, the template
is laid over it at the place that the index tells; places that several words agree on, or one word
proposes, are compared word by word, and the label is given where enough words agree and all key phrases
of the template stand inside.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows get equal
results; with no rows there are no results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tasks import released
from folioscope.llm.words import Words, slices, words_of

# Phrases whose places are reported, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Fixed values: (label, template, key phrases that must stand in a match).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
     " associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
     " general public license as published by the free software foundation", ("general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
     " provided that the following conditions are met", ("redistribution and use", "conditions are met")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
)
#: Rare words of a template that are looked up, and the share of its words that must agree.
RARE_WORDS, AGREE = 4, 0.7


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)])).hash


def _runs(words: Words, phrase: np.ndarray) -> np.ndarray:
    """First words of the places where the phrase's words stand one after the other in one text."""
    n = len(words.hash) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words.hash[:n] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[words.hash[at + i] == phrase[i]]
    return at[words.row[at] == words.row[at + len(phrase) - 1]]


@dataclass
class Index:
    """labels, words and key phrases by template; rare: sorted hashes with (template, place) of each."""

    labels: list[str]
    templates: list[np.ndarray]
    phrases: list[list[np.ndarray]]
    rare: np.ndarray
    at: list[tuple[int, int]]


def document_frequencies(documents: DataFrame, templates: tuple = TEMPLATES) -> tuple[dict[int, int], int]:
    """Documents that hold each template word, and all documents: one count over the corpus."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t, _ in templates]))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(0)):
                words = words_of(data, offsets)
                place = np.searchsorted(vocabulary, words.hash).clip(0, len(vocabulary) - 1)
                hit = vocabulary[place] == words.hash
                pairs = np.unique(words.row[hit] * len(vocabulary) + place[hit])
                found += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                rows += hi - lo
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(vocabulary))), pa.array(np.append(rows, found))], ["word", "documents"])

    counted = documents.select("text").mapInArrow(count, "word long, documents long").groupBy("word").agg(
        F.sum("documents").alias("documents")).collect()
    by = {r["word"]: r["documents"] for r in counted}
    return {int(h): by.get(i, 0) for i, h in enumerate(vocabulary)}, by.get(-1, 0)


def build_index(frequency: dict[int, int], rows: int, templates: tuple = TEMPLATES,
                rare_words: int = RARE_WORDS) -> Index:
    entries: list[tuple[int, int, int]] = []
    words = [_hashes(t) for _, t, _ in templates]
    for t, own in enumerate(words):
        idf = [math.log((rows + 1) / (frequency.get(int(h), 0) + 1)) for h in own]
        for place in sorted(range(len(own)), key=lambda i: (-idf[i], i))[:rare_words]:
            entries.append((int(own[place]), t, place))
    entries.sort()
    return Index([x for x, _, _ in templates], words, [[_hashes(p) for p in k] for _, _, k in templates],
                 np.array([e[0] for e in entries], np.uint64), [e[1:] for e in entries])


def _matches(index: Index, words: Words) -> list[tuple[int, str, float]]:
    """(row, label, share of agreeing words) of the templates found in a slice."""
    left = np.searchsorted(index.rare, words.hash, side="left")
    right = np.searchsorted(index.rare, words.hash, side="right")
    proposed: set[tuple[int, int]] = set()
    for w in np.flatnonzero(right > left):
        for e in range(left[w], right[w]):
            template, place = index.at[e]
            proposed.add((template, int(w) - place))
    found = []
    for template, start in proposed:
        own = index.templates[template]
        places = np.arange(start, start + len(own))
        inside = (places >= 0) & (places < len(words.hash))
        if not inside.any():
            continue
        rows = words.row[places[inside]]
        for row in np.unique(rows):
            here = np.flatnonzero(inside)[rows == row]
            agree = float((words.hash[places[here]] == own[here]).sum()) / len(own)
            if agree < AGREE:
                continue
            text = words.hash[places[here]]
            if all(any((text[i:i + len(p)] == p).all() for i in range(len(text) - len(p) + 1))
                   for p in index.phrases[template]):
                found.append((int(row), index.labels[template], agree))
    return found


def scan(documents: DataFrame, index: Index, base: tuple = BASE) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score (share of
    template words that agree; 0.5 at least where a base phrase stands)."""
    phrases = [(_hashes(p), label) for p, label in base]
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, -1), np.full(n, -1)
            base_labels: list[set] = [set() for _ in range(n)]
            labels: list[set] = [set() for _ in range(n)]
            scores = np.zeros(n)
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets)
                counts[lo:hi] = words.counts
                for phrase, label in phrases:
                    for at in _runs(words, phrase):
                        row = lo + int(words.row[at])
                        place = int(at - words.first[words.row[at]])
                        places[row] += 1
                        first[row] = place if first[row] < 0 else min(first[row], place)
                        last[row] = max(last[row], place)
                        base_labels[row].add(label)
                        labels[row].add(label)
                        scores[row] = max(scores[row], 0.5)
                for row, label, agree in _matches(index, words):
                    labels[lo + row].add(label)
                    scores[lo + row] = max(scores[lo + row], agree)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts), pa.array(places), pa.array(first, mask=first < 0),
                pa.array(last, mask=last < 0), pa.array([",".join(sorted(x)) for x in base_labels]),
                pa.array([",".join(sorted(x)) for x in labels]), pa.array(scores)], names)

    return documents.select("doc_id", "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long,"
              " first_word long, last_word long, base_labels string, labels string, score double")
