"""License scans: a positional index of the templates' rare words.

Document frequencies of the template words over all documents give their IDF; each template is
indexed by its highest-IDF words. A document's rare words look up postings (template, position);
postings that agree on the relative position vote for one alignment, and an alignment with enough
votes counts only if the template's mandatory phrase stands there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text

#: Phrases that name a license by themselves, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, usual wording of the notice, phrase that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
#: A template's index holds this share of its words, the rarest, and 2 at least.
RARE_SHARE = 0.5
#: An alignment needs this share of the template's rare IDF mass.
VOTES = 0.6
#: Words may be inserted or lost between votes that still count as one alignment.
SLACK = 2


def _hashes(words: list[str]) -> np.ndarray:
    hashes, first = _text.word_hashes(pa.array(words), _text.NON_WORD)
    assert len(hashes) == len(words)
    return hashes


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def _positions(words: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively in one text."""
    k = len(phrase)
    if len(words) < k:
        return np.zeros(0, np.int64)
    hit = words[: len(words) - k + 1] == phrase[0]
    at = np.flatnonzero(hit)
    for j in range(1, k):
        at = at[words[at + j] == phrase[j]]
    owner = np.searchsorted(first, at, side="right") - 1
    return at[at + k <= first[owner + 1]]


def _frequency_batches(batches):
    vocabulary = np.sort(_hashes(VOCABULARY))
    counts, texts = np.zeros(len(vocabulary), np.int64), 0
    for piece in _text.slices(batches):
        words, first = _text.word_hashes(piece.column("text"), _text.NON_WORD)
        place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        hit = vocabulary[place] == words
        seen = np.unique(_text.owners(first)[hit] * len(vocabulary) + place[hit])
        counts += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        texts += piece.num_rows
    yield pa.record_batch({"word": pa.array(vocabulary.view(np.int64)), "df": pa.array(counts), "n": pa.array(np.full(len(vocabulary), texts))})


def idf(docs: DataFrame) -> dict[int, float]:
    """IDF of each template word over all documents (a row for each word of the templates)."""
    rows = docs.select("text").mapInArrow(_frequency_batches, "word long, df long, n long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    found = {r["word"]: math.log((r["n"] + 1) / (r["df"] + 1)) for r in rows}
    return {h: found.get(h, 0.0) for h in _hashes(VOCABULARY).view(np.int64).tolist()}


class Index:
    """Postings of the templates' rare words, by word hash."""

    def __init__(self, weights: dict[int, float]):
        self.labels = [label for label, _, _ in TEMPLATES]
        self.keys = [_hashes(k.split()) for _, _, k in TEMPLATES]
        self.lengths = [len(t.split()) for _, t, _ in TEMPLATES]
        self.mass, postings = [], {}
        for t, (_, text, _) in enumerate(TEMPLATES):
            words = _hashes(text.split()).view(np.int64).tolist()
            rare = sorted(set(words), key=lambda w: (-weights[w], w))[: max(2, math.ceil(RARE_SHARE * len(set(words))))]
            self.mass.append(sum(max(weights[w], 1e-9) for w in rare))
            for position, w in enumerate(words):
                if w in rare:
                    postings.setdefault(w, []).append((t, position, max(weights[w], 1e-9)))
        self.words = np.sort(np.array(list(postings), np.int64).view(np.uint64))
        self.postings = [postings[int(w)] for w in self.words.view(np.int64)]

    def aligned(self, words: np.ndarray, at: np.ndarray, which: np.ndarray) -> list[tuple[int, int, float]]:
        """Template, first word and share of its rare mass, for the verified alignments of one text."""
        votes: dict[tuple[int, int], dict[int, float]] = {}
        for p, w in zip(at.tolist(), which.tolist(), strict=True):
            for t, position, weight in self.postings[w]:
                votes.setdefault((t, p - position), {})[position] = weight
        out = []
        for (t, start), own in votes.items():
            near = dict(own)
            for d in range(1, SLACK + 1):
                for other in (start - d, start + d):
                    for position, weight in votes.get((t, other), {}).items():
                        near.setdefault(position, weight)
            share = min(1.0, sum(near.values()) / self.mass[t])
            if share < VOTES:
                continue
            lo, hi = max(0, start - SLACK), start + self.lengths[t] + SLACK
            window = words[lo:hi]
            if len(_positions(window, np.array([0, len(window)]), self.keys[t])):
                out.append((t, max(start, 0), share))
        return out


def scored(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, alignments`` of every row.

    ``alignments`` lists label, first word and share of the verified ones. ``score`` is 1 where a
    base phrase stands, else the largest such share. Null and empty texts have no words, no labels
    and score 0; repeated rows each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        index = Index(shared.value)
        phrases = [(_hashes(p.split()), label) for p, label in PHRASES]
        for piece in _text.slices(batches):
            words, first = _text.word_hashes(piece.column("text"), _text.NON_WORD)
            n = piece.num_rows
            base, labels = np.zeros(n, np.int64), [set() for _ in range(n)]
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for phrase, label in phrases:
                at = _positions(words, first, phrase)
                owner = np.searchsorted(first, at, side="right") - 1
                base += np.bincount(owner, minlength=n)
                np.minimum.at(low, owner, at - first[owner])
                np.maximum.at(high, owner, at - first[owner])
                for i in np.unique(owner).tolist():
                    labels[i].add(label)
            more, score, found = [set(x) for x in labels], (base > 0).astype(float), [[] for _ in range(n)]
            place = np.minimum(np.searchsorted(index.words, words), len(index.words) - 1)
            hit = np.flatnonzero(index.words[place] == words)
            owner = np.searchsorted(first, hit, side="right") - 1
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for group in np.split(np.arange(len(hit)), cuts) if len(hit) else []:
                i = int(owner[group[0]])
                own = words[first[i] : first[i + 1]]
                for t, start, share in index.aligned(own, hit[group] - first[i], place[hit[group]]):
                    more[i].add(index.labels[t])
                    score[i] = max(score[i], share)
                    found[i].append({"label": index.labels[t], "first_word": start, "share": share})
            none = base == 0
            yield pa.record_batch({
                "doc_id": piece.column("doc_id"), "n_words": pa.array(np.diff(first)), "n_base": pa.array(base), "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
                "base_labels": pa.array([",".join(sorted(x)) for x in labels]), "labels": pa.array([",".join(sorted(x)) for x in more]), "score": pa.array(score),
                "alignments": pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("share", pa.float64())]))),
            })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, alignments array<struct<label string, first_word long, share double>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and aligned notices of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, idf(docs)).drop("alignments")
