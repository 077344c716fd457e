"""Operator 5: license scans by an exact set-similarity join of text blocks with license templates.

For each template a text is cut into blocks twice as long as the template, each overlapping the next by half, so that every
stretch of the template's length lies inside one. A block matches a template if it holds at least `threshold` of the
template's distinct words. Tokens are ordered by how many documents they stand in, over the whole corpus, rarest first.
Length filter: a block of too few words is out. Prefix filter: a block with enough of the template's words must hold one of
its size - needed + 1 rarest, so only blocks that do are candidates. Positional filter: from the first token that both
hold on, in that order, both must have `needed` tokens left; a block's tokens are those that any template holds, without which
it can't match. What is left is counted in full, so no matching block is missed. `filtered` tells how many blocks each
filter left.

Phrases are found where their words stand consecutively, by hash and then by their bytes.

Defined results: null or empty text: no words, no places, no labels, score 0. Words are compared after A-Z are put in
lower case. Places may overlap; every one counts. Repeated rows give one row each. An empty corpus gives no rows, and
frequencies of 0, which keep the templates' own order. Templates without words match nothing. Templates travel to the
executors, so there may be at most TEMPLATE_WORDS words in all of them; more raise ValueError. doc_id must be castable to
long; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import words as W
from tracewright.llm.shared import by_text, strings

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by which works state their license.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "apache-2.0-short": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-3.0-short": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "released under the mit license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "proprietary": "all rights reserved no part of this publication may be reproduced",
}


#: Words of all templates together, at most.
TEMPLATE_WORDS = 1 << 20


def _words_of(texts: list[str]) -> W.Words:
    return W.words(pa.array(texts, pa.string()), W.NOT_ALNUM)


@dataclass
class Templates:
    """vocabulary: sorted hashes of all templates' words. order: rank of each in the corpus, rarest first. sets: of each
    template its words, as places in vocabulary, in that order. needed: how many of them a block must hold. lengths: words of
    each template."""

    names: list[str]
    vocabulary: np.ndarray
    order: np.ndarray
    sets: list[np.ndarray]
    needed: list[int]
    lengths: list[int]

    @classmethod
    def build(cls, templates: dict[str, str], frequencies: dict[int, int], threshold: float) -> Templates:
        names = sorted(templates)
        found = _words_of([templates[x] for x in names])
        hashes, lengths = found.hashes(), found.counts().tolist()
        if len(hashes) > TEMPLATE_WORDS:
            raise ValueError(f"templates of {len(hashes)} words; {TEMPLATE_WORDS} at most")
        vocabulary = np.unique(hashes)
        often = np.array([frequencies.get(int(h), 0) for h in vocabulary.view(np.int64)], np.int64)
        order = np.empty(len(vocabulary), np.int64)
        order[np.lexsort((vocabulary, often))] = np.arange(len(vocabulary))
        sets = []
        for i in range(len(names)):
            own = np.unique(np.searchsorted(vocabulary, hashes[found.doc == i]))
            sets.append(own[np.argsort(order[own])])
        return cls(names, vocabulary, order, sets, [max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in sets], lengths)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def matches(self, found: W.Words, tally: Counter | None = None) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, words, containment) of each matching block. tally counts what each filter left."""
        tally = Counter() if tally is None else tally
        place, counts, first = self.places(found.hashes()), found.counts(), found.first()
        known = np.flatnonzero(place >= 0)
        if not len(known):
            return []
        doc, rank = found.doc[known], self.order[place[known]]
        inside = known - first[doc]
        out = []
        for t, (own, step) in enumerate(zip(self.sets, self.lengths)):
            size, needed = len(own), self.needed[t]
            if not size:
                continue
            place_in = np.full(len(self.vocabulary), size)
            place_in[self.order[own]] = np.arange(size)
            # texts with no word of the prefix hold no candidate
            prefix = place_in[rank] < size - needed + 1
            some = np.isin(doc, doc[prefix])
            keys, tokens = self._blocks(doc[some], inside[some], rank[some], counts, step)
            if not len(keys):
                continue
            # blocks' distinct tokens, rarest first; `left`: how many the block has from each on
            blocks, start, n = np.unique(keys, return_index=True, return_counts=True)
            block = np.repeat(np.arange(len(blocks)), n)
            left = n[block] - (np.arange(len(keys)) - start[block])
            common = place_in[tokens] < size
            earliest = np.full(len(blocks), len(keys))
            np.minimum.at(earliest, block[common], np.flatnonzero(common))
            hit = earliest < len(keys)
            at = np.minimum(earliest, len(keys) - 1)
            width = int(inside[some].max()) // step + 2
            length = np.minimum(counts[blocks // width] - blocks % width * step, 2 * step)
            long_enough = hit & (length >= needed)
            by_prefix = long_enough & (place_in[tokens[at]] < size - needed + 1)
            by_place = by_prefix & (left[at] >= needed)
            shared = np.bincount(block[common], minlength=len(blocks))
            matched = by_place & (shared >= needed)
            for name, kept in (("blocks", hit), ("length", long_enough), ("prefix", by_prefix), ("position", by_place), ("matched", matched)):
                tally[name] += int(kept.sum())
            for k in np.flatnonzero(matched).tolist():
                out.append((int(blocks[k] // width), t, int(blocks[k] % width) * step, int(length[k]), int(shared[k]) / size))
        return out

    @staticmethod
    def _blocks(doc: np.ndarray, inside: np.ndarray, rank: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, token) of the distinct tokens of each block of 2 * step words, in this order. A word stands in the block
        that starts at or before it, and in the one before unless it is in the first half step."""
        keys, tokens, width = [], [], int(inside.max(initial=0)) // step + 2
        for back in range(2):
            number = inside // step - back
            own = (number >= 0) & ((number == 0) | (counts[doc] > (number + 1) * step))
            keys.append(doc[own] * width + number[own])
            tokens.append(rank[own])
        keys, tokens = np.concatenate(keys), np.concatenate(tokens)
        order = np.lexsort((tokens, keys))
        keys, tokens = keys[order], tokens[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])
        return keys[new], tokens[new]


def phrase_places(found: W.Words, phrase: str) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word from 0) of each place of the phrase."""
    parts = phrase.split(" ")
    want, hashes = _words_of(parts).hashes(), found.hashes()
    n = len(hashes) - len(parts) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hit = found.doc[:n] == found.doc[len(parts) - 1 :]
    for k in range(len(parts)):
        hit &= hashes[k : k + n] == want[k]
    at = np.flatnonzero(hit)
    at = np.array([i for i in at.tolist() if all(found.data[found.starts[i + k] : found.ends[i + k]].tobytes() == p.encode() for k, p in enumerate(parts))], dtype=np.int64)
    return found.doc[at], at - found.first()[found.doc[at]]


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[int, int]:
    """In how many documents of the corpus each of the templates' words stands, by the word's hash."""
    bare = Templates.build(templates, {}, 1.0)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = W.words(strings(batch.column("text")), W.NOT_ALNUM)
        place = bare.places(found.hashes())
        pairs = np.unique(found.doc[place >= 0] * len(bare.vocabulary) + place[place >= 0])
        return pa.record_batch({"place": pa.array(np.arange(len(bare.vocabulary))), "n": pa.array(np.bincount(pairs % len(bare.vocabulary), minlength=len(bare.vocabulary)))})

    if not len(bare.vocabulary):
        return {}
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: by_text(batches, "text", work), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {int(bare.vocabulary.view(np.int64)[r["place"]]): r["n"] for r in rows}


SCHEMA = "doc_id long, n_words long, places array<struct<label: string, word: long>>, blocks array<struct<template: string, word: long, words: long, containment: double>>"


def filtered(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """(filter, blocks): how many pairs of block and template hold a common word (`blocks`), and how many each filter left."""
    docs, templates = docs.select(F.col("text").cast("string").alias("text")), TEMPLATES if templates is None else templates
    built = Templates.build(templates, frequencies(docs, templates), threshold)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tally: Counter = Counter()
        built.matches(W.words(strings(batch.column("text")), W.NOT_ALNUM), tally)
        return pa.record_batch({"filter": pa.array(list(tally), pa.string()), "blocks": pa.array(list(tally.values()), pa.int64())})

    rows = docs.mapInArrow(lambda batches: by_text(batches, "text", work), "filter string, blocks long")
    return rows.groupBy("filter").agg(F.sum("blocks").alias("blocks"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Of docs (doc_id, text): n_words, places (label, first word) of the phrases, blocks (template, first word, words,
    containment) that match the templates."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    built = Templates.build(templates, frequencies(docs, templates), threshold)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_type = pa.list_(pa.struct([("template", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = W.words(strings(batch.column("text")), W.NOT_ALNUM)
        places: list[list] = [[] for _ in range(batch.num_rows)]
        blocks: list[list] = [[] for _ in range(batch.num_rows)]
        for phrase, label in phrases.items():
            for doc, word in zip(*(x.tolist() for x in phrase_places(found, phrase))):
                places[doc].append({"label": label, "word": word})
        for doc, t, word, n, share in built.matches(found):
            blocks[doc].append({"template": built.names[t], "word": word, "words": n, "containment": share})
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(found.counts()), "places": pa.array(places, place_type), "blocks": pa.array(blocks, block_type)})

    return docs.mapInArrow(lambda batches: by_text(batches, "text", work), SCHEMA)
