"""License scans over a positional index of rare template words.

The index holds, for each licence template, the positions of the share ``rare`` of its
words (four at least) that have the highest IDF, words that the corpus has before others,
and of equal ones the first by the alphabet; IDF comes from a count of all template words
over the whole corpus. A file's words are inverted, every indexed word is
looked up at all its places, and postings of a template that agree on the relative
position (file position minus template position) vote. For positions with ``votes`` votes
or more the template's mandatory key phrases must stand consecutively, each within
``near`` words of its place. The score is the largest share of a template's words that
stand at their places, so that notices with words changed, left out or added score less
than whole ones; a base phrase alone gives one half.

Base phrases are found on their own, everywhere in the text, and their labels stay.

Defined results: null or empty texts have no words, no labels and score 0; first_word
and last_word are null without base places; of several places of a template the one with
the largest share counts; repeated rows repeat results; an empty table gives no rows;
further columns are ignored; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, text_bytes
from .decontamination import Block, intersect, invert, term_counts
from .words import find_sorted, hash_words, split_words

# Base phrases with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

# Lines of licence notices (label, notice, mandatory key phrases of it).
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["permission is hereby granted free of charge", "without restriction including without limitation"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ["this permission notice shall be included"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license version 2 0", "in compliance with the license"]),
    ("gpl-3.0", "Licensed under the GNU General Public License version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "Licensed under the GNU General Public License version 2", ["gnu general public license version 2"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", ["without any warranty", "gnu general public license for more details"]),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "Licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ["anyone is free to copy modify publish use compile sell"]),
]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class Index:
    """Rare words of the templates and their positions."""

    def __init__(self, templates, base, counts: dict[str, float], rare: float):
        self.labels = [x[0] for x in templates]
        notices = [words_of(x[1]) for x in templates]
        self.terms = [hash_words(x) for x in notices]
        posts = []
        for t, own in enumerate(notices):
            ranked = sorted(set(own), key=lambda w: (not counts.get(w), counts.get(w, 0), w))
            for word in ranked[: max(4, round(rare * len(ranked)))]:
                posts += [(int(self.terms[t][p]), t, p) for p in range(len(own)) if own[p] == word]
        posts.sort()
        hashes = np.array([x[0] for x in posts], dtype=np.uint64)
        self.words, at = np.unique(hashes, return_index=True)
        self.at = np.append(at, len(posts))
        self.template = np.array([x[1] for x in posts], dtype=np.int64)
        self.place = np.array([x[2] for x in posts], dtype=np.int64)
        keys = [(t, words_of(phrase), notices[t]) for t, (_, _, phrases) in enumerate(templates) for phrase in phrases]
        self.key_template = [k[0] for k in keys]
        self.key_place = [next(i for i in range(len(k[2])) if k[2][i : i + len(k[1])] == k[1]) for k in keys]
        self.keys_of = [[k for k, x in enumerate(self.key_template) if x == t] for t in range(len(templates))]
        self.keys = Block(list(range(len(keys))), [" ".join(k[1]) for k in keys], 64)
        self.base = Block(list(range(len(base))), [x[1] for x in base], 64)
        self.base_labels = [x[0] for x in base]
        count = dict(zip(hash_words(list(counts)).tolist(), counts.values(), strict=True)) if counts else {}
        for block in (self.keys, self.base):
            block.order(np.array([count.get(h, 0) for h in block.vocabulary.tolist()], dtype=np.float64))


def _candidates(words, postings, index: Index, votes: int):
    """(document, template, diagonal) of places with enough agreeing postings."""
    at, found = find_sorted(postings.terms, index.words)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # places of the file's indexed words, each with all places that templates have for it
    n = postings.at[found + 1] - postings.at[found]
    place = postings.places[np.repeat(postings.at[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    word = np.repeat(at, n)
    k = index.at[word + 1] - index.at[word]
    post = np.repeat(index.at[word], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    place = np.repeat(place, k)
    # one number for each (document, template, diagonal)
    longest = max(len(t) for t in index.terms)
    span = len(words.hash) + longest
    key = (words.doc[place] * len(index.terms) + index.template[post]) * span + place - index.place[post] + longest
    key, count = np.unique(key, return_counts=True)
    group, diagonal = np.divmod(key[count >= votes], span)
    return np.stack([*np.divmod(group, len(index.terms)), diagonal - longest], axis=1)


def _stands(places: Sequence[int], at: int, near: int) -> bool:
    """Whether one of the ascending places lies within ``near`` of the given one."""
    i = bisect_left(places, at - near)
    return i < len(places) and places[i] <= at + near


def _scan(broadcast, votes: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        for part in chunks(batches, "text"):
            words = split_words(*text_bytes(part.column(1)))
            n_docs = part.num_rows
            base: dict[int, list] = {}
            postings = invert(words)
            w, s, *_ = intersect(postings, index.base, 0)
            for d, i, p in zip(words.doc[s].tolist(), index.base.item[w].tolist(), s.tolist(), strict=True):
                base.setdefault(d, []).append((p - int(words.first[d]), index.base_labels[i]))
            keyed: dict[tuple, list] = {}
            w, s, *_ = intersect(postings, index.keys, 0)
            order = np.argsort(s, kind="stable")
            w, s = w[order], s[order]
            for d, i, p in zip(words.doc[s].tolist(), index.keys.item[w].tolist(), s.tolist(), strict=True):
                keyed.setdefault((d, i), []).append(p)
            found: dict[int, dict] = {}
            for d, t, diagonal in _candidates(words, postings, index, votes).tolist():
                if not all(_stands(keyed.get((d, k), ()), diagonal + index.key_place[k], near) for k in index.keys_of[t]):
                    continue
                terms = index.terms[t]
                place = diagonal + np.arange(len(terms))
                inside = (place >= words.first[d]) & (place < words.first[d + 1])
                share = float((words.hash[place[inside]] == terms[inside]).sum() / len(terms))
                own = found.setdefault(d, {})
                own[index.labels[t]] = max(share, own.get(index.labels[t], 0.0))
            rows = []
            for d in range(n_docs):
                b, f = base.get(d, ()), found.get(d, {})
                own = sorted({x[1] for x in b})
                rows.append((len(b), min(b)[0] if b else None, max(b)[0] if b else None, ",".join(own), ",".join(sorted({*own, *f})), max([*f.values(), 0.5 if b else 0.0]), len(f)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.first).astype(np.int64)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates"])

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: float = 0.5, votes: int = 2, near: int = 10, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """One row per document with its base places, labels and score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    # the templates' own words, a fixed list
    every = sorted({w for x in [*templates, *base] for w in words_of(x[1])})
    hashes = hash_words(every)
    vocabulary = np.sort(hashes)
    found = term_counts(texts, vocabulary)
    counts = dict(zip(every, found[np.searchsorted(vocabulary, hashes)].tolist(), strict=True))
    index = Index(templates, base, counts, rare)
    return texts.mapInArrow(_scan(spark.sparkContext.broadcast(index), votes, near), SCHEMA)
