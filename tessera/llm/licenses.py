"""License scan with a positional index of rare words.

The index holds, for each word of the templates, its postings (template, position). How rare a word is comes from its
document frequency over the whole corpus, counted for the words of the templates only, so what is gathered has a fixed
bound. For each template whose key phrases all stand in a file, the words of these and the RAREST other ones of the
template's words that the file holds are looked up; each place of such a word votes for the template's start
(place in the file less position in the template) of each of its postings, and words that agree on a start are an
intersection of postings by relative position. A start with enough different words is verified: all mandatory key
phrases must stand within the template's reach, and the share of the template's words found there must be MIN_SHARE.

A file without the words of any template's key phrases can't be verified and is not looked up.

Defined results: a null text counts as empty; null and repeated doc_ids pass through; other columns are ignored; an
empty table gives an empty result. Labels are distinct and sorted; ties between templates keep all that verify.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, pieces

#: phrases counted on their own, and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, notice, mandatory key phrases
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ["in compliance with the license", "apache license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license", "free software foundation", "version 3"]),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license", "free software foundation", "version 2"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("mit-license", "Released under the MIT License.", ["mit license", "released under the"]),
    ("mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee is hereby granted", "this permission notice appear in all copies"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
]
RAREST, MIN_SHARE, SLACK = 8, 0.7, 8

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


class Index:
    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1]) for t in templates]
        self.keys = [[b" ".join(words_of(k)) for k in t[2]] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for p, w in enumerate(words):
                self.postings[w].append((t, p))
        #: words of which a verified file holds at least one
        self.needed = {max(words_of(k.decode()), key=len) for keys in self.keys for k in keys}


@lru_cache(1)
def index() -> Index:
    return Index()


def word_rarity(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all documents."""

    def run(batches):
        vocabulary, n, counts = set(index().postings), 0, defaultdict(int)
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                for text in texts:
                    n += 1
                    for w in vocabulary.intersection(words_of(text)):
                        counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *counts], pa.binary()), "n": pa.array([n, *counts.values()], pa.int64())})

    parts = mapped(docs.select(F.col(text_col).alias("text")), run, "word binary, n bigint")
    found = {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the templates' words at most
    total = found.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in index().postings}


def phrase_places(words: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase's words stand one after the other; joined is the words with a blank around each."""
    out, at, counted, n = [], -1, 0, 0
    needle = b" " + phrase + b" "
    while (at := joined.find(needle, at + 1)) >= 0:
        n += joined.count(b" ", counted, at + 1)
        counted = at + 1
        out.append(n - 1)
    return out


def method_labels(words: list[bytes], rarity: dict[bytes, float]) -> dict[str, float]:
    """Label to share of the template found, for all templates that verify."""
    found = index()
    present = set(words)
    if present.isdisjoint(found.needed):
        return {}
    joined = b" " + b" ".join(words) + b" "
    chosen: dict[int, set[bytes]] = {}
    for t, keys in enumerate(found.keys):
        if all(b" " + k + b" " in joined for k in keys):
            own = {w for k in keys for w in k.split()}
            rare = sorted((w for w in present.intersection(found.words[t]) - own if w in rarity), key=lambda w: (-rarity[w], w))[:RAREST]
            chosen[t] = own.union(rare)
    looked_up = set().union(*chosen.values())
    votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
    for place, w in enumerate(words):
        if w in looked_up:
            for t, p in found.postings[w]:
                if t in chosen and w in chosen[t]:
                    votes[t, place - p].add(w)
    out: dict[str, float] = {}
    for (t, start), by in votes.items():
        template = found.words[t]
        if len(by) < min(2, len(set(template) & chosen[t])) or out.get(found.labels[t], 0) >= 1:
            continue
        window = words[max(0, start - SLACK) : start + len(template) + SLACK]
        text = b" " + b" ".join(window) + b" "
        if not all(b" " + k + b" " in text for k in found.keys[t]):
            continue
        left, hit = defaultdict(int), 0
        for w in window:
            left[w] += 1
        for w in template:
            if left[w]:
                left[w] -= 1
                hit += 1
        share = hit / len(template)
        if share >= MIN_SHARE:
            out[found.labels[t]] = max(share, out.get(found.labels[t], 0))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score is 1 where a phrase
    stands, else the largest share of a template that verifies, else 0."""
    rarity = word_rarity(docs, text_col)
    phrases = {k.encode(): v for k, v in PHRASES.items()}

    def one(text):
        words = words_of(text)
        places, base = [], set()
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in phrases.items():
            if phrase in joined and (at := phrase_places(words, joined, phrase)):
                places += at
                base.add(label)
        more = method_labels(words, rarity)
        score = 1.0 if base else max(more.values(), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(more))), score

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            for first, texts in pieces(batch, "text"):
                cols = list(zip(*map(one, texts)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
