"""Operator 13 - licence scan by a positional rare-token index.

The index holds, for each licence template, the places of its rarest words: those with the
highest inverse document frequency, counted over all given documents. A file looks up its words
there; an occurrence at word p of a template's word q votes for relative position p - q. Votes of
one template whose positions differ by no more than its slack stand together, and such a place is
a candidate if most of the template's indexed words voted in it. It is accepted if the template's
mandatory key phrases stand there, word by word, at the relative positions the template has them.
Of accepted places in one another only the fuller one is kept.

All of a file's words are looked up and every place is followed up; frequent words cost nothing,
as the index does not hold them. Two narrow passes over the texts: the first counts, each task
sending one row a licence word at most, the second looks up.

Fixed phrases (``PHRASES``) are found beside the templates, with labels of their own.

Defined results: null texts are empty, which have no words and score 0; repeated rows are scanned
each; a null id stays; an empty table gives no rows; texts may have any length; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}

# Phrases of the base scan and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence notices and texts as their authors publish them, in words, with the phrases that must be there.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("lgpl-3.0", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu lesser general public license", "version 3 of the license")),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license", "version 2 1 of the license")),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license", "version 3 of the license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "neither the name of", "endorse or promote products derived from this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("in no event will the authors be held liable", "alter it and redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "released under the cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)

# Identifiers that follow "SPDX-License-Identifier".
IDENTIFIERS = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib Unlicense BSL-1.0 EPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0".split()

#: Rarest words of a template in the index, share of their places that must vote, words that may
#: be put in or left out for each 10 words of a template, score of a phrase alone.
RARE, SHARE, LOOSE, PHRASE_SCORE = 12, 0.6, 2, 0.5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOW))


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # mandatory phrases and where the template has them

    @property
    def slack(self) -> int:
        return 1 + LOOSE * len(self.words) // 10


def _at(words: list[str] | tuple[str, ...], phrase: tuple[str, ...]) -> int:
    return next(i for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase)


def templates() -> list[Template]:
    own = [(label, text, keys) for label, text, keys in TEMPLATES]
    for name in IDENTIFIERS:
        line = " ".join(words_of(f"SPDX-License-Identifier: {name}"))
        own.append((name.lower(), line, (line,)))
    out = []
    for k, (label, text, keys) in enumerate(own):
        words = tuple(text.split())
        out.append(Template(f"{label}#{k}", label, words, tuple((_at(words, tuple(p.split())), tuple(p.split())) for p in keys)))
    return out


def document_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """How many documents hold each word of the vocabulary, and how many there are: one pass, in
    which a task sends one row a word at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for b in batches:
            held[""] += len(b)
            for t in b["text"]:
                held.update(vocabulary.intersection(words_of(t)))
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": list(held.values())})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}
    return found, found.pop("", 0)


@dataclass(frozen=True)
class Index:
    """word -> its (template, place) postings; template -> indexed places; words worth a look."""

    known: tuple[Template, ...]
    postings: dict[str, tuple[tuple[int, int], ...]]
    places: tuple[int, ...]
    watched: frozenset[str]


def build_index(known: list[Template], counts: dict[str, int], total: int, rare: int = RARE) -> Index:
    """Postings of the ``rare`` words with the highest inverse document frequency of each template,
    ties by word."""
    idf = lambda w: math.log((total + 1) / (counts.get(w, 0) + 1))
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    places = []
    for t, one in enumerate(known):
        chosen = set(sorted(set(one.words), key=lambda w: (-idf(w), w))[:rare])
        spots = [(w, q) for q, w in enumerate(one.words) if w in chosen]
        places.append(len(spots))
        for w, q in spots:
            postings[w].append((t, q))
    return Index(tuple(known), {w: tuple(p) for w, p in postings.items()}, tuple(places), frozenset(postings) | {p.split()[0] for p, _ in PHRASES})


def _candidates(index: Index, spots: dict[str, list[int]]) -> Iterator[tuple[int, int, int, float]]:
    """(template, lowest and highest relative position, share of its places that voted)."""
    by_template: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for w in spots:
        for t, q in index.postings.get(w, ()):
            by_template[t].append((q, w))
    for t, found in by_template.items():
        if len(found) < SHARE * index.places[t]:
            continue
        shift = np.concatenate([np.array(spots[w], dtype=np.int64) - q for q, w in found])
        place = np.concatenate([np.full(len(spots[w]), q) for q, w in found])
        order = np.lexsort((place, shift))
        shift, place = shift[order], place[order]
        first = np.flatnonzero(np.diff(shift, prepend=shift[0] - index.known[t].slack - 1) > index.known[t].slack)
        last = np.append(first[1:], len(shift))
        for a, b in zip(first[last - first >= SHARE * index.places[t]], last[last - first >= SHARE * index.places[t]], strict=True):
            share = len(np.unique(place[a:b])) / index.places[t]
            if share >= SHARE:
                yield t, int(shift[a]), int(shift[b - 1]), share


def _verified(words: list[str], one: Template, low: int, high: int) -> tuple[int, int] | None:
    """Where the match begins and ends, if all key phrases stand within the slack of its relative positions."""
    starts = []
    for q, phrase in one.keys:
        size = len(phrase)
        reach = range(max(0, low - one.slack + q), min(len(words) - size, high + one.slack + q) + 1)
        at = next((i for i in reach if words[i] == phrase[0] and tuple(words[i : i + size]) == phrase), None)
        if at is None:
            return None
        starts.append((at, at + size))
    return min(max(0, low), min(s for s, _ in starts)), max(min(len(words), high + len(one.words)), max(e for _, e in starts))


def scan(index: Index, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, str, int, int, float]]]:
    """(words, base phrases (label, start), matches (label, template, begin, end, share)) of a text."""
    words = words_of(text)
    spots: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in index.watched:
            spots[w].append(i)
    base = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        base += [(label, i) for i in spots.get(parts[0], ()) if words[i : i + len(parts)] == parts]
    found = []
    for t, low, high, share in _candidates(index, spots):
        one = index.known[t]
        span = _verified(words, one, low, high)
        if span:
            found.append((one.label, one.name, *span, share, round(share * index.places[t])))
    found.sort(key=lambda m: (-m[5], m[2], m[1]))
    kept: list[tuple] = []
    for m in found:  # what lies within a match of more places says nothing new
        if not any(o[2] <= m[2] and m[3] <= o[3] for o in kept):
            kept.append(m)
    return len(words), base, [m[:5] for m in sorted(kept, key=lambda m: (m[2], m[1]))]


SCHEMA = "doc_id long, n_words long, base array<struct<label:string,start:long>>, matches array<struct<label:string,template:string,begin:long,end:long,share:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, base, matches) of every text: places of the fixed phrases and of accepted
    templates, in words from 0. The index of the templates is all that is broadcast."""
    known = known or templates()
    counts, total = document_counts(docs, text_col, frozenset(w for t in known for w in t.words))
    index = build_index(known, counts, total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scan(index, t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_words": [n for n, _, _ in rows],
                "base": [[{"label": x, "start": s} for x, s in base] for _, base, _ in rows],
                "matches": [[{"label": x, "template": t, "begin": s, "end": e, "share": c} for x, t, s, e, c in found] for _, _, found in rows],
            })

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, SCHEMA)


def joined_labels(*labels: Column) -> Column:
    """Distinct labels of arrays in order, by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")


def license_report(found: DataFrame) -> DataFrame:
    """A row's scan as counts, labels and a score: the largest share of an accepted template's
    indexed words, or ``PHRASE_SCORE`` where a fixed phrase stands, if that is more."""
    starts = F.transform("base", lambda x: x["start"])
    base, own = F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    phrase = F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0)
    best = F.array_max(F.transform("matches", lambda x: x["share"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(base, own).alias("labels"),
        F.greatest(phrase, F.coalesce(best, F.lit(0.0))).alias("score"),
        "matches",
    )
