"""Licence scans: phrases, and templates found by a positional index of their rarest words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.common import bounded_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "mit": "the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Label, a passage of the licence or of its notice, phrases without which the passage isn't that licence's.
PASSAGES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ["permission is hereby granted free of charge", "sublicense"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license version 2 0"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["apache license version 2 0", "terms and conditions for use reproduction and distribution"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ["gnu general public license version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", ["gnu general public license version 2"]),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License", ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ["gnu lesser general public license", "version 2 1"]),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license", "version 3"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ["redistributions of source code must retain", "following disclaimer"]),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["mozilla public license v 2 0"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ["eclipse public license 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ["person or organization obtaining a copy"]),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["creative commons attribution noderivatives"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication", ["waived all copyright", "cc0"]),
]

#: Identifiers of the SPDX list by label; those of three words or more also count without the tag before them.
IDENTIFIERS = {
    "mit": ["MIT"],
    "apache-2": ["Apache-2.0"],
    "gpl-3": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"],
    "gpl-2": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"],
    "lgpl-3": ["LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0"],
    "lgpl-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1"],
    "agpl-3": ["AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "isc": ["ISC"],
    "mpl-2": ["MPL-2.0"],
    "epl-2": ["EPL-2.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["Zlib"],
    "bsl-1": ["BSL-1.0"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-nd": ["CC-BY-ND-4.0"],
    "cc0": ["CC0-1.0"],
}

#: Words by which a match may be shifted within any passage, and one more for each so many of its words, as comment marks are words; share of a passage's rare words that have to agree.
SHIFT, WORDS_A_SHIFT, AGREE = 2, 5, 0.6


def words(text: str | None) -> list[str]:
    """The text's words, A-Z lower-cased."""
    return WORD.findall(text.translate(_UPPER)) if text else []


def templates() -> list[tuple[str, str, list[str]]]:
    """PASSAGES and what follows from IDENTIFIERS: the tagged identifier and, if long enough, the bare one, which is its own key phrase."""
    tagged = [(label, f"SPDX-License-Identifier: {i}", [f"license identifier {i}"]) for label, ids in IDENTIFIERS.items() for i in ids]
    return [*PASSAGES, *tagged, *((label, i, [i]) for label, ids in IDENTIFIERS.items() for i in ids if len(words(i)) >= 3)]


TEMPLATES = templates()


def places(ws: list[str], phrase: list[str]) -> list[int]:
    """Where the words of phrase stand consecutively, overlaps included."""
    out, at, k = [], -1, len(phrase)
    try:
        while True:
            at = ws.index(phrase[0], at + 1)
            if ws[at : at + k] == phrase:
                out.append(at)
    except ValueError:
        return out


def stands(ws: list[str], phrase: list[str]) -> bool:
    """Whether the words of phrase stand in order, with one other word between them for each five of its words at most."""
    for start in (i for i, w in enumerate(ws) if w == phrase[0]):
        left, k = len(phrase) // WORDS_A_SHIFT, 1
        for w in ws[start + 1 :]:
            if k < len(phrase) and w == phrase[k]:
                k += 1
            elif k == len(phrase) or left == 0:
                break
            else:
                left -= 1
        if k == len(phrase):
            return True
    return False


class Index:
    """Postings (template, position) of the templates' rare words, with the words' IDF over the templates.

    A template's rare words are the half of its places with the highest IDF. A match has AGREE
    of them, so any (1 - AGREE) of them and one hold a word of every match: only that many, of
    highest IDF, are looked up. Nothing is capped.
    """

    def __init__(self, given: list[tuple[str, str, list[str]]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.labels = [t[0] for t in given]
        self.texts = [words(t[1]) for t in given]
        self.keys = [[words(p) for p in t[2]] for t in given]
        self.phrases = {label: words(p) for label, p in phrases.items()}
        seen = Counter(w for t in self.texts for w in set(t))
        self.idf = {w: math.log(len(given) / n) for w, n in seen.items()}
        self.anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.rare: list[dict[str, list[int]]] = []
        self.need: list[int] = []
        for k, t in enumerate(self.texts):
            order = sorted(range(len(t)), key=lambda p, t=t: (-self.idf[t[p]], p))[: -(-len(t) // 2)]
            self.need.append(math.ceil(AGREE * len(order)))
            places_of = defaultdict(list)
            for p in sorted(order):
                places_of[t[p]].append(p)
            self.rare.append(dict(places_of))
            for p in order[: len(order) - self.need[-1] + 1]:
                self.anchors[t[p]].append((k, p))
        self.size = [sum(map(len, r.values())) for r in self.rare]
        self.shift = [SHIFT + len(t) // WORDS_A_SHIFT for t in self.texts]
        self.vocabulary = frozenset(self.anchors)
        self.rare_words = frozenset(w for r in self.rare for w in r)

    def agreement(self, k: int, ws: list[str], offsets: dict[int, set[int]]) -> float:
        """The largest share of template k's rare words that agree within its shift where its key phrases stand; 0 below AGREE.

        ``offsets`` has the rare places found by their relative position, text less template.
        """
        best, shift = 0.0, self.shift[k]
        for o in sorted(offsets):
            agree: set[int] = set().union(*(offsets[o + d] for d in range(shift + 1) if o + d in offsets))
            share = len(agree) / self.size[k]
            if len(agree) < self.need[k] or share <= best:
                continue
            window = ws[max(0, o) : max(0, o + len(self.texts[k]) + shift)]
            if all(stands(window, key) for key in self.keys[k]):
                best = share
        return best

    def matches(self, ws: list[str], present: frozenset | set) -> dict[str, float]:
        """Labels of the templates found, with the largest share of rare words that agree in position.

        The file's licence words are looked up from the highest IDF down; each place where one
        stands gives relative positions, around which the template's postings are intersected.
        """
        seen = self.rare_words.intersection(ws)
        likely = {k for k in {k for w in present for k, _ in self.anchors[w]} if sum(len(self.rare[k][w]) for w in seen.intersection(self.rare[k])) >= self.need[k]}
        if not likely:
            return {}
        at_of: dict[str, list[int]] = defaultdict(list)
        for at, w in enumerate(ws):
            if w in seen:
                at_of[w].append(at)
        near: dict[int, set[int]] = defaultdict(set)
        for w in sorted(present, key=lambda w: (-self.idf[w], w)):
            for k, p in self.anchors[w]:
                if k in likely:
                    near[k].update(at - p for at in at_of[w])
        out: dict[str, float] = {}
        for k, starts in near.items():
            wanted = set().union(*(range(o - self.shift[k], o + self.shift[k] + 1) for o in starts))
            offsets: dict[int, set[int]] = defaultdict(set)
            for w, ps in self.rare[k].items():
                for at in at_of.get(w, ()):
                    for p in ps:
                        if at - p in wanted:
                            offsets[at - p].add(p)
            share = self.agreement(k, ws, offsets)
            if share > out.get(self.labels[k], 0.0):
                out[self.labels[k]] = share
        return out

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a whole text."""
        ws = words(text)
        present = self.vocabulary.intersection(ws)
        base = {label: places(ws, p) for label, p in self.phrases.items()}
        found = {label: 1.0 for label, at in base.items() if at}
        starts = [s for at in base.values() for s in at]
        if present:
            for label, share in self.matches(ws, present).items():
                found[label] = max(found.get(label, 0.0), share)
        names = sorted(label for label, at in base.items() if at)
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(sorted(found)), max(found.values(), default=0.0)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    Each file's licence words of highest IDF are looked up in the index; postings that agree in
    relative position make a candidate, which counts if its key phrases stand in its window.
    Base phrases always count, with score 1. Texts are read whole however long. A null text is
    empty: no word, empty labels, score 0. Places that overlap count each, and so do repeated
    rows; other columns are ignored whatever their names; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for b in batches:
            rows = [index.scan(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
