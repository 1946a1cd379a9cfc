"""Operator 11: licence scans by matching statistics over a generalised suffix automaton of licence words.

Templates (notices and statements of known licences) and phrases go into one automaton of words. Each text streams through
it once: at every word the automaton knows the longest template passage that ends there, and where. Passages that can't be
made longer and have MIN_MATCH words or more are chained, template by template: a passage goes on where it follows an
earlier one in text and template alike, with at most MAX_GAP words between on either side, so that changed names, years and
words are bridged. A chain that covers enough of its template (all of a statement shorter than LONG words, else COVER of it)
is a span; of spans that overlap, those with less coverage go. Phrases are found on the way, wherever all their words stand
consecutively.

The automaton has the size of the templates, is made once in each worker and is bounded by MAX_WORDS; texts are one pass
without a shuffle, in memory that grows with one text. A text's open chains are bounded by MAX_GAP and a template's repeats,
so time is linear in its words.

Defined results: null and empty texts have no words, places or spans and score 0; repeated rows give equal rows; an empty
table an empty one; input columns that clash with output names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontamination import SuffixAutomaton, words_of
from corpusloom.session import ship, table

MIN_MATCH, MAX_GAP, LONG, COVER, MAX_WORDS = 3, 12, 16, 0.8, 1_000_000

# Phrases with their labels, and public licence notices and statements.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
        " or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this"
        " list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"
        " either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
        " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
        " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    ),
)


class LicenceAutomaton(SuffixAutomaton):
    """The automaton of templates and phrases, with the places of long passages in templates."""

    def __init__(self, templates, phrases):
        self.labels = [label for label, _ in templates]
        # All items are shorter than the window: the automaton then knows where whole ones end.
        super().__init__([(i, words_of(text)) for i, (_, text) in enumerate(templates)] + [(label, words_of(text)) for text, label in phrases], window=1 << 60)

    def _mark(self, coded) -> None:
        super()._mark(coded)
        self.sizes = {t: len(ids) for t, ids in coded if isinstance(t, int)}
        self.need = {t: n if n < LONG else int(np.ceil(COVER * n)) for t, n in self.sizes.items()}
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.len]
        for t, ids in coded:
            v = 0
            for i, c in enumerate(ids if isinstance(t, int) else (), 1):
                v = self.next[v][c]
                self.places[v].append((t, i))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[self.link[v]] >= MIN_MATCH:
                self.places[self.link[v]] += self.places[v]

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(word position, state, length): the longest passage that ends at each word that templates have.

        A (position, 0, 0) follows each run of such words.
        """
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        step, link, length = self.next, self.link, self.len
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            v = m = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in step[v]:
                    v = link[v]
                    m = length[v]
                if c in step[v]:
                    v = step[v][c]
                    m += 1
                yield i, v, m
            yield b, 0, 0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
        """Places of phrases (label, first word), and spans (label, first word, word after the last, covered, coverage)."""
        base, spans, was, long = [], [], 0, 0
        open_: dict[int, list[list[int]]] = {}
        for i, v, m in self.statistics(words):
            if m != long + 1 and long >= MIN_MATCH:
                self._chain(open_, spans, i, was, long)
            was, long = v, m
            u = self.above[v]
            while u > 0:
                base += [(item, i + 1 - k) for k, item in self.short[u] if k <= m and isinstance(item, str)]
                u = self.above[self.link[u]] if self.link[u] >= 0 else -1
        for t, chains in open_.items():
            self._close(t, chains, spans)
        return base, _best_spans(spans)

    def _chain(self, open_: dict[int, list[list[int]]], spans: list, end: int, state: int, size: int) -> None:
        """Add the passage of ``size`` words before ``end`` to the chains; each is [first word, end, end in template, covered]."""
        for t, place in self.places[state]:
            chains = open_.setdefault(t, [])
            self._close(t, [c for c in chains if end - size - c[1] > MAX_GAP], spans)
            chains[:] = [c for c in chains if end - size - c[1] <= MAX_GAP]
            best, gain = None, 0
            for c in chains:
                new = size - max(0, c[1] - (end - size), c[2] - (place - size))
                if new > 0 and end > c[1] and place > c[2] and place - size - c[2] <= MAX_GAP and c[3] + new > gain:
                    best, gain = c, c[3] + new
            if best is None:
                chains.append([end - size, end, place, size])
            else:
                best[1:] = [end, place, gain]

    def _close(self, t: int, chains: list[list[int]], spans: list) -> None:
        spans += [(self.labels[t], a, b, n, min(1.0, n / self.sizes[t])) for a, b, _, n in chains if n >= self.need[t]]


def _best_spans(spans: list) -> list[tuple[str, int, int, int, float]]:
    """Without spans that share words with one of higher coverage, or of equal coverage and more words."""
    out, group, end = [], [], -1
    for s in [*sorted(set(spans), key=lambda s: (s[1], s[2])), None]:
        if s is None or s[1] >= end:
            kept: list = []
            for x in sorted(group, key=lambda x: (-x[4], -x[3], x[1], x[0])):
                if all(x[2] <= y[1] or y[2] <= x[1] or x[3:] == y[3:] for y in kept):
                    kept.append(x)
            out += sorted(kept, key=lambda x: (x[1], x[0]))
            group, end = [], -1
        if s is not None:
            group.append(s)
            end = max(end, s[2])
    return out


@lru_cache(maxsize=2)
def automaton(templates: tuple, phrases: tuple) -> LicenceAutomaton:
    return LicenceAutomaton(templates, phrases)


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,first:long,last:long,covered:long,coverage:double>>"


def scan_licences(docs: DataFrame, text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, spans and score.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start (null without any),
    base_labels their sorted labels. A span is (label, first word, word after the last, covered template words, coverage).
    score: 1 with a phrase, else the highest coverage of a span, else 0.
    """
    if sum(len(words_of(t)) for _, t in templates) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} words")
    ship(docs.sparkSession)

    @F.pandas_udf(f"struct<{FOUND.replace(' long', ':long').replace('labels ', 'labels:').replace('spans ', 'spans:')}>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(templates, phrases)
        for texts in parts:
            rows = []
            for t in texts:
                words = words_of(t)
                base, spans = a.scan(words)
                at = [i for _, i in base]
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), sorted({x for x, _ in base}), [dict(zip(("label", "first", "last", "covered", "coverage"), s)) for s in spans]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "spans"])
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    own = [x.split()[0] for x in FOUND.split(", ") if " " in x]
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), scan.asNondeterministic()(F.col(text_col)).alias("__found"))
    score = F.when(F.col("__found.n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__found.spans", lambda x: x["coverage"])), F.lit(0.0)))
    return packed.select(*[F.col("__doc")[c].alias(c) for c in docs.columns if c not in (*own, "score")], *[F.col("__found")[c].alias(c) for c in own], score.alias("score"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda x: x["label"])))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans")
    )


QUERIES = {"op11_licences": op11_licences}
SQL: dict[str, str] = {}
