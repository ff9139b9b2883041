"""Licence scan: parts of a text against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised: A-Z lowered, ASCII characters that are neither letters nor digits are spaces, runs
of spaces are one. A part is a line, a paragraph of several lines, or the whole text. Dice is twice the number
of common bigrams (with their multiplicity) over the sum of both numbers. A part whose number of bigrams is too
small or too large to reach the threshold with a template is not compared with it. A template's rarer bigrams, of
which a part that reaches the threshold must hold at least one, are looked for first, all in one pass.

With windows, as in the query, every run of words is a part, in a line or across lines, so a notice inside a longer
line is found. Runs are scored around the bigrams that were found only, at every start, up to the length that can match.

A null or empty text has no match. Templates of one word have no bigram and can't match. Ties go to the template that
comes first by name. Repeated rows are judged each; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.bytebpe import texts

#: Notices and texts of well-known licences, a name may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))


def normal_lines(text: str) -> list[bytes]:
    return [b" ".join(line.split()) for line in text.encode("utf-8", "replace").translate(_TABLE).split(b"\n")]


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


class Scanner:
    """Matches of texts with templates (name, text) at a threshold over 0."""

    def __init__(self, templates=TEMPLATES, least: float = 0.8) -> None:
        import ahocorasick

        self.least, self.templates = least, []
        every = Counter()
        for name, text in sorted(templates):
            grams = bigrams(b" ".join(normal_lines(text)).split())
            if grams:
                self.templates.append((name, grams, ceil(grams.total() * least / (2 - least) - 1e-9), floor(grams.total() * (2 - least) / least + 1e-9)))
                every.update(grams.keys())
        self.low = min((t[2] for t in self.templates), default=0)
        self.high = max((t[3] for t in self.templates), default=-1)
        self.find = ahocorasick.Automaton()
        self.sought: dict[tuple[bytes, bytes], list[int]] = {}  # bigrams that are looked for, and whose they are
        for k, (_, grams, *_) in enumerate(self.templates):
            # a part at the threshold holds least / (2 - least) of the template; so many of the rest must be looked for
            spare = grams.total() - ceil(grams.total() * least / (2 - least) - 1e-9)
            for a, b in sorted(grams, key=lambda g: (every[g], -len(g[0] + g[1]), g)):
                self.find.add_word(f" {a.decode('latin-1')} {b.decode('latin-1')} ", True)
                self.sought.setdefault((a, b), []).append(k)
                spare -= grams[a, b]
                if spare < 0:
                    break
        self.find.make_automaton()

    def _match(self, words: list[bytes], out: dict[str, float]) -> None:
        n = len(words) - 1
        if not self.low <= n <= self.high:
            return
        own = None
        for name, grams, low, high in self.templates:
            if low <= n <= high:
                own = own or bigrams(words)
                value = dice(own, grams)
                if value >= self.least - 1e-12 and value > out.get(name, 0.0):
                    out[name] = value

    def _match_windows(self, words: list[bytes], out: dict[str, float]) -> None:
        """The best run of words anywhere, for each template that has a bigram it is looked for by.

        A run that reaches the threshold holds such a bigram, and the best run begins and ends with bigrams of the template.
        """
        grams = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        for at, g in enumerate(grams):
            for k in self.sought.get(g, ()):
                hits.setdefault(k, []).append(at)
        for k, places in hits.items():
            name, template, low, high = self.templates[k]
            total, done = template.total(), 0
            for at in places:
                first, done = max(at - high + 1, done), max(done, at + 1)  # runs from a start before are those of an earlier hit
                own = [i for i in range(first, min(at + high, len(grams))) if grams[i] in template]
                for nth, start in enumerate(own):
                    if start > at or len(own) - nth < low:
                        break
                    seen: Counter = Counter()
                    common = 0
                    for i in own[nth:]:
                        if i - start >= high:
                            break
                        seen[grams[i]] += 1
                        common += seen[grams[i]] <= template[grams[i]]
                        value = 2 * common / (i - start + 1 + total)
                        if value >= self.least - 1e-12 and value > out.get(name, 0.0):
                            out[name] = value

    def scan(self, text: str, windows: bool = False) -> dict[str, float]:
        """The best Dice coefficient of each licence that a part of the text matches, or with windows any run of words."""
        out: dict[str, float] = {}
        if not text or not self.templates:
            return out
        lines = normal_lines(text)
        # spaces for line ends: bigrams of paragraphs and of the whole text cross lines
        whole = f" {b' '.join(filter(None, lines)).decode('latin-1')} "
        if not any(True for _ in self.find.iter(whole)):
            return out
        if windows:  # parts are runs, too
            self._match_windows([w for line in lines if line for w in line.split(b" ")], out)
            return out
        paragraphs: list[list[bytes]] = [[]]
        for line in lines:
            if line:
                self._match(line.split(b" "), out)
                paragraphs[-1].append(line)
            elif paragraphs[-1]:
                paragraphs.append([])
        for lines_of in paragraphs:
            if len(lines_of) > 1:
                self._match([w for line in lines_of for w in line.split(b" ")], out)
        if len(paragraphs) > 1:
            self._match([w for p in paragraphs for line in p for w in line.split(b" ")], out)
        return out


@lru_cache(maxsize=4)
def _scanner(templates, least: float) -> Scanner:
    return Scanner(templates, least)


def scan_licences(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, key: str = "doc_id", windows: bool = False) -> DataFrame:
    """key, licence (the best match, null for none), dice, and matches: all licences found, as a map to their dice."""

    def run(batches):
        own = _scanner(templates, least)
        for batch in batches:
            for part, ts in texts(batch):
                found = [own.scan(t, windows) for t in ts]
                best = [min(m, key=lambda k: (-m[k], k)) if m else None for m in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best, pa.string()), pa.array([m[b] if b else None for m, b in zip(found, best, strict=True)], pa.float64()), pa.array([sorted(m.items()) for m in found], pa.map_(pa.string(), pa.float64()))],
                    [key, "licence", "dice", "matches"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, licence string, dice double, matches map<string,double>")


def op9_licence_scan(docs: DataFrame, windows: bool = False) -> DataFrame:
    """doc_id, licence, dice (9 decimals) and all licences found, joined by commas, of each row."""
    found = scan_licences(docs, windows=windows)
    return found.select("doc_id", "licence", F.round("dice", 9).alias("dice"), F.array_join(F.array_sort(F.map_keys("matches")), ",").alias("licences"))
