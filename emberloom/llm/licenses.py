"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Templates are whole public licence texts (the files of `licence_texts`), the standard
headers of source files and short notices. Words are lower-cased runs of letters and
digits; weights are count times ln((1 + N) / (1 + df)) + 1 over the N templates, so
words in no template have the largest idf. Three kinds of unit of a text are compared
with the templates by cosine of these sparse vectors: the whole text, each line, and
with `windows` (as in the query) every run of as many words as a template of at most
WINDOW_WORDS has, across line breaks, comment marks and within longer lines.

A unit matches where its cosine is at least `threshold`. A text's licence is that of
its best match: templates of LONG_WORDS words or more (texts and headers) go before
notices, which licence texts may quote; then the larger cosine (to nine digits), then
the smaller name. The squared cosine of a unit is at most the share of a template's
squared weights that lies in words of the unit. So a text's distinct words tell which
templates any of its units can match at all, most often none, and units that lack a
template's heaviest words are passed over; neither changes a result.

A file without a licence of its own inherits from the nearest ancestor directory
that holds a licence file (its own directory first): the distinct directories are
expanded to their ancestors, at most their depth each, and equi-joined.

Defined results: null and empty texts have no licence of their own; a null path
inherits nothing; of several licence files in one directory the largest cosine counts, then
the smaller path; repeated rows are each reported; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stage_table

# Headers of source files and notices of public licences.
NOTICES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
THRESHOLD, LONG_WORDS, WINDOW_WORDS = 0.8, 30, 250
LICENCE_FILE = r"^(?i)(LICEN[SC]E|COPYING)([-._].*)?$"

_WORD = re.compile(r"[^\W_]+")


@cache
def licence_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files of licence_texts, by name."""
    files = sorted((f.name, f.read_text("utf-8")) for f in (resources.files(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt"))
    return [(name.removesuffix(".txt"), text) for name, text in files]


def templates() -> list[tuple[str, str]]:
    return licence_texts() + NOTICES


class Matcher:
    def __init__(self, given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD):
        self.threshold = threshold
        bags = [(name, Counter(_WORD.findall(text.lower()))) for name, text in given or templates()]
        df = Counter(w for _, bag in bags for w in bag)
        self.unknown = math.log(1 + len(bags)) + 1
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
        self.vectors = []  # (licence, words, unit vector, the words that a unit needs one of)
        for name, bag in bags:
            v = {w: n * self.idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, sum(bag.values()), {w: x / norm for w, x in v.items()}, set()))
        self.least = (threshold - 1e-6) ** 2
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, _, v, needed) in enumerate(self.vectors):
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda e: (-e[1], e[0])):
                self.index.setdefault(w, []).append((k, x * x))
                if rest >= self.least:  # the heaviest words, until all others are too light
                    needed.add(w)
                    rest -= x * x

    def able(self, words: set[str]) -> list[int]:
        """The templates that a unit of these distinct words may match."""
        mass: Counter = Counter()
        for w in words & self.index.keys():
            for k, x in self.index[w]:
                mass[k] += x
        return [k for k, x in mass.items() if x >= self.least]

    def best(self, words: list[str], able: list[int]) -> tuple[bool, float, str] | None:
        """(no notice but a text or header, cosine, licence) of a unit's best match."""
        bag, best, norm = None, None, 0.0
        for k in able:
            name, size, t, needed = self.vectors[k]
            if needed.isdisjoint(words):
                continue
            if bag is None:
                bag = Counter(words)
                v = {w: n * self.idf.get(w, self.unknown) for w, n in bag.items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
            few, many = (v, t) if len(v) < len(t) else (t, v)
            score = sum(x * many[w] for w, x in few.items() if w in many) / norm
            if score >= self.threshold:
                best = self.better(best, (size >= LONG_WORDS, round(min(score, 1.0), 9), name))
        return best

    @staticmethod
    def better(a, b):
        """The better of two matches, either of which may be None."""
        if a is None or b is None:
            return a or b
        return min(a, b, key=lambda m: (not m[0], -m[1], m[2]))

    def windows(self, words: list[str], able: list[int]) -> tuple[bool, float, str] | None:
        """The best match among all runs of words of a template's length."""
        weigh = [self.idf.get(w, self.unknown) for w in words]
        best = None
        for k in able:
            name, length, t, needed = self.vectors[k]
            if length > WINDOW_WORDS:
                continue
            size, done = min(length, len(words)), 0
            spans: list[list[int]] = []  # of starts: only windows with a needed word can reach the threshold
            for at in (i for i, w in enumerate(words) if w in needed):
                a, done = max(done, at - size + 1), max(done, min(at, len(words) - size) + 1)
                if a < done:
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = done
                    else:
                        spans.append([a, done])
            for a, b in spans:
                bag, dot, norm = Counter(), 0.0, 0.0
                for i in range(a, b + size - 1):
                    w, x = words[i], weigh[i]
                    norm += x * x * (2 * bag[w] + 1)
                    bag[w] += 1
                    dot += x * t.get(w, 0.0)
                    if i - a >= size:
                        w, x = words[i - size], weigh[i - size]
                        bag[w] -= 1
                        norm -= x * x * (2 * bag[w] + 1)
                        dot -= x * t.get(w, 0.0)
                    if i - a >= size - 1 and dot > 0 and dot * dot >= (self.threshold - 1e-6) ** 2 * norm:
                        got = round(min(dot / math.sqrt(norm), 1.0), 9)
                        if got >= self.threshold:
                            best = self.better(best, (length >= LONG_WORDS, got, name))
        return best

    def text(self, text: str | None, windows: bool = False) -> tuple[float, str] | None:
        """(cosine, licence) of a text."""
        text = (text or "").lower()
        words = _WORD.findall(text)
        able = self.able(set(words))
        if not able:
            return None
        best = self.best(words, able)
        for line in text.split("\n"):
            best = self.better(best, self.best(_WORD.findall(line), able))
        if windows:
            best = self.better(best, self.windows(words, able))
        return best and best[1:]


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", given: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """One row per row of files: id, path, license, score, origin (own, inherited or none), from_path."""
    matcher = Matcher(given, threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [matcher.text(t, windows) or (None, None) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "path": pdf["path"], "license": [g[1] for g in got], "score": pd.array([g[0] for g in got], "Float64")})

    src = files.select(column(id_col).cast("string").alias("id"), column(path_col).cast("string").alias("path"), column(text_col).cast("string").alias("text"))
    own = src.mapInPandas(run, "id string, path string, license string, score double")
    own = stage_table(own.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "licenses")  # read three times

    name = F.regexp_extract("path", "([^/]*)$", 1)
    held = own.filter(F.col("license").isNotNull() & name.rlike(LICENCE_FILE))
    best = held.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best"))

    dirs = own.filter("license IS NULL AND path IS NOT NULL").select("dir").distinct()
    up = dirs.select("dir", F.split("dir", "/").alias("parts")).select("dir", F.explode(F.expr("transform(sequence(0, size(parts)), n -> struct(n AS depth, array_join(slice(parts, 1, n), '/') AS at))")).alias("up"))
    up = up.select("dir", "up.depth", F.col("up.at").alias("at")).join(best.withColumnRenamed("dir", "at"), "at")
    nearest = up.groupBy("dir").agg(F.max_by("best", "depth").alias("near"))

    out = own.join(nearest, "dir", "left").withColumn("near", F.when(F.col("license").isNull() & F.col("path").isNotNull(), F.col("near")))
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("id").cast("long").alias(id_col),
        F.col("path").alias(path_col),
        F.coalesce("license", "near.license").alias("license"),
        F.coalesce("score", -F.col("near.s")).alias("score"),
        origin.alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("near.path")).alias("from_path"),
    )
