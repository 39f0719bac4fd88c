import math
import re
from collections import Counter

import pytest

from emberloom.llm.licenses import LICENCE_FILE, LONG_WORDS, THRESHOLD, WINDOW_WORDS, Matcher, licence_texts, scan_licenses, templates
from emberloom.llm.registry import op10_licenses


def words(x):
    return re.findall(r"[^\W_]+", x.lower())


DF = Counter(w for _, t in templates() for w in set(words(t)))


def vector(ws):
    return {w: n * (math.log((1 + len(templates())) / (1 + DF[w])) + 1) for w, n in Counter(ws).items()}


def length(v):
    return math.sqrt(sum(x * x for x in v.values()))


VECTORS = [(name, len(words(t)), vector(words(t))) for name, t in templates()]


def brute_text(text, windows=False):
    """Every unit against every template, without any shortcut."""
    ws = words(text or "")
    units = [(ws, None)] + [(words(line), None) for line in (text or "").split("\n")]
    if windows:
        units += [(ws[i : i + n], n) for n in {n for _, n, _ in VECTORS if n <= WINDOW_WORDS} for i in range(len(ws) - n + 1)]
    found = []
    for unit, only in units:
        v = vector(unit)
        for name, n, u in VECTORS:
            dot = sum(x * v.get(w, 0) for w, x in u.items()) if only in (None, n) else 0
            if dot and (s := min(1.0, dot / length(u) / length(v))) >= THRESHOLD:
                found.append((n < LONG_WORDS, -round(s, 9), name))
    return (-min(found)[1], min(found)[2]) if found else None


def brute(rows):
    own = [(i, p, brute_text(t)) for i, p, t in rows]
    held = {}
    for _, p, b in own:
        if p and b and re.match(LICENCE_FILE.replace("^(?i)", "(?i)^"), p.rpartition("/")[2]):
            d = p.rpartition("/")[0]
            held[d] = min(held.get(d, (0, "￿", "")), (-b[0], p, b[1]))
    out = []
    for i, p, b in own:
        if b:
            out.append((i, p, b[1], b[0], "own", p))
            continue
        d = p.rpartition("/")[0] if p is not None else None
        while d is not None and d not in held:
            d = d.rpartition("/")[0] if d else None
        out.append((i, p, held[d][2], -held[d][0], "inherited", held[d][1]) if d is not None else (i, p, None, None, "none", None))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.path, r.license, r.score and round(r.score, 9), r.origin, r.from_path) for r in df.collect()), key=str)


def test_query_same_as_brute_force(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = []
    for r in docs.collect():
        top, p, m = r.source, f"p{r.doc_id // 7 % 20}", f"m{r.doc_id // 11 % 10}"
        parts = [top, p, m]
        name = f"f{r.doc_id}.txt"
        if r.doc_id % 10 == 0:
            parts, name = parts[: 1 + r.doc_id // 10 % 3], f"LICENSE-{r.doc_id}"
        rows.append((r.doc_id, "/".join([*parts, name]), r.text))
    got = run(op10_licenses(spark, sf))
    assert got == brute(rows)
    assert {x[4] for x in got} == {"own", "inherited", "none"}


def test_edge_rows(spark):
    mit, gpl = "Released under the MIT License.", "licensed under the gnu general public license version 3 this work is"
    rows = [(1, "LICENSE", mit), (2, "a/b/x.py", "code"), (3, "a/LICENSE.txt", gpl), (4, "/abs/y", None), (5, None, ""), (6, None, mit), (None, "a/z", ""), (7, "a/b/c/d", "x\nAll rights reserved\n"), (7, "a/b/c/d", "x\nAll rights reserved\n"), (8, "q", "word " * 60_000), (9, "a/COPYING", gpl + " and more and more words here to be less alike"), (10, "a/LICENSED.md", mit)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, path string, text string, license string")
    assert run(scan_licenses(df)) == brute(rows)
    assert scan_licenses(df.limit(0)).collect() == []


GPL_HEADER = """/*
 * frob.c - frobs.
 * Copyright (C) 2021  A. Person
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
int main(void) { return 0; }
"""
ASF_HEADER = """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
import os
"""
OWN = dict(licence_texts())
MIT_LINE = " ".join(OWN["MIT"].split("\n\n")[2].split())
KNOWN = {
    "BSD-3-Clause": OWN["BSD-3-Clause"].replace("<year>, <owner>", "2019, The Frob Authors"),
    "BSD-2-Clause": "// " + OWN["BSD-2-Clause"].replace("<year>, <owner>", "2019 Frob, Inc.").replace("\n", "\n// "),
    "GPL-3.0": GPL_HEADER,
    "Apache-2.0": ASF_HEADER,
    "MIT": "frob, a program\n" + MIT_LINE + "\nmore about it\n",
    "Proprietary": "# Copyright 2020 X. All rights reserved.\nx = 1\n",
    "MPL-2.0": OWN["MPL-2.0"],
    "LGPL-3.0": OWN["LGPL-3.0"],
    "ISC": OWN["ISC"].replace("<year> <owner>", "2001-2020, Frob"),
}
UNKNOWN = [
    "the rights of all are\nreserved for the person",
    "A driver's license is granted to a person who may redistribute nothing.\n" * 5,
    "This program is free for schools, and its warranty is limited to the purpose that the public see.",
    "The conditions of the contract limit the liability of the software company for damages.",
]


@pytest.mark.parametrize("name", KNOWN)
def test_texts_and_headers_as_they_are_published(name):
    got = Matcher().text(KNOWN[name], windows=True)
    assert got[1] == name and got[0] >= THRESHOLD


@pytest.mark.parametrize("text", UNKNOWN)
def test_other_texts_have_none(text):
    assert Matcher().text(text, windows=True) is None


@pytest.mark.parametrize("text", [*KNOWN.values(), *UNKNOWN, KNOWN["Proprietary"] * 3 + ASF_HEADER, "x " * 300, ""])
def test_same_as_all_units_against_all_templates(text):
    for windows in (False, True):
        text = " ".join(text.split(" ")[:900])
        got, want = Matcher().text(text, windows), brute_text(text, windows)
        assert (got and (pytest.approx(got[0], abs=2e-9), got[1])) == want


def test_wrapped_texts_in_the_query(spark, tmp_path):
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n"
    texts = {10: KNOWN["BSD-3-Clause"], 20: KNOWN["MIT"], 30: gpl, 1: "x = 1\n/* Copyright (c) 2020 Foo Inc. All rights reserved. */\n", 2: UNKNOWN[0], 3: KNOWN["MIT"] * 200}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license for r in op10_licenses(spark, str(tmp_path)).filter("origin = 'own'").collect()}
    assert got == {10: "BSD-3-Clause", 20: "MIT", 30: "GPL-3.0", 1: "Proprietary", 3: "MIT"}
