"""Licences whose texts differ in a few words, among many other files; cosines against a plain computation."""

import collections
import math
import re

import pytest

from dealspark.llm import licenses

GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and "Neither" in t)
TEXTS = {
    "GPL-2.0": GNU.format("General Public License", "2"),
    "GPL-3.0": GNU.format("General Public License", "3"),
    "LGPL-2.1": GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0": GNU.format("Lesser General Public License", "3"),
    "LGPL-2.0": GNU.format("Library General Public License", "2"),
    "AGPL-3.0": GNU.format("Affero General Public License", "3"),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "BSD-3-Clause": BSD.replace("the copyright holder", "Example University"),
    "BSD-2-Clause": BSD[: BSD.index(" 3. Neither")],
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/1.1/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
}


@pytest.fixture(scope="module")
def others():
    return [(1000 + i, f"o{i % 20}/f{i}.txt", f"other file {i} about topic {i % 37} and nothing else at all " * (i % 4 + 1)) for i in range(500)]


def test_neighbours_are_named_rightly(spark, others):
    rows = [(i, f"d{i}/LICENSE", text) for i, text in enumerate(TEXTS.values())]
    rows += [(100 + i, f"d{i}/sub/code.py", "plain code") for i in range(len(TEXTS))]
    rows += [(200 + i, f"e{i}/a.txt", f"words before it\n{text}\nand after") for i, text in enumerate(TEXTS.values())]
    got = {r.file_id: r for r in licenses.scan(spark.createDataFrame(rows + others, "file_id long, path string, text string")).collect()}
    for i, name in enumerate(TEXTS):
        assert got[i].licence == name and got[i].basis in ("file", "header"), name
        assert (got[100 + i].licence, got[100 + i].basis) == (name, "inherited"), name
        assert got[200 + i].licence == name, name
    assert all(got[i].licence is None for i, *_ in others)


@pytest.mark.parametrize(("found", "text", "want"), [(None, "x", None), ("GPL-3.0", None, "GPL-3.0"), ("MIT", "mit", "MIT"), ("GPL-3.0", "no mention", "GPL-3.0"), ("GPL-3.0", "the GNU GPL v2", "GPL-2.0"), ("CC-BY-4.0", "CC-BY-ND", "CC-BY-ND-4.0"), ("CC0-1.0", "cc by 4.0", "CC0-1.0"), ("Apache-2.0", "Apache Software License, Version 1.1", "Apache-1.1"), ("BSD-3-Clause", "All advertising materials mentioning features", "BSD-4-Clause")])
def test_member(found, text, want):
    assert licenses.member(found, text) == want


def test_cosine_equals_a_plain_one(spark, others):
    """The whole text's cosine to its best template, worked out term by term over all files."""
    rows = [(i, f"d{i}/x", t) for i, t in enumerate([TEXTS["GPL-2.0"], TEXTS["MPL-2.0"], TEXTS["BSD-2-Clause"] + " and some more words of their own", "nothing", None])]
    split = lambda t: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w]
    files = [split(t) for *_, t in rows + others]
    known = {w for _, t in licenses.TEMPLATES for w in split(t)}
    df = collections.Counter(w for f in files for w in set(f))
    idf = lambda w: 1 - math.log(max(((df[w] if w in known else 0) + licenses.RAREST * licenses.SMOOTHING) / (len(files) + licenses.SMOOTHING), licenses.RAREST))
    vector = lambda words: {w: n * idf(w) for w, n in collections.Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    got = {r.file_id: r.file_cosine for r in licenses.own_licences(spark.createDataFrame(rows + others, "file_id long, path string, text string")).collect()}
    for i, _, text in rows:
        a = vector(split(text))
        cosines = [sum(a.get(w, 0) * x for w, x in b.items()) / max(norm(a) * norm(b), 1e-12) for b in (vector(split(t)) for _, t in licenses.TEMPLATES if len(split(t)) >= licenses.SHORT)]
        assert got[i] == pytest.approx(max(cosines), abs=1e-9)
