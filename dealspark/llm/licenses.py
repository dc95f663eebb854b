"""Licence scanning: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

A file's lines, and all runs of words as long as a template (so across line ends and inside lines), are compared with the
templates: notices, the usual headers, short licence texts in full and the openings of long ones. The best of them at or
above `header_cosine` is its own licence, or that of its family (GNU, BSD, Creative Commons, Apache, Mozilla) which the text's first mention
names by kind and version: their texts differ in a few words, which no cosine tells. Templates of under `SHORT` words need `SHORT_COSINE`, that is all their words, and
count only where no longer template is found: BSD texts reserve all rights too. A file whose whole text is at or above `file_cosine`, or which is named like a licence file and has a header, licenses its
directory. A file without a licence of its own inherits from the nearest ancestor directory that has one (by joins of
directory paths). Document frequencies of the templates' terms are counted over all files and smoothed; terms rarer than
`RAREST`, terms of no file and terms of no template weigh as if they occurred in that share of the files, whatever the size
of the table. Null and empty texts have no licence of their own but inherit; a null path has no directory. Of several
licences of a directory, or equally near templates, the higher cosine and then the smaller name wins. Repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import NOT_ALNUM, materialise, record, slices, split_words

#: Fixed values: (licence, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved. Redistribution is prohibited"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
]
#: Licences that differ in a few words only are told apart by these words, at their first mention in the text: fixed values.
#: (family, pattern of the mention with what tells its members apart).
FAMILIES = {
    "GPL": r"gnu\s+(?:(affero|lesser|library)\s+)?(?:general\s+public\s+licen[cs]e|gpl)(?:[^.]{0,200}?\b(?:version|v)\.?\s*(\d(?:\.\d)?))?",
    "CC": r"creative\s+commons\s+(attribution[a-z\s-]*?)(?:\s+(?:licen[cs]e\b|v(?:ersion)?)[,\s]*)?\s*(\d\.\d)|\bcc[\s-](by(?:[\s-](?:nc|sa|nd))*)(?:[\s-]+v?(\d\.\d))?",
    "Apache": r"apache\s+(?:software\s+)?licen[cs]e[\s,(]*(?:version|v)\.?\s*(\d(?:\.\d)?)",
    "MPL": r"mozilla\s+public\s+licen[cs]e[\s,]*(?:version|v)\.?\s*(\d(?:\.\d)?)",
}
#: Line ends with the marks of comments.
_LINE_END = re.compile(r"\s*\n\s*(?:[#*;%>]+|//+|--+)?\s*")
_ADVERTISING, _ENDORSE = r"advertising\s+materials\s+mentioning", r"neither\s+the\s+names?\b|endorse\s+or\s+promote"
HEADER_COSINE, FILE_COSINE = 0.7, 0.7
SHORT, SHORT_COSINE = 5, 0.95
RAREST, SMOOTHING = 1e-3, 50
#: Words of candidate windows that are compared at once.
WINDOW_WORDS = 1 << 20
_NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


def _words(texts: pa.Array):
    return split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_ALNUM)


def _version(found: str | None, otherwise: str) -> str:
    return otherwise if not found else found if "." in found else f"{found}.0"


def member(licence: str | None, text: str | None) -> str | None:
    """The licence of the found one's family that the text's first mention names; the found one where there is no mention."""
    if licence is None or not text:
        return licence
    text = _LINE_END.sub(" ", text)
    if licence.startswith("BSD-"):
        return "BSD-4-Clause" if re.search(_ADVERTISING, text, re.I) else "BSD-3-Clause" if re.search(_ENDORSE, text, re.I) else "BSD-2-Clause" if re.search(r"binary\s+form\s+must", text, re.I) else licence
    family = next((f for f in FAMILIES if licence.lstrip("AL").startswith(f) or licence.startswith(f)), None)
    m = re.search(FAMILIES[family], text, re.I) if family else None
    if m is None or licence.startswith("CC0"):
        return licence
    known = licence.rsplit("-", 1)[1]
    if family == "GPL":
        kind = {"affero": "AGPL", "lesser": "LGPL", "library": "LGPL"}.get((m[1] or "").lower(), "GPL")
        return f"{kind}-{_version(m[2], known)}"
    if family != "CC":
        return f"{family}-{_version(m[1], known)}"
    words = (m[1] or m[3]).lower()
    parts = [p for p, form in (("NC", r"non-?\s*commercial|\bnc\b"), ("SA", r"share-?\s*alike|\bsa\b"), ("ND", r"no-?\s*deriv|\bnd\b")) if re.search(form, words)]
    return "-".join(["CC", "BY", *parts, m[2] or m[4] or known])


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = np.array([n for n, _ in sorted(templates)], object)
        words = _words(pa.array([t for _, t in sorted(templates)], pa.large_string()))
        self.terms, inverse = np.unique(words.hashes(), return_inverse=True)
        self.tf = np.zeros((len(self.terms), len(self.names)))
        np.add.at(self.tf, (inverse, words.row), 1)
        self.length = self.tf.sum(axis=0).astype(np.int64)
        self.short = self.length < SHORT

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        slot = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[slot] == hashes, slot, -1)


_DF = pa.schema([("term", pa.int32()), ("n", pa.int64())])


def term_frequencies(files: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Files, and files with each template term (a few hundred numbers at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(templates.terms), np.int64), 0
        for batch in slices(batches, "text"):
            words = _words(batch.column("text"))
            term = templates.lookup(words.hashes())
            hit = np.flatnonzero(term >= 0)
            pair = np.unique(words.row[hit] * len(total) + term[hit])
            total += np.bincount(pair % len(total), minlength=len(total))
            rows += batch.num_rows
        yield record(_DF, np.arange(-1, len(total), dtype=np.int32), np.concatenate([[rows], total]))

    found = files.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in found}
    return counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(templates.terms))], np.float64)


def _cosines(templates: Templates, weights: np.ndarray, idf: np.ndarray, most: float, unit: np.ndarray, hashes: np.ndarray, n_units: int) -> np.ndarray:
    """Cosines of units (lines or texts) to the templates: units x templates."""
    out = np.zeros((n_units, len(templates.names)))
    term = templates.lookup(hashes)
    touched = np.zeros(n_units, bool)
    touched[unit[term >= 0]] = True
    some = touched[unit]
    unit, hashes = unit[some], hashes[some]
    if not len(unit):
        return out
    order = np.lexsort((hashes, unit))
    unit, hashes = unit[order], hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (hashes[1:] != hashes[:-1])]))
    tf = np.diff(np.append(cut, len(unit))).astype(np.float64)
    unit, term = unit[cut], templates.lookup(hashes[cut])
    value = tf * np.where(term >= 0, idf[term], most)
    norm = np.sqrt(np.bincount(unit, value**2, minlength=n_units))
    hit = term >= 0
    np.add.at(out, unit[hit], value[hit, None] * weights[term[hit]])
    return out / np.maximum(norm, 1e-12)[:, None]


def inverse_frequencies(n: int, df: np.ndarray) -> np.ndarray:
    return 1 - np.log(np.maximum((df + RAREST * SMOOTHING) / (n + SMOOTHING), RAREST))


def _window_cosines(templates: Templates, weights: np.ndarray, idf: np.ndarray, most: float, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each row, the best cosine of its runs of a template's length to that template: rows x templates. The product is a
    sum over positions; a sum of squares by position is at most the squared norm, so few windows need the exact cosine."""
    n_rows = len(first) - 1
    out = np.zeros((n_rows, len(templates.names)))
    term = templates.lookup(hashes)
    weight = np.append(idf, most)[term]
    squares = np.concatenate([[0.0], np.cumsum(weight**2)])
    parts = np.append(idf, 0.0)[term]
    for t, length in enumerate(templates.length):
        n = len(hashes) - length + 1
        if n < 1:
            continue
        product = np.concatenate([[0.0], np.cumsum(parts * np.append(weights[:, t], 0.0)[term])])
        least = (SHORT_COSINE if templates.short[t] else HEADER_COSINE) - 1e-6
        close = np.flatnonzero(product[length:] - product[:n] >= least * np.sqrt(squares[length:] - squares[:n]))
        row = np.searchsorted(first, close, "right") - 1
        inside = close + length <= first[row + 1]
        close, row = close[inside], row[inside]
        step = max(1, WINDOW_WORDS // int(length))
        for k in range(0, len(close), step):
            at = close[k : k + step]
            cosines = _cosines(templates, weights, idf, most, np.repeat(np.arange(len(at)), length), hashes[(at[:, None] + np.arange(length)).reshape(-1)], len(at))
            np.maximum.at(out[:, t], row[k : k + step], cosines[:, t])
    return out


_OWN = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("header", pa.string()), ("header_cosine", pa.float64()), ("file_cosine", pa.float64()), ("whole", pa.string())])


def _decided(templates: Templates, cosines: np.ndarray, least: float) -> np.ndarray:
    """Short templates count with all their words only, and where no longer one is found."""
    short = templates.short
    longer = cosines[:, ~short].max(axis=1, initial=0.0) >= least
    counts = (cosines >= SHORT_COSINE) & ~longer[:, None]
    return np.where(short & ~counts, 0.0, cosines)


def own_licences(files: DataFrame) -> DataFrame:
    """files: file_id long, path, text. Adds the best header and the whole text's best template, with cosines."""
    templates = Templates()
    n, df = term_frequencies(files, templates)
    idf = inverse_frequencies(n, df)
    most = float(inverse_frequencies(n, np.zeros(1))[0])
    weights = templates.tf * idf[:, None]
    weights = weights / np.sqrt((weights**2).sum(axis=0))
    shared = files.sparkSession.sparkContext.broadcast((templates, weights, idf, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, weights, idf, most = shared.value
        for batch in slices(batches, "text"):
            words = _words(batch.column("text"))
            hashes, row = words.hashes(), words.row
            breaks = np.cumsum(words.data == 10)
            line = row + (breaks[words.starts] if len(words.starts) else 0)
            keys, line_of = np.unique(line, return_inverse=True)
            by_line = _cosines(templates, weights, idf, most, line_of, hashes, len(keys))
            by_text = _cosines(templates, weights, idf, most, row, hashes, batch.num_rows)
            best = np.zeros((batch.num_rows, len(templates.names)))
            line_row = np.zeros(len(keys), np.int64)
            line_row[line_of] = row
            np.maximum.at(best, line_row, by_line)
            best = _decided(templates, np.maximum(best, _window_cosines(templates, weights, idf, most, words.first, hashes)), HEADER_COSINE)
            by_text = _decided(templates, by_text, FILE_COSINE)
            h, w = best.argmax(axis=1), by_text.argmax(axis=1)
            hc, wc = best.max(axis=1), by_text.max(axis=1)
            header, whole = np.where(hc >= HEADER_COSINE, templates.names[h], None), np.where(wc >= FILE_COSINE, templates.names[w], None)
            for i in np.flatnonzero((hc >= HEADER_COSINE) | (wc >= FILE_COSINE)):
                text = batch.column("text")[i].as_py()
                header[i], whole[i] = member(header[i], text), member(whole[i], text)
            yield record(_OWN, batch.column("file_id"), batch.column("path").cast(pa.string()), header, hc, wc, whole)

    return files.select("file_id", "path", "text").mapInArrow(run, "file_id long, path string, header string, header_cosine double, file_cosine double, whole string")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def scan(files: DataFrame) -> DataFrame:
    """files: file_id, path, text. Returns file_id, path, licence, basis (header, file, inherited or none),
    cosine, from_directory."""
    own = own_licences(files.select(F.col("file_id").cast("long").alias("file_id"), "path", "text"))
    rows = materialise(own.withColumn("dir", directory(F.col("path"))))
    grants = rows.where(F.col("dir").isNotNull()).select("dir", F.when(F.col("whole").isNotNull(), F.struct(F.col("file_cosine").alias("c"), F.col("whole").alias("l"))).when(F.col("path").rlike(_NAMED) & F.col("header").isNotNull(), F.struct(F.col("header_cosine").alias("c"), F.col("header").alias("l"))).alias("g")).where(F.col("g").isNotNull())
    granted = grants.groupBy("dir").agg(F.min(F.struct((-F.col("g.c")).alias("c"), F.col("g.l").alias("l"))).alias("g")).select(F.col("dir").alias("from_directory"), F.col("g.l").alias("inherited"))
    dirs = rows.where(F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("from_directory")))).alias("a")).select("dir", "a.*")
    nearest = ancestors.join(granted, "from_directory").groupBy("dir").agg(F.max(F.struct("depth", "from_directory", "inherited")).alias("n")).select("dir", "n.from_directory", "n.inherited")
    own_licence = F.coalesce("whole", "header")
    basis = F.when(F.col("whole").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.join(nearest, "dir", "left").select("file_id", "path", F.coalesce(own_licence, F.col("inherited")).alias("licence"), basis.alias("basis"), F.when(F.col("whole").isNotNull(), F.col("file_cosine")).otherwise(F.col("header_cosine")).alias("cosine"), F.when(own_licence.isNull(), F.col("from_directory")).alias("from_directory"))


def op5(docs: DataFrame) -> DataFrame:
    """Documents as files: source and language are directories."""
    path = F.concat_ws("/", F.lit("corpus"), F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    return scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")
