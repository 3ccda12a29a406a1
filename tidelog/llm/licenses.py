"""License scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Units of a text are its lines, its sentences, its paragraphs, and the whole of it; sentences part
a notice from the holder and year before it. A unit's vector holds the counts of the words that
templates use, weighted by inverse document frequency over the whole corpus. All other words count
in the unit's length only, each with the mean weight of such a word in a document: that mean is
taken over all words of all documents and doesn't grow with their number, as the weight of a rare
word would. A unit's license is that of the template of best cosine, if it reaches the threshold.
Of a text's units the one whose template has the most words counts, since whole conditions tell
more than the first line that several licenses share; then the better cosine. A text of which the
matching unit is at least half is a license file; it covers its directory. Files without a license
of their own inherit from the nearest directory above that has one.

Plan: two scans of the texts. Document frequencies are summed in each slice of texts, then in each
task, and come back as one row for each template word and one for all others (as many as the
templates have words, whatever the corpus). Directories are resolved
once each, by joins on their ancestors, and not once for each file. All directories have the root
above them, and one may hold a third of all files; the joins on both are salted.

Edge cases: null and empty texts have no license of their own but may inherit; a null path
inherits nothing. Cosines are rounded to TIE_DIGITS digits; in a tie the license that comes first
by name is taken, wherever in the text it stands. Repeated rows are scanned each. An empty
table gives none. A very long text is scanned whole, in one task. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, salted, salts
from .words import ALNUM, Words, mix, text_slices

#: Short forms of common notices, by license; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LicenseRef-proprietary", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
#: What full texts of permissive licenses have in common; fixed values.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Whole texts of licenses, without titles and copyright lines; fixed values.
FULL_TEXTS = (
    ("0BSD", f"{_ISC}. {_ISC_END}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
     "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Words that tell versions and variants apart: a match has the same ones of the second kind, and
#: all of its template's of the first.
NAMES = "0 1 2 3 4 apache agpl bsd cc0 gpl isc lgpl mit mozilla mpl".split()
VARIANTS = "affero agpl lesser lgpl nc nd noncommercial noderivatives sa sharealike".split()
THRESHOLD = 0.8
#: Cosines that agree so far are equal: sums of floats differ behind it by their order.
TIE_DIGITS = 9
SALTS = 32
#: What ends a sentence, if a blank follows.
_STOPS = np.frombuffer(b".!?", np.uint8)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


class Vocabulary:
    """The templates' words: sorted hashes, and each template's counts."""

    def __init__(self, templates):
        self.names = [n for n, _ in templates]
        words = Words([t.encode() for _, t in templates], ALNUM, lower=True)
        hashes, owner = words.hashes(), words.text_of()
        self.words = np.unique(hashes)
        self.counts = np.zeros((len(templates), len(self.words)))
        np.add.at(self.counts, (owner, np.searchsorted(self.words, hashes)), 1)
        names, variants = (self._among(x) for x in (NAMES, VARIANTS))
        self.needed, self.barred = (self.counts > 0) & (names | variants), (self.counts == 0) & variants

    def _among(self, words: list[str]) -> np.ndarray:
        """Which words of the vocabulary are these."""
        return np.isin(self.words, Words([w.encode() for w in words], ALNUM, lower=True).hashes())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


#: In place of a template word's number: a row that counts documents, and one for another word.
DOCUMENTS, OTHER = -1, -2


def _frequencies(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                words = Words(texts, ALNUM, lower=True)
                hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
                # each word of a text once: equal keys are equal words of one text
                key = mix(hashes ^ mix(words.text_of().astype(np.uint64) + np.uint64(1))) if len(words) else hashes
                order = np.argsort(key)
                new = np.ones(len(key), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                own, count = np.unique(hashes[order[new]], return_counts=True)
                number = vocabulary.find(own)
                word = np.concatenate(([DOCUMENTS], np.where(number >= 0, number, OTHER)))
                other = np.concatenate((np.zeros(1, np.int64), np.where(number >= 0, np.uint64(0), own).view(np.int64)))
                yield pa.record_batch(
                    {"word": pa.array(word.astype(np.int32)), "other": pa.array(other), "n": pa.array(np.concatenate(([len(texts)], count)).astype(np.int64))}
                )

    return run


def weights(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """The inverse document frequency of each template word, and the mean one of the other words of all documents."""
    counts = docs.select("text").mapInArrow(_frequencies(vocabulary), "word int, other long, n long").groupBy("word", "other").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log1p("n")).alias("logs")).collect()
    count = {r["word"]: r for r in rows}
    n = count[DOCUMENTS]["n"] if DOCUMENTS in count else 0
    df = np.array([count[k]["n"] if k in count else 0 for k in range(len(vocabulary.words))])
    common = count[OTHER]["logs"] / count[OTHER]["n"] if OTHER in count else 0.0
    return np.log((n + 1) / (df + 1)) + 1, round(float(np.log(n + 1) + 1 - common), TIE_DIGITS)


def _match(vocabulary: Vocabulary, idf: np.ndarray, other: float, threshold: float):
    templates = vocabulary.counts * idf
    templates /= np.linalg.norm(templates, axis=1, keepdims=True)
    order = np.argsort(np.array(vocabulary.names), kind="stable")
    needs, lengths = vocabulary.needed.sum(axis=1), vocabulary.counts.sum(axis=1)

    def units(words: Words, unit: np.ndarray, numbers: np.ndarray):
        """(unit, words of the template, cosine, license) of units that reach the threshold."""
        known = numbers >= 0
        if not known.any():
            return
        width = len(vocabulary.words)
        pairs, count = np.unique(unit[known] * width + numbers[known], return_counts=True)
        who, word = pairs // width, pairs % width
        value = count * idf[word]
        begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        ids = who[begin]
        square = np.add.reduceat(value * value, begin)
        # other words are told apart by nothing but their number, as if each occurred once
        extra = np.bincount(unit, minlength=int(unit.max()) + 1)[ids] - np.bincount(unit[known], minlength=int(unit.max()) + 1)[ids]
        norm = np.sqrt(square + extra * other * other)
        some = np.sqrt(square) / norm >= threshold - 10.0**-TIE_DIGITS
        bounds = np.append(begin, len(who))
        for k in np.flatnonzero(some).tolist():
            a, b = bounds[k], bounds[k + 1]
            cosine = (templates[order][:, word[a:b]] @ value[a:b]) / norm[k]
            has = word[a:b]
            fits = (vocabulary.needed[:, has].sum(axis=1) == needs) & ~vocabulary.barred[:, has].any(axis=1)
            cosine = np.round(np.where(fits[order], cosine, 0.0), TIE_DIGITS)
            best = int(cosine.argmax())  # the first by name of equal ones
            if cosine[best] >= threshold:
                yield int(ids[k]), int(lengths[order[best]]), float(cosine[best]), vocabulary.names[order[best]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                words = Words(texts, ALNUM, lower=True)
                best: dict[int, tuple] = {}
                if len(words):
                    owner, numbers = words.text_of(), vocabulary.find(words.hashes())
                    ends = np.concatenate((np.flatnonzero(words.data == 0x0A), words.text_start[1:] - 1))
                    ends.sort()
                    line = np.searchsorted(ends, words.start)
                    blank = np.flatnonzero((words.data[:-1] == 0x0A) & (words.data[1:] == 0x0A))
                    cuts = np.concatenate((blank, words.text_start[1:] - 1))
                    cuts.sort()
                    stops = np.flatnonzero(np.isin(words.data[:-1], _STOPS) & _BLANK[words.data[1:]])
                    stops = np.concatenate((stops, cuts))
                    stops.sort()
                    for unit in (line, np.searchsorted(stops, words.start), np.searchsorted(cuts, words.start), owner):
                        size = np.bincount(unit)
                        first = np.searchsorted(unit, np.arange(len(size)))
                        for u, n, cosine, name in units(words, unit, numbers):
                            doc = int(owner[first[u]])
                            # more words, then a better cosine, then the earlier name, then the unit that makes a license file
                            own = (-n, -cosine, name, not 2 * size[u] >= words.counts[doc])
                            best[doc] = min(best.get(doc, own), own)
                found = [best.get(k, (0, 0.0, None, True)) for k in range(part.num_rows)]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"), "path": part.column("path"), "license": pa.array([x[2] for x in found], pa.string()),
                        "similarity": pa.array([-x[1] for x in found], pa.float64()), "is_file": pa.array([not x[3] for x in found], pa.bool_()),
                    }
                )

    return run


def _directory() -> Column:
    return F.regexp_replace("path", "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """The license of each directory of ``files`` (path, license, similarity, is_file), from itself or above: dir, inherited, inherited_from."""
    named = files.where("path is not null").withColumn("dir", _directory())
    covered = named.where("is_file").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("similarity"), "license")).alias("inherited"))
    covered = covered.withColumn("salt", F.explode(salts(SALTS))).withColumnRenamed("dir", "up")
    dirs = named.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chain = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up")).withColumn("salt", salted(SALTS, "dir"))
    nearest = chain.join(covered, ["up", "salt"]).groupBy("dir").agg(F.max(F.struct(F.length("up"), "up", "inherited")).alias("m"))
    return nearest.select("dir", "m.inherited", F.col("m.up").alias("inherited_from"))


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES + FULL_TEXTS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path"
) -> DataFrame:
    """One row for each input row: doc_id, path, license (own or inherited), similarity, inherited, inherited_from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    vocabulary = Vocabulary(templates)
    idf, other = weights(rows, vocabulary)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    own = checkpoint(rows.mapInArrow(_match(vocabulary, idf, other, threshold), f"doc_id {id_type}, path string, license string, similarity double, is_file boolean"))
    known = inherit(own).withColumn("salt", F.explode(salts(SALTS)))
    own = own.withColumn("dir", _directory()).withColumn("salt", salted(SALTS, "doc_id", "path", "similarity"))
    joined = own.join(known, ["dir", "salt"], "left")
    lone = F.col("license").isNull() & F.col("inherited").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("license", "inherited").alias("license"), "similarity", lone.alias("inherited"),
        F.when(lone, F.col("inherited_from")).alias("inherited_from"),
    )
