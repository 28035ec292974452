"""License scan (operator 7).

Two findings for every document. Base labels come from fixed phrases whose words
stand consecutively. The method's labels come from an exact set-similarity join
of text blocks with license templates of any length. Tokens are runs of ``GRAM``
words, so words in another order, or scattered, share nothing with a template. The
blocks of a template are all runs of ``STRETCH`` times its length in words, one at
every word of the text, shorter at its end. A block matches if it holds at least
``THRESHOLD`` of the template's distinct tokens:

- tokens are ordered by their frequency in the whole corpus, rarest first; a
  document is looked at for a template only if it holds one of the template's
  prefix tokens, the rarest ones of which any match has one (prefix filter),
- and enough words for the needed tokens (length filter),
- and, from the rarest token it holds on, enough of the template's tokens
  (positional filter).

What is left is counted exactly: every occurrence of a token adds one to the blocks
in which it is the token's first, a difference array over all block starts. Filters
never lose a match. Adjacent matching blocks are reported as one run.

Only counts of template tokens reach the driver, one row a token. Null text counts
as empty. Rows are judged one by one: repeated rows get equal findings; labels that
tie are all reported. Texts of any length are scanned whole. Only doc_id and text
are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, STRETCH, THRESHOLD = 3, 1.25, 0.9

# The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
# Texts and notices of common licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd-2", _BSD + _AS_IS),
    (
        "bsd-3",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _AS_IS,
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the contract: ASCII letters lower-cased, digits, and all other code points."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start and label of every base phrase."""
    out = []
    for phrase, label in PHRASES:
        p = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(p[-1], at + 1)
            except ValueError:
                break
            if at >= len(p) - 1 and words[at - len(p) + 1 : at + 1] == p:
                out.append((at - len(p) + 1, label))
    return sorted(out)


class Grams:
    """Numbers of the templates' tokens, and where a text has them."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, words_of(text)) for label, text in templates]
        if any(not words for _, words in self.templates):
            raise ValueError("a template has no words")
        self.word = {w: k for k, w in enumerate(sorted({w for _, t in self.templates for w in t}), 1)}
        self.span = len(self.word) + 1
        if self.span**GRAM >= 1 << 63:
            raise ValueError("the templates have too many different words")
        self.width = [min(GRAM, len(t)) for _, t in self.templates]
        keys = [self._keys(np.array([self.word[w] for w in t]), n) for (_, t), n in zip(self.templates, self.width, strict=True)]
        self.known = {n: np.unique(np.concatenate([k for k, m in zip(keys, self.width, strict=True) if m == n])) for n in set(self.width)}
        self.first = dict(zip(self.known, np.cumsum([0, *map(len, self.known.values())]).tolist(), strict=False))
        self.total = sum(map(len, self.known.values()))
        self.sets = [np.unique(self.first[n] + np.searchsorted(self.known[n], k)) for k, n in zip(keys, self.width, strict=True)]

    def _keys(self, words: np.ndarray, n: int) -> np.ndarray:
        """Runs of ``n`` words as numbers; a run with an unknown word is no token's."""
        out, ok = np.zeros(max(0, len(words) - n + 1), np.int64), np.ones(max(0, len(words) - n + 1), bool)
        for k in range(n):
            w = words[k : k + len(out)]
            out, ok = out * self.span + w, ok & (w > 0)
        return np.where(ok, out, -1)

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, token number) of all template tokens in a text, in order for each width."""
        get = self.word.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        at, token = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, known in self.known.items():
            keys = self._keys(ids, n)
            where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[where] == keys)
            at.append(hit)
            token.append(self.first[n] + where[hit])
        return np.concatenate(at), np.concatenate(token)


class Scanner:
    """Templates in global frequency order, with a prefix index."""

    def __init__(self, counts, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.grams = Grams(templates)
        rank = np.empty(self.grams.total, np.int64)
        rank[np.lexsort((np.arange(self.grams.total), np.asarray(counts)))] = np.arange(self.grams.total)
        self.prefix: dict[int, list[int]] = {}
        self.plans = []
        for k, ((label, words), own) in enumerate(zip(self.grams.templates, self.grams.sets, strict=True)):
            ordered = own[np.argsort(rank[own])]
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.plans.append((label, ordered, need, math.ceil(STRETCH * len(words)), self.grams.width[k]))
            for token in ordered[: len(ordered) - need + 1].tolist():
                self.prefix.setdefault(token, []).append(k)

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first start, last start, largest containment) of every run of matching blocks."""
        at, token = self.grams.places(words)
        out = []
        for k in sorted({k for t in set(token.tolist()) for k in self.prefix.get(t, ())}):  # prefix filter
            label, ordered, need, size, width = self.plans[k]
            if len(words) < need + width - 1:  # length filter
                continue
            mine = np.isin(token, ordered)
            p, t = at[mine], token[mine]
            rarest = int(np.flatnonzero(np.isin(ordered, t))[0])
            if len(ordered) - rarest < need or len(np.unique(t)) < need:  # positional filter
                continue
            order = np.lexsort((p, t))
            p, t = p[order], t[order]
            before = np.where(np.concatenate(([True], t[1:] != t[:-1])), -1, np.concatenate(([-1], p[:-1])))
            step = np.zeros(len(words) + 1, np.int64)  # a token counts in blocks that start after its last place and reach its end
            np.add.at(step, np.maximum(np.maximum(before + 1, p + width - size), 0), 1)
            np.add.at(step, p + 1, -1)
            have = np.cumsum(step[:-1])
            match = np.flatnonzero(have >= need)
            for run in np.split(match, np.flatnonzero(np.diff(match) > 1) + 1):
                if len(run):
                    out.append((label, int(run[0]), int(run[-1]), float(have[run].max()) / len(ordered)))
        return out


def template_counts(docs: DataFrame, templates=TEMPLATES) -> np.ndarray:
    """How often each template token occurs in the whole table."""
    grams = Grams(templates)

    def run(batches):
        total = np.zeros(grams.total, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(grams.places(words_of(text))[1], minlength=grams.total)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["token", "n"])

    out = np.zeros(grams.total, np.int64)
    for r in docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # a row a token of the templates
        out[r["token"]] = r["n"]
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document; ``blocks`` holds the runs of matching blocks."""
    scanner = Scanner(template_counts(docs, templates), templates, threshold)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("label", "first_start", "last_start", "containment")
    block = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True))))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                base, found = base_places(words), scanner.blocks(words)
                own = {x for _, x in base}
                row = (
                    len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted(own)), ",".join(sorted(own | {f[0] for f in found})),
                    1.0 if base else max((f[3] for f in found), default=0.0),
                    [dict(zip(names, f, strict=True)) for f in found],
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<label: string, first_start: long, last_start: long, containment: double>>",
    )
