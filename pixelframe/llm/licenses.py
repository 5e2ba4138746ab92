"""License scan: an exact set-similarity join of text blocks with license templates, by containment.

Template words are ordered by their frequency in the whole corpus, rarest first. A block that holds the share
THRESHOLD of a template's words must hold one of the template's first |T| - ceil(THRESHOLD * |T|) + 1 words (prefix
filter), at least ceil(THRESHOLD * |T|) template words at all (length filter), and enough words behind the first
shared one (positional filter). What passes is verified. Templates may be of any length: one of up to n words (n a power
of two, LEAST at least) is looked for in blocks of 2 n words, one every n, so that every run of n words lies wholly
in a block.

Defined results: a null or empty text has no words, no label and score 0; texts are scanned whole, however long; a block that
just reaches the threshold counts; repeated rows are scanned alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, LOWER, hash_word, text_pieces, word_hashes, words_of

#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Texts by which documents state their license (fixed values): short notices, and the licenses' own text.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "gpl-3": [
        "gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    ],
    "lgpl-3": ["gnu lesser general public license version 3"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ],
    "proprietary": ["all rights reserved no part may be reproduced without permission"],
}
THRESHOLD, LEAST = 0.9, 32
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(text: str) -> list[str]:
    """The words of a template."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def run_of(n: int) -> int:
    """The run of words in which a template of n words is looked for; a block is twice as long."""
    return max(LEAST, 1 << (n - 1).bit_length())


class _Words:
    """The vocabulary of all templates and phrases: number of a word by hash."""

    def __init__(self, templates: dict, phrases: dict):
        names = sorted({w for notices in templates.values() for n in notices for w in words_in(n)} | {w for p in phrases for w in p.split()})
        h = np.array([hash_word(w.encode()) for w in names], dtype=np.uint64)
        order = np.argsort(h)
        self.hashes, self.names = h[order], [names[i] for i in order]
        self.number = {w: i for i, w in enumerate(self.names)}

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)


def _rows(batch_column, words: _Words) -> Iterator[tuple[int, np.ndarray]]:
    """(row, number of each of its words in the vocabulary or -1)."""
    for at, end, buf, offsets in text_pieces(batch_column):
        buf = LOWER[buf]
        starts, ends, first = words_of(buf, offsets, ALNUM)
        ids = words.find(word_hashes(buf, starts, ends)) if len(starts) else np.zeros(0, dtype=np.int64)
        for row in range(at, end):
            yield row, ids[first[row - at] : first[row - at + 1]]


def word_frequencies(docs: DataFrame, words: _Words, text_col: str = "text") -> list[int]:
    """How often each vocabulary word stands in the whole corpus; one row for each word reaches the driver."""

    def run(batches):
        n = np.zeros(len(words.names), dtype=np.int64)
        for batch in batches:
            for _, ids in _rows(batch.column(0), words):
                n += np.bincount(ids[ids >= 0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], ["w", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}
    return [found.get(i, 0) for i in range(len(words.names))]


class TemplateJoin:
    """The index of templates, by the run of words in which they are looked for: word -> templates whose prefix holds it."""

    def __init__(self, words: _Words, frequencies: list[int], templates: dict, threshold: float):
        self.threshold, self.sets = threshold, []
        self.by_run: dict[int, dict[int, list[int]]] = {}
        for label, notices in templates.items():
            for notice in notices:
                said = words_in(notice)
                ordered = sorted({words.number[w] for w in said}, key=lambda i: (frequencies[i], i))
                need = math.ceil(threshold * len(ordered) - 1e-9)
                by_word = self.by_run.setdefault(run_of(len(said)), {})
                for i in ordered[: len(ordered) - need + 1]:
                    by_word.setdefault(i, []).append(len(self.sets))
                self.sets.append((label, ordered, set(ordered), need))
        self.rare = {}
        for n, by_word in self.by_run.items():
            self.rare[n] = np.zeros(len(words.names) + 1, dtype=bool)
            self.rare[n][list(by_word)] = True

    def best(self, block: set[int], by_word: dict[int, list[int]]) -> dict[str, float]:
        """label -> largest containment, of the templates that the block meets. A notice whose words are all in
        another notice that the block meets (cc by in cc by nc) gives way to it."""
        met: dict[int, float] = {}
        for t in {t for w in block if w in by_word for t in by_word[w]}:
            label, ordered, whole, need = self.sets[t]
            if len(block) < need:  # length
                continue
            first = next(i for i, w in enumerate(ordered) if w in block)
            if len(ordered) - first < need:  # position
                continue
            share = len(whole & block) / len(ordered)
            if share >= self.threshold - 1e-9:
                met[t] = share
        out: dict[str, float] = {}
        for t, share in met.items():
            label, _, whole, _ = self.sets[t]
            if not any(whole < self.sets[u][2] for u in met):
                out[label] = max(out.get(label, 0.0), share)
        return out

    def scan(self, ids: np.ndarray) -> dict[str, float]:
        """The same over all blocks of a text."""
        out: dict[str, float] = {}
        for n, by_word in self.by_run.items():
            hits = np.flatnonzero(self.rare[n][ids]) // n
            for b in np.unique(np.concatenate([hits, hits - 1])).tolist() if len(hits) else ():
                if b >= 0:
                    for label, share in self.best(set(ids[b * n : (b + 2) * n].tolist()) - {-1}, by_word).items():
                        out[label] = max(out.get(label, 0.0), share)
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES, phrases: dict = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score. Two passes over the texts, no shuffle of
    texts: one counts the templates' words, one joins."""
    words = _Words(templates, phrases)
    frequencies = word_frequencies(docs, words, text_col)

    def run(batches):
        index = TemplateJoin(words, frequencies, templates, threshold)
        runs = [(np.array([words.number[w] for w in p.split()]), label) for p, label in phrases.items()]
        for batch in batches:
            n = batch.num_rows
            out = [[0] * n, [0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n]
            for row, ids in _rows(batch.column(1), words):
                out[0][row] = len(ids)
                if not (ids >= 0).any():
                    continue
                places, labels = [], set()
                for phrase, label in runs:
                    m = len(ids) - len(phrase) + 1
                    if m > 0:
                        ok = ids[:m] == phrase[0]
                        for k in range(1, len(phrase)):
                            ok &= ids[k : k + m] == phrase[k]
                        found = np.flatnonzero(ok).tolist()
                        if found:
                            places += found
                            labels.add(label)
                more = index.scan(ids)
                if places:
                    out[1][row], out[2][row], out[3][row] = len(places), min(places), max(places)
                out[4][row], out[5][row] = ",".join(sorted(labels)), ",".join(sorted(labels | set(more)))
                out[6][row] = 1.0 if labels else max(more.values(), default=0.0)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(out, kinds)], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
