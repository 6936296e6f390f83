"""Licence scan by a positional index of licence words, rarest first.

The index has postings: for each word all its places (template, position) in the templates, which are notices and
the paragraphs of licences' published texts. Document frequencies of all template words are counted over the
whole table and give each word's weight (IDF). A template is open for a file that has all words of its key phrase
and words of half its weight. A file's own licence words are looked up, highest weight first; a word's places, less
its positions in the postings of open templates, propose alignments. A template is closed when a word of its key
phrase was looked up, or when words not looked up yet weigh less than half of it: then each alignment that can
count has been proposed. The postings of all the file's licence words are intersected with what is proposed, by
start, and an alignment counts if its mandatory key phrase stands there, word by word, and enough of the
template's weight is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.common import chunks, prefix_hash, small_batches, span_hash, text_bytes, words

#: Bytes that are part of no word: all of ASCII but digits and lower-case letters (upper case is lowered before).
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Share of a template's weight that an alignment must have.
ENOUGH = 0.5
#: Files that are looked up together, and places whose postings are met at a time; they bound memory alone.
FILES, PLACES = 256, 1 << 15

# Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Customary notices of licences, and paragraphs of their published texts, as (label, words, mandatory key phrase).
NOTICES = [
    ("mit", "released under the MIT license", "mit license"),
    ("mit", "licensed under the MIT license", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "permission is hereby granted free of charge"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "permission notice shall be included in all copies or substantial portions"),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE', "fitness for a particular purpose and noninfringement"),
    ("apache", "licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "you may not use this file except in compliance with the license"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", "distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the GNU General Public License version 3", "gnu general public license"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "gnu general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License", "affero general public license"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "names of its contributors may be used to endorse or promote products"),
    ("bsd", "licensed under the BSD license", "bsd license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "permission is granted to anyone to use this software for any purpose"),
    ("boost", "licensed under the Boost Software License, Version 1.0", "boost software license"),
    ("cc-by", "licensed under CC BY 4.0", "cc by 4"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("creative-commons", "licensed under a Creative Commons Attribution license", "creative commons attribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", "copyright license to reproduce prepare derivative works of"),
    ("apache", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions", "copies of the work or derivative works thereof in any medium"),
    ("apache", "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file", "permission to use the trade names trademarks service marks or product names of the licensor"),
    ("gpl", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software", "designed to take away your freedom to share and change"),
    ("gpl", "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software", "referring to freedom not price"),
    ("gpl", "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty", "verbatim copies of the program s source code as you receive it"),
    ("gpl", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice", "convey verbatim copies of the program s source code"),
    ("gpl", "You may not impose any further restrictions on the exercise of the rights granted or affirmed under this License", "restrictions on the exercise of the rights granted or affirmed under this license"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "gnu lesser general public license"),
    ("lgpl", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below", "gnu lesser general public license incorporates"),
    ("agpl", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version", "users interacting with it remotely through a computer network"),
    ("mpl", "Covered Software is provided under this License on an as is basis, without warranty of any kind, either expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a particular purpose or non-infringing", "covered software is provided under this license on an as is basis"),
    ("mpl", "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License", "distribution of covered software in source code form"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "this software is provided by the copyright holders and contributors as is"),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", "author disclaims all warranties with regard to this software"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", "person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


class Index:
    """Templates by position; df: documents that hold each word, of `docs` documents.

    Weights are whole millionths, so that sums don't depend on the order in which words are found.
    """

    def __init__(self, df: dict[str, int] | None = None, docs: int = 0):
        split = lambda text: WORD.findall(text.lower())
        self.templates = [(label, split(text), split(text), True) for text, label in BASE.items()]
        self.templates += [(label, split(notice), split(key), False) for label, notice, key in NOTICES]
        self.vocabulary = sorted({w for _, ws, _, _ in self.templates for w in ws})
        hashes = np.array([_word_hash(w) for w in self.vocabulary], np.uint64)
        self.by = np.argsort(hashes)
        self.hashes = hashes[self.by]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        df = df or {}
        idf = np.array([np.log((docs + 1) / (df.get(w, 0) + 0.5)) for w in self.vocabulary])
        self.idf = np.maximum(np.rint(1e6 * idf), 1).astype(np.int64)
        self.order = np.argsort(-self.idf, kind="stable")
        self.ids = [np.array([number[w] for w in ws]) for _, ws, _, _ in self.templates]
        self.key_at = np.array([next(i for i in range(len(ws)) if ws[i : i + len(key)] == key) for _, ws, key, _ in self.templates])
        self.key_size = np.array([len(key) for _, _, key, _ in self.templates])
        self.longest = max(len(ids) for ids in self.ids)
        # by word and template: its weight in the template, and whether the key phrase has it
        self.part = np.zeros((len(self.vocabulary), len(self.templates)), np.int64)
        self.key = np.zeros(self.part.shape, np.int32)
        for t, ids in enumerate(self.ids):
            np.add.at(self.part[:, t], ids, self.idf[ids])
            self.key[ids[self.key_at[t] : self.key_at[t] + self.key_size[t]], t] = 1
        self.total = self.part.sum(axis=0)
        # postings, by word: template and position of each of its places
        places = sorted((i, t, at) for t, ids in enumerate(self.ids) for at, i in enumerate(ids.tolist()))
        self.post_word, self.post_template, self.post_at = (np.array(c) for c in zip(*places))

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, or -1."""
        i = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashed, self.by[i], -1)

    def postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of each of these words: which word it is of, and the posting's number."""
        lo, hi = (np.searchsorted(self.post_word, words, side) for side in ("left", "right"))
        many = hi - lo
        return np.repeat(np.arange(len(words)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)

    def looked_up(self, has: np.ndarray) -> np.ndarray:
        """By file, word and template: whether the file is looked up by the word in the template's postings.

        has: by file and word. Words go by weight, largest first, of equal ones the first in order.
        """
        asked = np.zeros((*has.shape, len(self.templates)), bool)
        left = has.astype(np.int64) @ self.part
        open_ = (has.astype(np.int32) @ self.key == self.key.sum(axis=0)) & (left >= ENOUGH * self.total)
        for w in self.order.tolist():
            file, within = np.flatnonzero(has[:, w]), np.flatnonzero(self.part[w])
            cells = np.ix_(file, within)
            asked[file[:, None], w, within] = open_[cells]
            left[cells] -= self.part[w, within]
            open_[cells] &= (left[cells] >= ENOUGH * self.total[within]) & (self.key[w, within] == 0)
            if not open_.any():
                break
        return asked

    def alignments(self, at: np.ndarray, text: np.ndarray, word: np.ndarray, files: int) -> np.ndarray:
        """Proposed alignments, each once: rows of file, template, start. From places of licence words: place, file, word."""
        found = [np.zeros((0, 3), np.int64)]
        for lo in range(0, files, FILES):
            span = slice(*np.searchsorted(text, [lo, lo + FILES]))
            has = np.zeros((min(FILES, files - lo), len(self.vocabulary)), bool)
            has[text[span] - lo, word[span]] = True
            # files for which no template can be open have no part in the walk
            may = np.flatnonzero((has.astype(np.float32) @ self.key == self.key.sum(axis=0)).any(axis=1))
            row = np.full(len(has), -1)
            row[may] = np.arange(len(may))
            asked = self.looked_up(has[may])
            mine = np.flatnonzero(row[text[span] - lo] >= 0) + span.start
            mine = mine[asked[row[text[mine] - lo], word[mine]].any(axis=1)]
            of, post = self.postings(word[mine])
            place = mine[of]
            keep = asked[row[text[place] - lo], word[place], self.post_template[post]]
            place, post = place[keep], post[keep]
            found.append(np.unique(np.stack([text[place], self.post_template[post], at[place] - self.post_at[post]], axis=1), axis=0))
        return np.concatenate(found)

    def scan(self, numbers: np.ndarray, first: np.ndarray):
        """Alignments that hold, over texts laid end to end: (text, start of the key phrase, label, share of weight, base)."""
        at = np.flatnonzero(numbers >= 0)
        text, word = np.searchsorted(first, at, "right") - 1, numbers[at]
        proposed = self.alignments(at, text, word, len(first) - 1)
        if not len(proposed):
            return
        wide, many = len(numbers) + self.longest + 1, len(self.templates)
        # rows are sorted, so the numbers that name them are as well
        names = (proposed[:, 0] * many + proposed[:, 1]) * wide + proposed[:, 2] + self.longest
        weight, keyed = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        # licence words of files with proposals: their postings, met by file, template and start
        near = np.flatnonzero(np.isin(text, proposed[:, 0]))
        for part in np.array_split(near, len(near) // PLACES + 1):
            of, post = self.postings(word[part])
            place, template = part[of], self.post_template[post]
            name = (text[place] * many + template) * wide + at[place] - self.post_at[post] + self.longest
            i = np.minimum(np.searchsorted(names, name), len(names) - 1)
            met = names[i] == name
            i, post, template = i[met], post[met], template[met]
            np.add.at(weight, i, self.idf[self.post_word[post]])
            within = self.post_at[post] - self.key_at[template]
            np.add.at(keyed, i, (within >= 0) & (within < self.key_size[template]))
        template = proposed[:, 1]
        holds = (keyed == self.key_size[template]) & (weight >= ENOUGH * self.total[template])
        for i in np.flatnonzero(holds).tolist():
            t = int(template[i])
            label, _, _, base = self.templates[t]
            yield int(proposed[i, 0]), int(proposed[i, 2] + self.key_at[t]), label, float(weight[i] / self.total[t]), base


def _presence(index: Index):
    """Documents that hold each word of the vocabulary; one row a word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                hashed, _, first = words(*text_bytes(part.column(0)), BREAK)
                numbers = index.numbers(hashed)
                known = np.flatnonzero(numbers >= 0)
                text = np.searchsorted(first, known, "right") - 1
                seen = np.unique(text * len(index.vocabulary) + numbers[known])
                total += np.bincount(seen % len(index.vocabulary), minlength=len(total))
                docs += part.num_rows
        names = [*index.vocabulary, ""]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*total.tolist(), docs])], names=["word", "docs"])

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared)
        for batch in batches:
            for part in chunks(batch, "text"):
                hashed, _, first = words(*text_bytes(part.column(1)), BREAK)
                n = part.num_rows
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set] = [set() for _ in range(n)]
                every: list[set] = [set() for _ in range(n)]
                score = np.zeros(n)
                for text, start, label, share, is_base in index.scan(index.numbers(hashed), first):
                    every[text].add(label)
                    score[text] = max(score[text], min(1.0, share))
                    if is_base:
                        base[text].add(label)
                        places[text].append(start - int(first[text]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p, default=None) for p in places], pa.int64()),
                        pa.array([max(p, default=None) for p in places], pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x)) for x in every]),
                        pa.array(score),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Licences of each document (doc_id, text; more columns are ignored).

    Returns a row for each row: doc_id, n_words, n_base (places of base phrases), first_word, last_word (their
    smallest and largest first word, from 0; null if none), base_labels, labels (sorted, comma-joined; empty
    if none) and score, the largest share of a notice's weight found (0 if none). Null texts are empty; null
    doc_ids and rows that repeat come through; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_presence(Index()), "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    df = {r.word: r.docs for r in counts.collect()}  # one row a word of the fixed templates
    total = df.pop("", 0)
    return rows.mapInArrow(_scan((df, total)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
