"""Operator 7: licence scans by a positional rare-token index.

Licences are templates of words with mandatory key phrases. The inverse document frequency of every
template word is counted over all documents, and the index files a key phrase under its word of the highest
IDF, with that word's position in it. Of a file's words, those that have such an entry are looked up,
from the highest IDF down; their places are shifted by the posting's position and intersected with the
places of the phrase's other words, shifted by theirs, again from the highest IDF down, until none is
left or all words agree. So every key phrase in the file is found, and common words are looked at only
where rare ones stand. All key phrases of a template must stand, in their order and about as far apart
as in the template, so that filled-in names and small edits between them do no harm. Phrases of one or
a few words are templates that are all key phrase.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, read_table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """A licence text: its label, its words, and key phrases that must all stand, in the order of the text."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: Base phrases, each wholly mandatory.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Notices of further licences: sentences that name or grant them.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("gpl-2", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3", "gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("this program is free software you can redistribute it",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


#: Whole licence texts as they are published, without their titles and copyright lines.
TEXTS = (
    Template("mit-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("Permission is hereby granted, free of charge", "The above copyright notice and this permission notice shall be included", "THE SOFTWARE IS PROVIDED AS IS")),
    Template("isc-full", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("with or without fee is hereby granted", "appear in all copies", "THE AUTHOR DISCLAIMS ALL WARRANTIES")),
    Template("bsd-3-clause-full", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("Redistribution and use in source and binary forms", "to endorse or promote products derived from this software", "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")),
    Template("zlib-full", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
        ("Permission is granted to anyone to use this software for any purpose", "The origin of this software must not be misrepresented", "This notice may not be removed or altered from any source distribution")),
    Template("bsl-1.0-full", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
        ("accompanying documentation covered by this license", "machine-executable object code generated by a source language processor")),
    Template("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing", "See the License for the specific language governing permissions and limitations")),
    Template("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        ("under the terms of the GNU General Public License as published by the Free Software Foundation", "WITHOUT ANY WARRANTY without even the implied warranty", "You should have received a copy of the GNU General Public License")),
    Template("unlicense-full", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
        ("free and unencumbered software released into the public domain", "dedicate any and all copyright interest in the software to the public domain")),
)
#: Words that may be added or missing between two key phrases, and the share of the template's words between them that may.
SLACK_WORDS, SLACK_SHARE = 8, 0.25


class Index:
    """Key phrases by their word of the highest IDF: postings (phrase, position), and the positions of the phrase's other words, rarer ones first."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]):
        self.templates = templates
        self.words = [words_of(t.text.encode()) for t in templates]
        self.phrases: list[tuple[int, int, int]] = []  # template, place in it, words
        self.keys: list[list[int]] = []  # of each template, its phrases
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.others: list[list[tuple[bytes, int]]] = []
        self.rank: dict[bytes, tuple[float, bytes]] = {}
        for k, (t, words) in enumerate(zip(templates, self.words, strict=True)):
            self.keys.append([])
            after = 0
            for key in t.keys:
                part = words_of(key.encode())
                after = next(p for p in range(after, len(words)) if words[p : p + len(part)] == part)
                self.rank.update((w, (-idf.get(w.decode(), 99.0), w)) for w in part)
                (word, within), *others = sorted(((w, p) for p, w in enumerate(part)), key=lambda x: (self.rank[x[0]], x[1]))
                self.postings.setdefault(word, []).append((len(self.phrases), within))
                self.others.append(others)
                self.keys[-1].append(len(self.phrases))
                self.phrases.append((k, after, len(part)))
        self.looked = 0  # places that lookups and intersections have gone through

    def phrases_in(self, words: list[bytes]) -> dict[int, list[int]]:
        """Where each key phrase stands in a file: ascending places of its first word."""
        places: dict[bytes, set[int]] = {}
        for at, word in enumerate(words):
            if word in self.rank:
                places.setdefault(word, set()).add(at)
        found: dict[int, list[int]] = {}
        for word in sorted(places.keys() & self.postings.keys(), key=self.rank.__getitem__):
            for phrase, within in self.postings[word]:
                starts = [at - within for at in places[word]]
                self.looked += len(starts)
                for other, position in self.others[phrase]:
                    there = places.get(other, ())
                    starts = [at for at in starts if at + position in there]
                    if not starts:
                        break
                    self.looked += len(starts)
                if starts:
                    found[phrase] = sorted(starts)
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its words that agree) of every verified licence."""
        found = self.phrases_in(words)
        shares = []
        for k, keys in enumerate(self.keys):
            if not all(found.get(p) for p in keys):
                continue
            for first in found[keys[0]]:
                offsets = [first - self.phrases[keys[0]][1]]
                for before, p in zip(keys, keys[1:], strict=False):
                    # the next key phrase nearest to where the template has it
                    gap = self.phrases[p][1] - self.phrases[before][1]
                    want, slack = offsets[-1] + self.phrases[p][1], max(SLACK_WORDS, int(gap * SLACK_SHARE))
                    near = found[p][max(0, (i := bisect_left(found[p], want)) - 1) : i + 1]
                    near = [at for at in near if abs(at - want) <= min(slack, gap - 1)]
                    if not near:
                        break
                    offsets.append(min(near, key=lambda at: abs(at - want)) - self.phrases[p][1])
                else:
                    shares.append((k, offsets[0], self._share(k, offsets, words)))
        return sorted(shares)

    def _share(self, k: int, offsets: list[int], words: list[bytes]) -> float:
        """Of a template's words, the share that stands where one of its key phrases puts it."""
        own = self.words[k]
        return sum(any(0 <= at + p < len(words) and words[at + p] == w for at in set(offsets)) for p, w in enumerate(own)) / len(own)


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the UTF-8 text after lower-casing A-Z."""
    return _WORD.findall(text.lower()) if text else []


_COUNT = pa.schema([("word", pa.string()), ("docs", pa.int64())])


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template word stands, over all of them.

    Only words of the templates are counted, so tasks return a bounded table.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for value in part.column(0):
                    counts[""] += 1
                    if value.is_valid:
                        counts.update({w.decode() for w in vocabulary.intersection(words_of(value.as_py()))})
        yield batch_of(_COUNT, list(counts), list(counts.values()))

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    counts = {r["word"]: r["docs"] for r in rows}
    return counts.pop("", 0), counts


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])))])


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES + TEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, matches) of every whole text: each licence with its place in words and the share of its words there.

    Null and empty texts have no words and no matches. Texts are scanned whole, however long; a very long one is
    scanned by itself. Repeated rows are scanned each; ids may be null; further columns are not read. An empty
    table gives no rows.
    """
    number, seen = document_frequencies(docs, templates, text)
    idf = {w: log((number + 1) / (seen.get(w, 0) + 1)) for t in templates for w in (x.decode() for x in words_of(t.text.encode()))}
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, idf))  # the templates' words only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words, matches = [], []
                for value in part.column(1):
                    words = words_of(value.as_py())
                    n_words.append(len(words))
                    matches.append([{"label": index.templates[k].label, "base": index.templates[k].base, "first_word": at, "n_words": len(index.words[k]), "share": share} for k, at, share in index.scan(words)])
                yield batch_of(_OUT, part.column(0), n_words, matches)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, matches array<struct<label string, base boolean, first_word long, n_words long, share double>>")


def op7_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(read_table(spark, sf_dir, "documents")).withColumn("b", F.filter("matches", lambda m: m["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform("b", lambda m: m["first_word"])).alias("last_word"),
        labels(F.col("b")).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
