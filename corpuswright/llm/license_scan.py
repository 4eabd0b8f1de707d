"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a text, across line ends, whatever its
place. Its length depends on the template: the template's number of words over the
threshold. A block matches a template if it holds at least `threshold` of its
distinct words. Words are ordered by their frequency in the whole corpus, rarest
first. Three exact filters come before blocks are looked at: prefix (a text with a
match holds one of the template's first |T| - a + 1 words, where a is the number of
words needed), length (it has a words) and position (what remains on both sides
can still reach a). The blocks around the words that are left are then slid over.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, binary_column

#: The phrases that always count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license texts and notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
        "the distribution.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("cc", "This work is licensed under a Creative Commons Attribution License"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
#: Everything below U+0080 that is no digit or letter becomes a space.
_CLEAN = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_TO_WORDS = bytes(_CLEAN[b] for b in LOWER_BYTES)


def words_of_template(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


class TemplateIndex:
    """Inverted index of the templates' prefixes in a global order of words. Templates go by their number."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.frequency = frequency
        self.label = [label for label, _ in templates]
        words = [words_of_template(t) for _, t in templates]
        self.sets = [frozenset(w) for w in words]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.block = [math.ceil(len(w) / threshold - 1e-9) for w in words]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            order = self.in_order(s)
            for i, w in enumerate(order[: len(order) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.vocabulary = frozenset().union(*self.sets)

    def in_order(self, words) -> list[bytes]:
        return sorted(words, key=lambda w: (self.frequency.get(w, 0), w))

    def candidates(self, found: frozenset[bytes] | set[bytes], size: int) -> list[int]:
        """The templates of which a text holds the share that a block needs. found: its words of the vocabulary; size: its distinct words."""
        if self.prefix.keys().isdisjoint(found):
            return []
        order = self.in_order(found)
        seen: set[int] = set()
        out = []
        for j, w in enumerate(order):
            for k, i in self.prefix.get(w, ()):
                # the first shared word decides: what is left on both sides, it included
                if k in seen or size < self.need[k]:
                    continue
                seen.add(k)
                if min(len(self.sets[k]) - i, len(order) - j) >= self.need[k] and len(self.sets[k] & found) >= self.need[k]:
                    out.append(k)
        return out

    def best_block(self, k: int, places: list[tuple[int, bytes]]) -> int:
        """The most distinct words of template k in one block. places: (position, word) of the text's words of the vocabulary, in order."""
        own, length = self.sets[k], self.block[k]
        held: dict[bytes, int] = {}
        inside: deque[tuple[int, bytes]] = deque()
        most = 0
        for at, w in places:
            if w not in own:
                continue
            inside.append((at, w))
            held[w] = held.get(w, 0) + 1
            while inside[0][0] <= at - length:
                _, old = inside.popleft()
                held[old] -= 1
                if not held[old]:
                    del held[old]
            most = max(most, len(held))
        return most

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """Containment of each template that a block of the text matches, the best of its blocks."""
        found = self.vocabulary.intersection(words)
        some = self.candidates(found, len(set(words))) if found else []
        places = [(i, w) for i, w in enumerate(words) if w in found] if some else []
        best = {k: self.best_block(k, places) for k in some}
        return {k: n / len(self.sets[k]) for k, n in best.items() if n >= self.need[k]}


#: Bytes of a caller's template table at most: it is held by the driver and by every worker.
MOST_TEMPLATES = 16 << 20


def template_rows(templates: DataFrame | None) -> list[tuple[str, str]]:
    """(label, text) of a caller's table of templates, whose size is checked first; TEMPLATES without one. Rows without a label or a word are left out."""
    if templates is None:
        return TEMPLATES
    rows = templates.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("label"))).first()[0] or 0
    if size > MOST_TEMPLATES:
        raise ValueError(f"templates of {size} bytes; at most {MOST_TEMPLATES} can travel to the workers: scan by parts of the table")
    return sorted((r.label, r.text) for r in rows.distinct().collect() if words_of_template(r.text))


def word_frequency(docs: DataFrame, templates: list[tuple[str, str]], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates occurs in all texts. At most a row a template word reaches the driver."""
    import pyarrow as pa

    vocabulary = frozenset().union(*(words_of_template(t) for _, t in templates))

    def count(batches):
        total = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for t in binary_column(b, "_text"):
                for w in filter(vocabulary.__contains__, (t or b"").translate(_TO_WORDS).split()):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def phrase_places(flat: bytes, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of all places of the phrases; flat: words joined and enclosed by single spaces."""
    out = []
    for phrase, label in phrases.items():
        pattern, at = b" " + phrase.encode() + b" ", 0
        while (at := flat.find(pattern, at)) >= 0:
            out.append((flat.count(b" ", 0, at), label))
            at += 1
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters from
    U+0080 on. labels adds those of the templates that a block of the text matches;
    score is the greatest containment among these, 0 without a match. A null text
    is empty. Templates are the caller's table (label, text) of 16 MB at most, or
    TEMPLATES; their corpus frequencies come from a first pass over all texts. Each
    text is then scanned where it is read, with no shuffle, in time linear in it for
    each template that passes the filters.
    """
    import pyarrow as pa

    known = template_rows(templates)
    index = TemplateIndex(known, word_frequency(docs, known, text_col), threshold)

    def one(text: bytes | None):
        clean = (text or b"").translate(_TO_WORDS)
        words = clean.split()
        places = phrase_places(b" " + b" ".join(words) + b" ") if b"license" in clean else []
        base = sorted({label for _, label in places})
        best = index.matches(words)
        labels = {*base, *(index.label[k] for k in best)}
        return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted(labels)), max(best.values(), default=0.0))

    kinds = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double")]

    def run(batches):
        for b in batches:
            rows = [one(t) for t in binary_column(b, "_text")]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(cols, kinds, strict=True))], ["id", *(n for n, _, _ in kinds)])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"{n} {t}" for n, _, t in kinds)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
