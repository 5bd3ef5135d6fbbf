"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are sets of words, without function words, which tell nothing.  A template's blocks are the overlapping windows of
twice its words or more, half of that apart, over the whole text, so that a notice lies whole in one however it is wrapped
(line ends separate words as other signs do); and each line, a longer one cut into windows likewise.  Template
words are ordered by their document frequency over the whole corpus, rarest first (one distributed count, at most one
row a template word).  A block that holds at least t of a template's n words must hold one of the first
n - ceil(t n) + 1 in this order, so only those are indexed (prefix filter); a block of fewer words than ceil(t n) is
out (length filter); and a match at place p of a prefix leaves at most n - p words in common, counting on from the
words already found in common (positional filter).  What is left is verified; a template that names a license also
demands the words that give the name.  A template of fewer than `IN_ORDER` words is too short for a bag of words: its words,
function words too, must also stand in order, the threshold's share of them in as many neighbouring words as it has.  The
templates are a fixed, small list.

The base part counts the places where a phrase's words stand one after the other.

Nulls: a null text is the empty text.  doc_id is of any type.  Repeated rows are scanned one by one, alike; very long texts are
read whole; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import table, through_python

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lower(text: str) -> str:
    """Lower-cases A-Z only; bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")



# The phrases and labels of the base part.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Function words, which no template counts.
FUNCTION_WORDS = frozenset("a an and any are as at be by either for from if in into is it not of on or shall that the this to under with you".split())

# Notices and license texts in their usual words, and the labels that the method adds.
TEMPLATES = {
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
}
# The words without which a notice does not name its license.
NAMES = {"gpl-notice": ("gnu", "public"), "gpl-header": ("gnu",), "gpl-warranty": ("gnu",), "apache-notice": ("apache",), "apache-header": ("apache",), "cc-by-nc": ("cc", "nc"), "mit-notice": ("mit",), "mpl-header": ("mozilla", "mpl")}
THRESHOLD, IN_ORDER = 0.8, 10

_ANY = re.compile("|".join(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(map(re.escape, p.split())) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])" for p in PHRASES))


def phrase_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, places): text must be lower case; places are (word index, label)."""
    if not any(all(w in text for w in p.split()) for p in PHRASES) or not _ANY.search(text):
        return len(WORD.findall(text)), []
    starts, words = [], []
    for m in WORD.finditer(text):
        starts.append(m.start())
        words.append(m[0])
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words) - len(own) + 1) if words[i] == own[0] and words[i : i + len(own)] == own]
    return len(words), sorted(places)


def template_words(text: str) -> set[str]:
    own = set(WORD.findall(lower(text)))
    return own - FUNCTION_WORDS or own


def in_order(template: list[str], block: list[str], names: set[str]) -> int:
    """The most words of the template that stand in its order in as many neighbouring words of the block, which hold all names."""
    n, best, known = len(template), 0, set(template)
    for i, w in enumerate(block):
        if w not in known:
            continue
        own = block[i : i + n]
        if not names <= set(own):
            continue
        row = [0] * (n + 1)  # longest common subsequence, row by row
        for x in own:
            last = 0
            for k, y in enumerate(template):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
        best = max(best, row[n])
    return best


class TemplateJoin:
    """Templates in the global order of words, with the index over their prefixes, and the windows for them."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], threshold: float = THRESHOLD):
        self.need, self.sets, self.index, self.names, self.short = {}, {}, {}, {}, {}
        self.size = 2 * max((len(WORD.findall(lower(t))) for t in templates.values()), default=8)
        for name, text in templates.items():
            words = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
            self.sets[name], self.names[name] = words, set(NAMES.get(name, ()))
            every = WORD.findall(lower(text))
            if len(every) < IN_ORDER:
                self.short[name] = every, math.ceil(threshold * len(every) - 1e-9)
            self.need[name] = need = max(1, math.ceil(threshold * len(words) - 1e-9))
            for p, w in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(w, []).append((name, p))
        self.least = min(self.need.values(), default=0)
        self.any = re.compile("|".join(sorted(map(re.escape, self.index), key=len, reverse=True)) or "(?!)")

    def match(self, block: list[str]) -> dict[str, float]:
        """Containment of each template that reaches the threshold in the block."""
        own = set(block)
        if len(own) < self.least:
            return {}
        seen: dict[str, int] = {}
        found = {}
        for w in own & self.index.keys():
            for name, p in self.index[w]:
                seen[name] = min(p, seen.get(name, p))
        for name, p in seen.items():  # p: place of the rarest prefix word in common
            words, need = self.sets[name], self.need[name]
            if len(own) < need or len(words) - p < need or not self.names[name] <= own:
                continue
            common = sum(w in own for w in words[p:])
            if common < need:
                continue
            every, least = self.short.get(name, ((), 0))
            if not every or in_order(every, block, self.names[name]) >= least:
                found[name] = common / len(words)
        return found

    def blocks(self, text: str):
        """Word lists of the text's blocks that hold an indexed word: windows over the whole text, and its lines."""
        if not self.any.search(text):
            return
        yield from self.windows(WORD.findall(text))
        lines = text.split("\n")
        if len(lines) > 1:
            for line in lines:
                if self.any.search(line):
                    yield from self.windows(WORD.findall(line))

    def windows(self, words: list[str]):
        size = self.size
        if len(words) <= size:
            yield words
            return
        places = [i for i, w in enumerate(words) if w in self.index]
        for s in range(0, len(words) - size // 2, size // 2):
            k = bisect_right(places, s - 1)
            if k < len(places) and places[k] < s + size:
                yield words[s : s + size]

    def search(self, text: str) -> dict[str, float]:
        """The best containment of each template in a text, which must be lower case."""
        found: dict[str, float] = {}
        for block in self.blocks(text):
            for name, v in self.match(block).items():
                found[name] = max(v, found.get(name, 0.0))
        return found


def template_joins(templates: dict[str, str], frequency: dict[str, int], threshold: float = THRESHOLD) -> list[TemplateJoin]:
    """A join for the templates of like length each: a short notice is looked for in short windows."""
    kinds: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        kinds.setdefault(max(4, len(WORD.findall(lower(text))).bit_length()), {})[name] = text
    return [TemplateJoin(own, frequency, threshold) for _, own in sorted(kinds.items())]


def template_frequency(df: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """Documents that hold each template word, over all documents; at most one row a template word."""
    words = sorted({w for t in templates.values() for w in template_words(t)})

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for t in b["text"]:
                if isinstance(t, str):
                    own = set(WORD.findall(lower(t)))
                    total += np.fromiter((w in own for w in words), np.int64, len(words))
        yield pd.DataFrame({"word": words, "n": total})

    got = df.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in got.collect()}


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)"""
    frequency = template_frequency(df, templates)

    def run(batches):
        joins = template_joins(templates, frequency, threshold)
        for b in batches:
            rows = []
            for t in b["text"]:
                t = lower(t) if isinstance(t, str) else ""
                n, places = phrase_places(t)
                found = {k: v for join in joins for k, v in join.search(t).items()}
                base = sorted({x for _, x in places})
                score = max([1.0 if base else 0.0, *found.values()])
                rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(sorted({*base, *found})), score))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return through_python(df.select("doc_id", "text"), ("doc_id",), run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
