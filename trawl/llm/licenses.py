"""License scans by template-markup matching.

A license template is its wording with markup: `<<beginOptional>> ...
<<endOptional>>` may be absent, `<<var;words=n>>` stands for any 0 to n words.
A template is compiled into an automaton over words: one state per mandatory or
optional word and per word of a replaceable region, with empty moves around
what may be left out.  A text is accepted where a run of the automaton ends,
that is where all mandatory wording occurs exactly and in order.  Runs start
wherever the first mandatory words of a template occur; those places are found
by a byte search, so a text without them costs no more than the search.

Words are the runs of letters, digits and characters beyond ASCII, A-Z in lower
case.  Besides templates there are base phrases, plain sequences of words with
a label; both are parameters.

Defined results: null and empty texts have no words, no labels and score 0;
texts of any length are read in full; labels that match at the same place are all
given; repeated rows give repeated results, rows without doc_id too; an empty
table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_limits

#: Phrases and labels of the base scan.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: License notices and texts as published, with markup.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0",
    "mit-notice": "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "gpl-3.0": "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>>",
    "gpl-2.0": "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the License<<endOptional>>",
    "lgpl-2.1": "GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2.1 <<beginOptional>>of the License<<endOptional>>",
    "lgpl-3.0": "GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>>",
    "agpl-3.0": "GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License<<endOptional>>",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at <<var;words=12>> Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "cc0-1.0": "CC0 1.0 <<beginOptional>>Universal<<endOptional>>",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0",
    "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc-by-nd-4.0": "CC BY-ND 4.0",
    "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0",
    "mit-text": """<<beginOptional>>MIT License<<endOptional>> <<var;words=40>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=8>> and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=20>>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;words=20>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission""",
}

#: First mandatory words of a template by which its occurrences are searched, at most.
ANCHOR_WORDS = 4
SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def joined_words(text: str | None) -> tuple[bytes, int]:
    """The text's words, each with a space before and after, and their number."""
    words = text.encode().lower().translate(SEPARATORS).split() if text else []  # bytes: only A-Z change
    return b" " + b" ".join(words) + b" ", len(words)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Byte offsets where the phrase's words stand consecutively; they may overlap."""
    found, at = [], joined.find(phrase)
    while at >= 0:
        found.append(at)
        at = joined.find(phrase, at + 1)
    return found


def word_index(joined: bytes, at: int) -> int:
    return joined.count(b" ", 0, at)


@dataclass(frozen=True)
class Automaton:
    """steps[s]: moves of state s as (word or None for any, next state); free[s]: states reached without a word."""

    label: str
    steps: tuple
    free: tuple
    final: int
    anchor: bytes
    lead: int  # state in which the anchor's first word is read
    mandatory: tuple  # of each state: mandatory words read on the way
    total: int

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def run(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """Whether a run from words[at] is accepted, and the share of the mandatory wording that the best run reads."""
        states, best = self.closed({self.lead}), 0
        while True:
            if self.final in states:
                return True, 1.0
            best = max([best, *(self.mandatory[s] for s in states)])
            if at == len(words) or not states:
                return False, best / self.total
            w, at = words[at], at + 1
            states = self.closed({to for s in states for want, to in self.steps[s] if want is None or want == w})


def compile_template(label: str, template: str) -> Automaton:
    steps, free, mandatory = [[]], [[]], [0]
    opened: list[int] = []
    anchor: list[bytes] = []
    lead, anchoring = 0, True

    def state(count: int) -> int:
        steps.append([])
        free.append([])
        mandatory.append(count)
        return len(steps) - 1

    now = 0
    for token in re.findall(r"<<.*?>>|[^<]+", template, re.S):
        if token == "<<beginOptional>>":
            opened.append(now)
            anchoring = anchoring and not anchor
        elif token == "<<endOptional>>":
            free[opened.pop()].append(now)
        elif m := re.fullmatch(r"<<var;words=(\d+)>>", token):
            ends = []
            for _ in range(int(m[1])):
                to = state(mandatory[now])
                steps[now].append((None, to))
                ends.append(now)
                now = to
            for s in ends:
                free[s].append(now)
            anchoring = anchoring and not anchor
        else:
            for w in joined_words(token)[0].split():
                if not opened and anchoring and len(anchor) < ANCHOR_WORDS:
                    if not anchor:
                        lead = now
                    anchor.append(w)
                to = state(mandatory[now] + (not opened))
                steps[now].append((w, to))
                now = to
    base = mandatory[lead]
    counts = tuple(m - base for m in mandatory)
    return Automaton(label, tuple(map(tuple, steps)), tuple(map(tuple, free)), now, b" " + b" ".join(anchor) + b" ", lead, counts, counts[now])


@functools.cache
def automata(templates: tuple) -> tuple[Automaton, ...]:
    return tuple(compile_template(k, v) for k, v in templates)


def scan_text(text: str | None, phrases=PHRASES, templates=tuple(TEMPLATES.items())) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, template labels, score)."""
    joined, n = joined_words(text)
    total, first, last, base = 0, None, None, set()
    for phrase, label in phrases:
        if found := places(joined, b" " + phrase.encode() + b" "):
            total += len(found)
            base.add(label)
            first = found[0] if first is None else min(first, found[0])
            last = found[-1] if last is None else max(last, found[-1])
    labels, score, words, starts = set(), 0.0, None, None
    for a in automata(templates):
        for at in places(joined, a.anchor):
            if words is None:
                words, starts = joined.split(), [i for i, c in enumerate(joined[:-1]) if c == 0x20]
            accepted, share = a.run(words, bisect_left(starts, at))
            score = max(score, share)
            if accepted:
                labels.add(a.label)
                break
    if base:
        score = max(score, 0.5)
    return (
        n, total, None if first is None else word_index(joined, first), None if last is None else word_index(joined, last),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
    )


def scan(docs: DataFrame, phrases=PHRASES, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan of every row: doc_id and scan_text's results."""
    batch_limits(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    items = tuple(templates.items())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for b in batches:
            rows = list(zip(*(scan_text(t, phrases, items) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], names)

    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
