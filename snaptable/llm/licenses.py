"""Licence scans with a suffix automaton of licence words (operator 12).

One automaton holds all templates: its states are the words' substrings, so that of a text read word by word
the longest suffix which is a substring of some template is known after each word (the matching statistics).
Matches that cannot go on are looked up with the places where templates have them; matches of a template that
follow one another in it and in the text are chained, and a chain that covers enough of its template is a span.
Phrases are templates of their own: one ends wherever its state is on the chain of suffixes of the current match.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import batch_blocks
from .scratch import tidied

#: A word of a lower-cased text in UTF-8: digits, letters and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP_BYTE = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Words of a match that is chained, at least; words between matches of a chain, at most; share of a template to cover.
MATCH, GAP, SHARE = 4, 16, 0.6
#: Bytes of a text that become words at a time.
PIECE = 1_000_000


@dataclass(frozen=True)
class Template:
    """A licence text and the share of its words that a span must cover."""

    label: str
    text: str
    share: float = SHARE


#: Phrases and their labels.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

#: Public licence notices and texts. Notices, which differ in a word from others, must be there as a whole.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", 1.0),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", 1.0),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", 1.0),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0),
    Template("mit-notice", "Released under the MIT License", 1.0),
    Template(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    Template(
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    Template(
        "apache-2.0-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    Template(
        "gpl-text",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    Template("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
)


def words(text: str | bytes) -> list[bytes]:
    return WORD.findall((text if isinstance(text, bytes) else text.encode()).lower())


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, in lists of about so many bytes; no word is cut."""
    start = 0
    while len(text) - start > size:
        cut = _GAP_BYTE.search(text, start + size)
        if cut is None:
            break
        yield WORD.findall(text, start, cut.start())
        start = cut.start()
    yield WORD.findall(text, start) if start else WORD.findall(text)


@dataclass
class Automaton:
    """The suffixes of several sequences of words. A state is a set of substrings with the same ends; the longest has
    `length` words, and `link` is the state of its longest suffix with other ends."""

    texts: Sequence[list[bytes]]
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.length, self.link, self.next, self.ends = [0], [-1], [{}], [[]]
        for number, text in enumerate(self.texts):
            at = 0
            for end, w in enumerate(text, 1):
                at = self._extended(at, self.vocabulary.setdefault(w, len(self.vocabulary)))
                self.ends[at].append((number, end))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v]:
                self.ends[self.link[v]] += self.ends[v]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        for column, x in ((self.length, length), (self.link, link), (self.next, following), (self.ends, [])):
            column.append(x)
        return len(self.length) - 1

    def _extended(self, last: int, w: int) -> int:
        """The state of last's longest string and w, added if no text has it so far."""
        if w in self.next[last]:
            old = self.next[last][w]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, w)
        own, v = self._state(self.length[last] + 1, 0, {}), last
        while v >= 0 and w not in self.next[v]:
            self.next[v][w] = own
            v = self.link[v]
        if v >= 0:
            old = self.next[v][w]
            self.link[own] = old if self.length[old] == self.length[v] + 1 else self._split(v, w)
        return own

    def _split(self, v: int, w: int) -> int:
        """Strings of v's successor that are no longer than v's and w become a state of their own."""
        old = self.next[v][w]
        own = self._state(self.length[v] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = own
        while v >= 0 and self.next[v].get(w) == old:
            self.next[v][w] = own
            v = self.link[v]
        return own

    def state(self, text: list[bytes]) -> int:
        at = 0
        for w in text:
            at = self.next[at][self.vocabulary[w]]
        return at


class Scanner:
    """Finds phrases and chains of template matches in texts."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, match: int = MATCH, gap: int = GAP):
        self.templates, self.labels, self.match, self.gap = templates, [label for label, _ in phrases], match, gap
        own = [words(t.text) for t in templates]
        named = [words(p) for _, p in phrases]
        self.sizes = list(map(len, own))
        self.automaton = a = Automaton(own + named)
        of: dict[int, list[tuple[int, int]]] = {}
        for number, phrase in enumerate(named):
            if phrase:
                of.setdefault(a.state(phrase), []).append((len(phrase), number))
        # Phrases that are suffixes of a state's longest string; shorter states first, as links lead to those.
        self.phrases: list[tuple] = [()] * len(a.length)
        for v in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            self.phrases[v] = (*of.get(v, ()), *self.phrases[a.link[v]])
        # Occurrences in templates only, of states whose strings may be long enough to chain.
        self.occurrences = [[(t, e) for t, e in ends if t < len(own)] if n >= match else [] for n, ends in zip(a.length, a.ends, strict=True)]

    def statistics(self, text: bytes) -> Iterator[tuple[int, int, int, bool]]:
        """place, state, length of the longest match that ends there, and whether the next word makes it longer; for
        words that some template has beside another such word. Afterwards `read` is the number of words."""
        a, known, before = self.automaton, self.automaton.vocabulary.get, 0
        following, link, length = a.next, a.link, a.length
        v = n = 0
        held = None  # the last place, as it is not known yet whether its match goes on
        for own in pieces(text):
            ids = np.fromiter(map(known, own, itertools.repeat(-1)), np.int64, len(own))
            at = np.flatnonzero(ids >= 0)
            if len(at):
                breaks = np.flatnonzero(np.diff(at) != 1)
                for start, end in zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, -1)] + 1).tolist(), strict=True):
                    if end - start == 1 and start and end < len(own):
                        continue
                    if start:
                        if held:
                            yield *held, False
                        held, v, n = None, 0, 0
                    for place, w in enumerate(ids[start:end].tolist(), before + start):
                        grown = True
                        while v and w not in following[v]:
                            v = link[v]
                            n, grown = length[v], False
                        v = following[v][w]
                        n += 1
                        if held:
                            yield *held, grown
                        held = (place, v, n)
            if own and (not len(at) or at[-1] != len(own) - 1):
                if held:
                    yield *held, False
                held, v, n = None, 0, 0
            before += len(own)
        if held:
            yield *held, False
        self.read = before

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]], float]:
        """n words, places (label, first word), spans (label, first word, last word, words covered, share of the
        template) and the greatest share of a template or phrase in the text."""
        text, places, anchors = text.lower(), [], {}
        for place, v, n, grows in self.statistics(text):
            for size, number in self.phrases[v]:
                if size <= n:
                    places.append((self.labels[number], place - size + 1))
            if n >= self.match and not grows:
                for template, end in self.occurrences[v]:
                    anchors.setdefault(template, []).append((place - n + 1, place + 1, end - n, end))
        spans, best = [], 1.0 if places else 0.0
        for template, own in sorted(anchors.items()):
            for first, last, covered in self.chains(own):
                share = covered / self.sizes[template]
                best = max(best, share)
                if share >= self.templates[template].share:
                    spans.append((self.templates[template].label, first, last, covered, share))
        return self.read, places, sorted(spans, key=lambda s: (s[1], s[0])), best

    def chains(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """first word, last word, words covered of disjoint chains of a template's matches (start and end in the text, start
        and end in the template; by end in the text), the best ones first."""
        score, came, low = [], [], 0
        for k, (start, end, t_start, t_end) in enumerate(anchors):
            best, previous = end - start, -1
            while low < k and anchors[low][1] < start - self.gap:
                low += 1
            for j in range(low, k):
                _, j_end, j_start, j_t_end = anchors[j]
                added = min(end - j_end, t_end - j_t_end, end - start)
                if added > 0 and t_start > j_start and t_start - j_t_end <= self.gap and score[j] + added > best:
                    best, previous = score[j] + added, j
            score.append(best)
            came.append(previous)
        used, found = set(), []
        for k in sorted(range(len(anchors)), key=lambda k: (-score[k], k)):
            chain, at = [], k
            while at >= 0 and at not in used:
                chain.append(at)
                at = came[at]
            if at < 0 and chain:
                used.update(chain)
                found.append((anchors[chain[-1]][0], anchors[k][1] - 1, score[k]))
        return found


SCANNED = "n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,covered:long,share:double>>, score double"


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, match: int = MATCH, gap: int = GAP) -> DataFrame:
    """doc_id, n_words, places (every phrase found: its label and first word, from 0), spans (every chain that covers its
    template's share: label, first and last word, words covered, share) and score (the greatest share of a template
    covered; 1 where there is a phrase).

    A row for every row of docs, made where it lies: no shuffle. A null text is an empty one, without words, places or
    spans, and scores 0. Texts of any length count whole, their words a piece at a time. Repeated rows and null doc_ids
    have rows of their own; equal texts have equal results. Other columns are not read. An empty table gives none.
    """
    scanner = Scanner(templates, phrases, match, gap)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batch_blocks(b, rows=2_000)):
            found = [scanner.scan(t or b"") for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            n, places, spans, score = zip(*found, strict=True)
            places = pa.array([[{"label": x, "word": w} for x, w in p] for p in places], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])))
            names = ("label", "first", "last", "covered", "share")
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in own] for own in spans], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), places, spans, pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(scan), f"doc_id {kind}, {SCANNED}")


def license_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scan_licenses()'s rows."""
    at = F.col("places.word")
    base = F.array_distinct(F.col("places.label"))
    joined = [F.array_join(F.array_sort(x), ",") for x in (base, F.array_union(base, F.col("spans.label")))]
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined[0].alias("base_labels"), joined[1].alias("labels"), "score")
