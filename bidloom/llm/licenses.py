"""Licence scans with a generalised suffix automaton of licence words.

The words of all templates (base phrases and notices) make one suffix automaton. Texts are streamed through it: at each word it
gives the longest run of words ending there that any template holds (matching statistics). The streams of a slice go in step,
one array operation for each word of the longest; long streams are cut into tiles that start as many words early as the longest
template has, which leaves every statistic as it is. Streams are the stretches of words that templates know at all, as no match
holds another word.

A base phrase ends where its state is the current one, or one of its suffixes. Matches of ``MIN_MATCH`` words or more that can't
be made longer are looked up in the notices (the places of a state are one range of the suffix tree's order), and matches of one
notice are chained: in order in text and notice, at most ``GAP`` words apart in the text. A chain that covers ``MIN_SHARE`` of
its notice is a span with the notice's label.

Null text counts as empty and has no words, labels or spans; its score is 0. Each row is handled by itself, so repeated rows,
ties and empty tables need no rule, and only the named id and text columns are read. Texts of any length are streamed whole.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidloom.llm.common import buffer, keyed, words

#: Least words of a match that is chained; a short notice's own length, if less.
MIN_MATCH = 4
#: Most words of a text between two matches of a chain.
GAP = 40
#: Least share of a notice's words that a chain covers.
MIN_SHARE = 0.6
#: Words of a tile, beside those it starts early.
TILE = 2048
#: The score of a text that names a licence by a base phrase and holds no notice.
NAMED = 0.5

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Public licence notices and declarations, with labels of their own.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit-license", "Released under the MIT License"),
    ("mit-license", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"""),
    ("agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"""),
    ("gnu-no-warranty", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """may be used to endorse or promote products derived from this software without specific prior written permission"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""),
)

#: Bytes that words don't hold, of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BETWEEN = np.zeros(256, bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x61] = BETWEEN[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SPAN = "struct<label:string,start:bigint,end:bigint,covered:bigint,share:double>"
SCHEMA = f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"


def template_words(text: str) -> list[bytes]:
    """The words of a text, lower-cased."""
    data, offsets = buffer(pa.array([text]))
    _, code, distinct = words(LOWER[data], offsets, BETWEEN)
    return distinct.take(pa.array(code)).to_pylist()


class Automaton(NamedTuple):
    """A generalised suffix automaton over the words of templates; state 0 is the empty run."""

    vocabulary: dict[bytes, int]
    link: np.ndarray  # the state of the longest suffix that is in another state
    length: np.ndarray  # words of a state's longest run
    keys: np.ndarray  # state * len(vocabulary) + word, sorted
    to: np.ndarray
    enter: np.ndarray  # a state's places are ends[enter:leave]
    leave: np.ndarray
    ends: np.ndarray  # last word of a place, over all templates end to end
    phrases: list[tuple[int, int, np.ndarray]]  # (state, words, states that have it as a suffix) of each base phrase
    bounds: list[int]  # first word of each template, and the end
    longest: int


def build(templates: list[list[bytes]], n_phrases: int) -> Automaton:
    """The automaton of all templates; the first ``n_phrases`` of them are also found by themselves."""
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in t] for t in templates]
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    owners: list[tuple[int, int]] = []  # (state, place) of every prefix

    def state(of: int, steps: dict[int, int], suffix: int) -> int:
        step.append(steps)
        length.append(of)
        link.append(suffix)
        return len(step) - 1

    def divided(p: int, w: int) -> int:
        """The state of p's longest run with w after it, made its own if it is shorter than what p leads to."""
        q = step[p][w]
        if length[q] == length[p] + 1:
            return q
        copy = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = copy
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    at = 0
    last_of: list[int] = []
    for template in coded:
        last = 0
        for w in template:
            p = last
            if w in step[p]:
                last = divided(p, w)
            else:
                last = state(length[p] + 1, {}, 0)
                while p >= 0 and w not in step[p]:
                    step[p][w] = last
                    p = link[p]
                if p >= 0:
                    link[last] = divided(p, w)
            owners.append((last, at))
            at += 1
        last_of.append(last)
    bounds = [0, *np.cumsum([len(t) for t in coded]).tolist()]

    children: list[list[int]] = [[] for _ in step]
    for s in range(1, len(step)):
        children[link[s]].append(s)
    own: list[list[int]] = [[] for _ in step]
    for s, where in owners:
        own[s].append(where)
    enter, leave = np.zeros((2, len(step)), np.int64)
    ends: list[int] = []
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            leave[s] = len(ends)
            continue
        enter[s] = len(ends)
        ends += own[s]
        stack.append((s, True))
        stack += [(c, False) for c in children[s]]

    width = max(1, len(vocabulary))
    keys, to = zip(*sorted((s * width + w, t) for s, steps in enumerate(step) for w, t in steps.items()), strict=True) if len(step) > 1 else ((), ())
    phrases = []
    for k in range(n_phrases):
        below, todo = np.zeros(len(step), bool), list(children[last_of[k]])
        while todo:
            s = todo.pop()
            below[s] = True
            todo += children[s]
        phrases.append((last_of[k], len(coded[k]), below))
    return Automaton(vocabulary, np.array(link), np.array(length), np.array(keys, np.int64), np.array(to, np.int64), enter, leave, np.array(ends, np.int64), phrases, bounds, max(map(len, coded), default=0))


def statistics(auto: Automaton, word: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, matched words) at each word; 0 where a stretch of known words is shorter than ``least``.

    ``word`` has the automaton's codes or -1; ``of`` the first word of each text, and the end.
    """
    state, matched = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    known = np.append(word >= 0, False)
    first = known.copy()
    first[1:] &= ~known[:-1]
    edge = of[:-1][of[:-1] < len(word)]
    first[edge] = known[edge]
    begin = np.flatnonzero(first)
    stop = np.append(np.flatnonzero(~known), len(word))
    stop = np.minimum(stop[np.searchsorted(stop, begin)], of[np.searchsorted(of, begin, "right")])
    begin, stop = begin[stop - begin >= least], stop[stop - begin >= least]
    tiles = -(-(stop - begin) // TILE)
    to = np.repeat(np.arange(len(begin)), tiles)
    nth = np.arange(len(to)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    own = begin[to] + nth * TILE
    start = np.maximum(own - auto.longest, begin[to])
    size = np.minimum(own + TILE, stop[to]) - start
    order = np.argsort(-size, kind="stable")
    start, size, own = start[order], size[order], own[order]
    s, n = np.zeros((2, len(order)), np.int64)
    width = max(1, len(auto.vocabulary))
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t))
        w = word[start[:live] + t]
        todo = np.arange(live)
        while len(todo):
            key = s[todo] * width + w[todo]
            at = np.minimum(np.searchsorted(auto.keys, key), len(auto.keys) - 1)
            hit = auto.keys[at] == key
            s[todo[hit]] = auto.to[at[hit]]
            n[todo[hit]] += 1
            todo = todo[~hit]
            s[todo] = auto.link[s[todo]]
            n[todo] = auto.length[s[todo]]
        at = start[:live] + t
        mine = at >= own[:live]
        state[at[mine]], matched[at[mine]] = s[:live][mine], n[:live][mine]
    return state, matched


def chains(anchors: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of (text start, notice start, words), best covered first, each anchor in one chain at most.

    A chain's anchors follow one another in text and notice without overlap. The best chain that ends at each anchor comes from
    a list of ends in the notice with growing cover; anchors over GAP words apart begin a new list.
    """
    anchors = sorted(set(anchors))
    best, before = [0] * len(anchors), [-1] * len(anchors)
    ends: list[int] = []  # ends in the notice, with rising cover
    cover: list[int] = []
    whose: list[int] = []
    waiting: list[tuple[int, int]] = []  # (end in the text, anchor) not yet usable as a predecessor
    reach = None
    for i, (a, b, n) in enumerate(anchors):
        if reach is not None and a > reach + GAP:
            ends, cover, whose, waiting = [], [], [], []
        for _, j in sorted(x for x in waiting if x[0] <= a):
            end = anchors[j][1] + anchors[j][2]
            k = bisect_right(ends, end)
            if k and cover[k - 1] >= best[j]:
                continue
            while k < len(ends) and cover[k] <= best[j]:
                del ends[k], cover[k], whose[k]
            ends.insert(k, end)
            cover.insert(k, best[j])
            whose.insert(k, j)
        waiting = [x for x in waiting if x[0] > a]
        k = bisect_right(ends, b)
        best[i] = n + (cover[k - 1] if k else 0)
        before[i] = whose[k - 1] if k else -1
        waiting.append((a + n, i))
        reach = max(a + n, reach or 0)
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: (-best[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


class Scanner:
    """Base phrases and notices with their automaton."""

    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        self.base = [label for _, label in base]
        self.labels = [label for label, _ in notices]
        texts = [template_words(x) for x, _ in base] + [template_words(x) for _, x in notices]
        self.auto = build(texts, len(base))
        self.sizes = [len(t) for t in texts[len(base) :]]
        self.least = min([MIN_MATCH, *map(len, texts)])

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Spans (label, start, end, covered, share) of one text's long matches (start, words, state), by start."""
        by_notice: dict[int, list[tuple[int, int, int]]] = {}
        auto, skip = self.auto, len(self.base)
        for start, n, state in matches:
            for end in auto.ends[auto.enter[state] : auto.leave[state]].tolist():
                k = bisect_right(auto.bounds, end) - 1
                if k >= skip:
                    own = by_notice.setdefault(k - skip, [])
                    here, there, size = start, end - n + 1 - auto.bounds[k], n
                    if own and own[-1][0] + own[-1][2] > here and size - (own[-1][0] + own[-1][2] - here) > 0 and own[-1][1] + own[-1][2] <= there + own[-1][0] + own[-1][2] - here:
                        cut = own[-1][0] + own[-1][2] - here  # what overlaps the match before it counts there
                        here, there, size = here + cut, there + cut, size - cut
                    own.append((here, there, size))
        out = []
        for k, anchors in by_notice.items():
            for chain in chains(anchors):
                covered = sum(n for _, _, n in chain)
                if covered >= MIN_SHARE * self.sizes[k]:
                    out.append((self.labels[k], chain[0][0], chain[-1][0] + chain[-1][2], covered, covered / self.sizes[k]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of SCHEMA after the id."""
        data, offsets = buffer(texts)
        of, code, distinct = words(LOWER[data], offsets, BETWEEN)
        known = np.array([self.auto.vocabulary.get(w, -1) for w in distinct.to_pylist()], np.int64)
        state, matched = statistics(self.auto, known[code] if len(code) else np.zeros(0, np.int64), of, self.least)
        labels: list[set[str]] = [set() for _ in texts]
        places = []
        for label, (own, size, below) in zip(self.base, self.auto.phrases, strict=True):
            at = np.flatnonzero(below[state] | (state == own) & (matched >= size))
            places.append(at - size + 1)
            for row in np.unique(np.searchsorted(of, at, "right") - 1).tolist():
                labels[row].add(label)
        place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        upto = np.searchsorted(place, of)
        n_base = np.diff(upto)
        named = n_base > 0
        first, last = np.zeros((2, len(texts)), np.int64)
        first[named] = place[upto[:-1][named]] - of[:-1][named]
        last[named] = place[upto[1:][named] - 1] - of[:-1][named]

        least = min(MIN_MATCH, *self.sizes) if self.sizes else MIN_MATCH
        grows = np.append(matched[1:] == matched[:-1] + 1, False) if len(matched) else np.zeros(0, bool)
        grows[of[1:][of[1:] > 0] - 1] = False
        at = np.flatnonzero((matched >= least) & ~grows)
        row = np.searchsorted(of, at, "right") - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r, a, n, s in zip(row.tolist(), (at - matched[at] + 1 - of[row]).tolist(), matched[at].tolist(), state[at].tolist(), strict=True):
            found.setdefault(r, []).append((a, n, s))
        spans = [self.spans(found[r]) if r in found else [] for r in range(len(texts))]
        score = [max([x[4] for x in own], default=0.0) for own in spans]
        both = [sorted(a | {x[0] for x in own}) for a, own in zip(labels, spans, strict=True)]
        return [
            pa.array(np.diff(of), pa.int64()),
            pa.array(n_base, pa.int64()),
            pa.array(first, pa.int64(), mask=~named),
            pa.array(last, pa.int64(), mask=~named),
            pa.array([",".join(sorted(x)) for x in labels]),
            pa.array([",".join(x) for x in both]),
            pa.array([max(x, NAMED) if n else x for x, n in zip(score, named.tolist(), strict=True)]),
            pa.array([[dict(zip(("label", "start", "end", "covered", "share"), x, strict=True)) for x in own] for own in spans], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))),
        ]


@functools.cache
def scanner(base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES) -> Scanner:
    """One scanner for each worker and set of templates."""
    return Scanner(base, notices)


def scan(df: DataFrame, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    ``n_base`` counts all places of base phrases; the first and last are their smallest and largest first words. ``spans`` are
    those of notices, in words. The score is the largest share of a notice that a chain covers, NAMED at least where a base
    phrase stands. Templates go to every task; they are given by the caller, not by the data.
    """
    found = keyed(lambda texts: scanner(base, notices).scan(texts), df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), SCHEMA)
    return found.withColumnRenamed("id", id_column)
