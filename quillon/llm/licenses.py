"""Licence scans: a generalised suffix automaton over licence words, streamed over files.

The automaton holds every substring of every template, as words. A file's words are looked
up in the templates' vocabulary; only runs of known words can match, and each such run is
fed through the automaton, which keeps, word by word, the longest substring of any template
that ends there. Matches that can't be extended and are long enough are chained per
template, at any of the places where it holds them, in order and with small gaps: of all chains, those that cover
most of its words are its spans, and the share of its words they cover decides on the label. Words of gaps
aren't covered. Fixed phrases are counted beside it.

The automaton depends on the templates alone, is built once a worker, and the scan keeps
nothing across files, so a lost task is simply run again.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import bytesops as B

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public licence notices, in the words that files carry.
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-reference": "released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-reference": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    "gpl-reference": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "cc-by-reference": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-reference": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-short": "content available under cc by 4 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


class Automaton:
    """Generalised suffix automaton; ends[v]: by template, all places where the strings of a state end in it."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        """least: words of the shortest strings of which the places are wanted."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(t, set()).add(i)
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            for t, i in self.ends[v].items():
                if self.len[self.link[v]] >= least:
                    self.ends[self.link[v]].setdefault(t, set()).update(i)

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            q = self.next[p][c]
            return q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        cur = self._new(self.len[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of the matches that can be extended neither way, of at least that length."""
        out, v, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.len
        for i, c in enumerate(tokens):
            if c not in nxt[v]:
                if n >= least:
                    out.append((i - n, n, v))
                while v and c not in nxt[v]:
                    v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
        if n >= least:
            out.append((len(tokens) - n, n, v))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int, gap: int, share: float):
        self.labels, self.least, self.gap, self.share = list(templates), least, gap, share
        sequences = [t.split() for t in templates.values()]
        vocabulary = sorted({w for s in sequences for w in s} | {w for p in phrases for w in p.split()})
        hashed = np.array([B.word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashed)
        self.hashes, number = hashed[order], {vocabulary[o]: i for i, o in enumerate(order)}
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[number[w] for w in s] for s in sequences], least)
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases.items()]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered) of a file's template spans, whatever their share; those of one template don't overlap."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        places: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s < self.least:
                continue
            for start, n, v in self.automaton.matches(ids[s:e].tolist(), self.least):
                for t, ends in self.automaton.ends[v].items():
                    places.setdefault(t, []).extend((int(s) + start + n - 1, end, n) for end in ends)
        out = []
        for t, p in places.items():
            out += [(self.labels[t], first, last, covered / self.sizes[t]) for first, last, covered in chains(p, self.gap)]
        return sorted(out, key=lambda x: (x[1:3], x[0]))


def chains(places: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, covered) of the best chains of places (last word in the file, in the template, number of words).

    Each place of a chain ends after the one before it, in the file and in the template, with gap words between them in the file at
    most; where they overlap, words count once. The chain that covers most words comes first (on ties, the one that ends, then starts, first), and
    others only as far as they don't overlap one before.
    """
    places = sorted(places)
    # covered words, first word, and the place before
    best: list[tuple[int, int, int]] = []
    low = 0
    longest = max(n for _, _, n in places)
    for k, (f, t, n) in enumerate(places):
        while places[low][0] < f - longest - gap:
            low += 1
        mine = (n, f - n + 1, -1)
        for j in range(low, k):
            g, u, _ = places[j]
            if g < f and u < t and f - n - g <= gap:
                c = best[j][0] + min(n, f - g, t - u)
                if (c, -best[j][1]) > (mine[0], -mine[1]):
                    mine = (c, best[j][1], j)
        best.append(mine)
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for k in sorted(range(len(places)), key=lambda k: (-best[k][0], places[k][0], best[k][1])):
        covered, first, _ = best[k]
        last = places[k][0]
        at = bisect(taken, (first, last))
        if (at and taken[at - 1][1] >= first) or (at < len(taken) and taken[at][0] <= last):
            continue
        taken.insert(at, (first, last))
        out.append((first, last, covered))
    return sorted(out)


@lru_cache(4)
def _scanner(templates: tuple, phrases: tuple, least: int, gap: int, share: float) -> Scanner:
    return Scanner(dict(templates), dict(phrases), least, gap, share)


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, share: double>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 3, gap: int = 12, share: float = 0.6) -> DataFrame:
    """One row per document: words, places and labels of the fixed phrases, all labels, score, and the template spans.

    least: words of a match; gap: words between chained matches; share: part of a template that its label asks for.
    score: 1 with a phrase, else the largest covered share. Null and empty texts have no words, no labels, score 0.
    Repeated rows give repeated results; other columns of docs are ignored.
    """
    key = (tuple(templates.items()), tuple(phrases.items()), least, gap, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(*key)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            buf, offs = B.raw(batch.column(1))
            for i, j in B.groups(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, counts = B.spans(part, o, B.ALNUM)
                ids = s.ids(B.hashes(part, starts, ends))
                at = np.concatenate([[0], np.cumsum(counts)])
                doc = np.repeat(np.arange(j - i), counts)
                places = []
                for words, label in s.phrases:
                    n = len(words)
                    hit = np.flatnonzero(ids[: max(0, len(ids) - n + 1)] == words[0])
                    for k in range(1, n):
                        hit = hit[ids[hit + k] == words[k]]
                    hit = hit[doc[hit] == doc[hit + n - 1]] if len(hit) else hit
                    places += [(int(doc[h]), int(h - at[doc[h]]), label) for h in hit]
                by: dict[int, list] = {}
                for d, p, label in places:
                    by.setdefault(d, []).append((p, label))
                # a file without least known words in a row has no match
                run_ = ids >= 0
                enough = np.zeros(j - i, bool)
                if len(ids) >= s.least:
                    w = np.ones(len(ids) - s.least + 1, bool)
                    for k in range(s.least):
                        w &= run_[k : len(ids) - s.least + 1 + k]
                    enough[np.unique(doc[np.flatnonzero(w)])] = True
                rows: dict[str, list] = {x: [] for x in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for d in range(j - i):
                    base = by.get(d, [])
                    spans = s.spans(ids[at[d] : at[d + 1]]) if enough[d] else []
                    mine = {x[1] for x in base}
                    rows["n_base"].append(len(base))
                    rows["first_word"].append(min(x[0] for x in base) if base else None)
                    rows["last_word"].append(max(x[0] for x in base) if base else None)
                    rows["base_labels"].append(",".join(sorted(mine)))
                    rows["labels"].append(",".join(sorted(mine | {x[0] for x in spans if x[3] >= s.share})))
                    rows["score"].append(1.0 if base else max([0.0, *(x[3] for x in spans)]))
                    rows["spans"].append([{"label": x[0], "first": x[1], "last": x[2], "share": x[3]} for x in spans if x[3] >= s.share])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), *(pa.array(rows[x], pa.int64()) for x in ("n_base", "first_word", "last_word")), pa.array(rows["base_labels"], pa.string()), pa.array(rows["labels"], pa.string()), pa.array(rows["score"], pa.float64()), pa.array(rows["spans"], kind)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
