"""License scans with a generalised suffix automaton.

The automaton holds the word sequences of license templates and of short phrases.
A text's words stream through it: after each word it knows the longest suffix of
the text that occurs in some template (matching statistics) and, through suffix
links, which phrases end there. A match counts for every template that holds it.
Long matches are chained along a template, in order and without overlap, into
covered spans. A template adds its label where a chain covers a large enough part of
it, or holds one long match that templates of no other label have; not so where the
chain lies within one of another label that covers more words.

Words outside the templates' vocabulary can't match, so the automaton only walks
runs of vocabulary words that hold a word no common prose has; the others cannot
contain a phrase or a long match of a template.

Defined results: null and empty texts have no words, places or labels and score 0;
rows that repeat are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlattice.llm import kernels as K

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short licenses whole, of long ones the notice that files carry: label, text.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
        You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
]

#: A match counts from so many words; a template's label needs so large a part of it covered, or so many words in one match that is its own.
LONG, COVER, ENOUGH = 4, 0.5, 8
#: A chain goes on over at most so many unmatched words.
GAP = 12

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
OUT = "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<start:long,end:long,label:string,template_start:long,template_end:long>>"


def tokens(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Automaton:
    """All substrings of the sequences, with the places of each state in them and the phrases that end in it."""

    def __init__(self, sequences: list[list[int]], phrases: list[list[int]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        ends = defaultdict(list)
        for s, seq in enumerate(sequences + phrases):
            last = 0
            for i, t in enumerate(seq):
                last = self._add(last, t)
                ends[last].append((s, i + 1))
        by_length = sorted(range(len(self.next)), key=self.len.__getitem__)
        #: (sequence, end) of all places where the state's strings stand.
        self.places: list[list[tuple[int, int]]] = [list(ends[v]) for v in range(len(self.next))]
        for v in reversed(by_length[1:]):
            self.places[self.link[v]] += self.places[v]
        self.phrase: list[list[tuple[int, int]]] = [[] for _ in self.next]
        whole = defaultdict(list)
        for k, seq in enumerate(phrases):
            v = 0
            for t in seq:
                v = self.next[v][t]
            whole[v].append((k, len(seq)))
        for v in by_length:
            self.phrase[v] = (self.phrase[self.link[v]] if v else []) + whole[v]

    def _new(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, t: int) -> int:
        c = self._new(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = c
            p = self.link[p]
        return c

    def _add(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, t)
        cur = self._new({}, 0, self.len[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, t)
        return cur

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each token."""
        v = n = 0
        nxt, link, length = self.next, self.link, self.len
        for t in seq:
            while v and t not in nxt[v]:
                v = link[v]
                n = length[v]
            if t in nxt[v]:
                v = nxt[v][t]
                n += 1
            yield v, n


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        self.phrase_labels = list(phrases.values())
        ph = [tokens(p) for p in phrases]
        te = [tokens(t) for _, t in templates]
        self.labels, self.sizes = [x for x, _ in templates], [len(t) for t in te]
        vocab = sorted({w for t in ph + te for w in t})
        ids = {w: i for i, w in enumerate(vocab)}
        c = next(K.chunks(pa.array([b" ".join(vocab)], pa.binary())))
        starts, ends, _ = K.words(c, K.ALNUM_WORD)
        h = K.word_hashes(c, starts, ends, fold=True)
        order = np.argsort(h)
        self.ids, self.members = order, K.Members(h[order])
        self.vocab = vocab
        self.auto = Automaton([[ids[w] for w in t] for t in te], [[ids[w] for w in p] for p in ph])
        self.shortest = min(map(len, ph))
        #: The rarest-looking word of each phrase and of each run of LONG template words: longest, then first in order.
        rare = lambda ws: ids[max(ws, key=lambda w: (len(w), w))]
        need = {rare(p) for p in ph} | {rare(t[i : i + LONG]) for t in te for i in range(max(1, len(t) - LONG + 1))}
        self.needed = np.zeros(len(vocab) + 1, dtype=bool)
        self.needed[list(need)] = True

    def scan(self, c: K.Chunk) -> tuple[np.ndarray, list[list], list[list]]:
        """Word offsets by row; by row the places (phrase, start) and the matches (start, end, template, template end)."""
        starts, ends, off = K.words(c, K.ALNUM_WORD)
        ids = np.full(len(starts), len(self.vocab), dtype=np.int64)
        if len(starts):
            at, k = self.members.find(K.word_hashes(c, starts, ends, fold=True))
            ids[at] = self.ids[k]
        s, e, _ = K.runs(ids < len(self.vocab), off)
        rare = np.concatenate(([0], np.cumsum(self.needed[ids])))
        use = (e - s >= self.shortest) & (rare[e] > rare[s]) if len(s) else np.zeros(0, bool)
        places, matches = [[] for _ in range(c.n)], [[] for _ in range(c.n)]
        rows = np.searchsorted(off, s[use], side="right") - 1
        for a, b, row in zip(s[use].tolist(), e[use].tolist(), rows.tolist(), strict=True):
            words = [c.data[x:y].tobytes().lower() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            seq = ids[a:b].tolist()
            if any(self.vocab[t] != w for t, w in zip(seq, words, strict=True)):
                seq = [t if self.vocab[t] == w else -1 for t, w in zip(seq, words, strict=True)]  # a hash that only looks equal
            a -= int(off[row])
            best = (0, 0, 0)
            for i, (v, n) in enumerate(self.auto.stream(seq)):
                for k, size in self.auto.phrase[v]:
                    if size <= n:
                        places[row].append((k, a + i + 1 - size))
                if best[1] and n <= best[1] and n != best[1] + 1:
                    self._close(matches[row], best)
                    best = (0, 0, 0)
                best = (a + i + 1, n, v) if n else (0, 0, 0)
            self._close(matches[row], best)
        return off, places, matches

    def _close(self, out: list, best: tuple[int, int, int]) -> None:
        end, n, v = best
        if n >= LONG:
            out.extend((end - n, end, s, te) for s, te in self.auto.places[v] if s < len(self.labels))

    def chains(self, matches: list[tuple]) -> list[tuple[int, int, int, int, int, int]]:
        """Matches chained along a template: start, end, template, its start and end, words covered."""
        out = []
        for t in sorted({m[2] for m in matches}):
            run = None
            by_span = defaultdict(list)
            for a, b, s, te in matches:
                if s == t:
                    by_span[a, b].append(te - (b - a))
            for (a, b), places in sorted(by_span.items()):
                cut = max(0, run[1] - a) if run else 0  # overlaps: what is new of it
                if a + cut >= b:
                    continue
                on = [p + cut for p in places if run and p + cut >= run[4]] if run and a + cut - run[1] <= GAP else []
                ts = min(on) if on else min(places) + cut
                if on:
                    run = (run[0], b, t, run[3], ts + b - a - cut, run[5] + b - a - cut)
                else:
                    out += [run] if run else []
                    run = (a + cut, b, t, ts, ts + b - a - cut, b - a - cut)
            out += [run] if run else []
        return out

    def found(self, matches: list[tuple], chains: list[tuple]) -> set[str]:
        """The labels that the chains add."""
        labels = defaultdict(set)
        for a, b, t, _ in matches:
            labels[a, b].add(self.labels[t])
        own = {(t, a, b) for a, b, t, _ in matches if b - a >= ENOUGH and len(labels[a, b]) == 1}
        out = set()
        for a, b, t, _, _, n in chains:
            if n >= COVER * self.sizes[t] or any(s == t and a <= x and y <= b for s, x, y in own):
                if not any(self.labels[u] != self.labels[t] and c <= a and b <= d and m > n for c, d, u, _, _, m in chains):
                    out.add(self.labels[t])
        return out


def _scan(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc: Scanner = shared.value
        for b in batches:
            for c in K.chunks(b.column("text")):
                off, places, matches = sc.scan(c)
                rows = {x: [] for x in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for p, m in zip(places, matches, strict=True):
                    chain = sc.chains(m)
                    base = sorted({sc.phrase_labels[k] for k, _ in p})
                    cover = defaultdict(int)
                    for x in chain:
                        cover[x[2]] = max(cover[x[2]], x[5])
                    own = sc.found(m, chain)
                    rows["n_base"].append(len(p))
                    rows["first_word"].append(min((s for _, s in p), default=None))
                    rows["last_word"].append(max((s for _, s in p), default=None))
                    rows["base_labels"].append(base)
                    rows["labels"].append(sorted({*base, *own}))
                    rows["score"].append(max([0.0, *(min(1.0, n / sc.sizes[t]) for t, n in cover.items()), 1.0 if base else 0.0]))
                    rows["spans"].append([{"start": a, "end": e, "label": sc.labels[t], "template_start": ts, "template_end": te} for a, e, t, ts, te, _ in sorted(chain)])
                span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("template_start", pa.int64()), ("template_end", pa.int64())])
                kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(span)]
                yield pa.record_batch(
                    [b.column("id").slice(c.first, c.n), pa.array(np.diff(off), pa.int64()), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))],
                    names=["id", "n_words", *rows],
                )

    return f


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (chains in word offsets)."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    d = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(_scan(shared), OUT).withColumnRenamed("id", id_col)
