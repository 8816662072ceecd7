"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; dynamic
programming over end positions carries the best score and the number of pieces, and
no way back. Ties follow the tokenizer: candidates for an end come with the longest
piece first, and a later one must be strictly better. A character that is no piece
by itself costs the smallest score less 10 and counts as its UTF-8 bytes where the
vocabulary has byte pieces (else a run of such characters is one token).

Pieces hold the word mark only as a leading run, so a best path never crosses from
a word into the next mark, nor through a character that no longer piece holds; the
text is cut there. Equal segments are solved once per task (a bounded table), and the
new ones of many texts together: the automaton reads one character of each at a time.

The tokenizer adds scores in single precision from the start of the text, which can
decide near ties. So the pass also carries a margin (how far any other way through
the best path's ends lies behind). Where it doesn't exceed the rounding that is
possible at this place of the text, the segment is solved anew with the tokenizer's
own arithmetic from the exact running sum; only this needs the costs along paths.

Defined results: null and empty texts have no tokens; a very long text takes time and
memory in proportion to its length; rows that repeat are counted one by one; an empty
table gives none; other columns are ignored, and a kept column named n_tokens comes
back as n_tokens_in. Vocabularies with a normaliser of their own raise an error.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections import Counter as Counts
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlattice.llm.common import kept_columns

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
#: Segments that a task remembers, about; characters of texts that are read together, or of a long text at once.
REMEMBER, SLICE = 400_000, 1 << 20
#: Characters of the vocabulary that the automaton's table holds, the most frequent; and the longest segment that it reads.
ALPHABET, LONGEST = 256, 48
#: Relative rounding of one single-precision sum, with room for what the running sum itself has gathered.
ROUNDING = 1.1 * 2.0**-24


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class Vocabulary:
    """Pieces (text, score, kind) of a SentencePiece model file, and how it normalises."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.byte_fallback, self.prefix, self.squeeze, self.normalizer = False, True, True, b""
        for field, v in _fields(model):
            if field == 1:
                p = dict(_fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                self.byte_fallback = bool(dict(_fields(v)).get(35, 0))
            elif field == 3:
                spec = dict(_fields(v))
                self.prefix, self.squeeze, self.normalizer = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if self.squeeze or self.normalizer:
            raise ValueError("only vocabularies with the identity normaliser that keep white space are supported")

    def by_rank(self) -> Vocabulary:
        """Scores by Zipf's rule: piece k of the vocabulary's order has the logarithm of 1 / (k + 2)."""
        k = 0
        for i, (t, _, kind) in enumerate(self.pieces):
            if kind == NORMAL:
                self.pieces[i] = t, float(np.float32(-math.log(k + 2))), kind
                k += 1
        return self


class Machine:
    """An Aho-Corasick automaton over the vocabulary, as tables, that reads many segments in step."""

    def __init__(self, pieces: dict[str, float]):
        used = Counts(ch for t in pieces for ch in t if ch in pieces)
        chars = sorted(ch for ch, _ in used.most_common(ALPHABET))
        #: Each character's column, -1 for those that the tables don't hold.
        self.code = np.full(0x110000, -1, dtype=np.int16)
        self.code[[ord(ch) for ch in chars]] = np.arange(len(chars))
        at = {ch: k for k, ch in enumerate(chars)}
        own = [(t, c) for t, c in sorted(pieces.items()) if all(ch in at for ch in t)]
        self.size, self.cost = np.array([len(t) for t, _ in own], dtype=np.int64), np.array([c for _, c in own])
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, (t, _) in enumerate(own):
            v = 0
            for ch in t:
                v = children[v].setdefault(at[ch], len(children))
                if v == len(children):
                    children.append({})
            ends[v] = k
        n = len(children)
        self.next = np.zeros((n, len(chars)), dtype=np.int32)
        #: The longest piece that ends in a state, and after each piece the next shorter one that ends there too.
        self.longest, self.shorter = np.full(n, -1, dtype=np.int32), np.full(len(own), -1, dtype=np.int32)
        level, fail = [0], np.zeros(n, dtype=np.int64)
        while level:
            below = []
            for v in level:
                up = fail[v]
                if v:
                    self.next[v] = self.next[up]
                for ch, w in children[v].items():
                    fail[w] = self.next[up, ch] if v else 0
                    self.next[v, ch] = w
                    below.append(w)
            for w in below:
                k, behind = ends.get(w), self.longest[fail[w]]
                self.longest[w] = behind if k is None else k
                if k is not None:
                    self.shorter[k] = behind
            level = below

    def takes(self, segments: list[str]) -> np.ndarray:
        """Which segments the tables can read: not too long, every character of them a piece that the tables hold."""
        size = np.array([len(s) for s in segments], dtype=np.int64)
        code = self.code[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
        return (size <= LONGEST) & (np.minimum.reduceat(code, np.cumsum(size) - size) >= 0)

    def read(self, segments: list[str], paths: bool = False) -> tuple:
        """Tokens, score and margin of the best path through each segment, or (paths) the costs along it, one after the other, and how many."""
        size = np.array([len(s) for s in segments])
        order = np.argsort(-size, kind="stable")
        flat = self.code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        start, size = (np.cumsum(size) - size)[order], size[order]
        n, top = len(size), int(size[0])
        score, second = np.full((top + 1, n), -math.inf), np.full((top + 1, n), -math.inf)
        count, margin = np.zeros((top + 1, n), dtype=np.int32), np.full((top + 1, n), math.inf)
        last = np.zeros((top + 1, n), dtype=np.int32) if paths else None
        score[0] = 0.0
        state = np.zeros(n, dtype=np.int32)
        for e in range(1, top + 1):
            m = int(np.searchsorted(-size, -e, side="right"))  # segments with e characters or more
            state = self.next[state[:m], flat[start[:m] + e - 1]]
            piece = self.longest[state]
            row = np.flatnonzero(piece >= 0)
            piece = piece[row]
            while len(row):
                p = e - self.size[piece]
                c = score[p, row] + self.cost[piece]
                best = score[e, row]
                up = c > best
                second[e, row] = np.where(up, best, np.maximum(second[e, row], c))
                r, q = row[up], p[up]
                score[e, r] = c[up]
                if paths:
                    last[e, r] = piece[up]
                else:
                    count[e, r] = count[q, r] + 1
                    margin[e, r] = np.minimum(margin[q, r], score[q, r] - second[q, r])
                piece = self.shorter[piece]
                more = piece >= 0
                row, piece = row[more], piece[more]
        back = np.argsort(order, kind="stable")
        if not paths:
            r = np.arange(n)
            return count[size, r][back], score[size, r][back], np.minimum(margin[size, r], score[size, r] - second[size, r])[back]
        costs, at, row = [], size.copy(), np.arange(n)
        found = []
        while len(row):
            k = last[at[row], row]
            found.append(row)
            costs.append(self.cost[k])
            at[row] -= self.size[k]
            row = row[at[row] > 0]
        row, cost = np.concatenate(found), np.concatenate(costs)
        step = np.repeat(np.arange(len(found)), [len(x) for x in found])
        by = np.lexsort((-step, order[row]))  # the walk went from the end
        return cost[by].astype(np.float32), np.bincount(order[row], minlength=n)


class Known(dict):
    """Numbers of segments; those that are new wait in fresh."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.fresh = 0

    def __missing__(self, s: str) -> int:
        self[s] = k = len(self.names)
        self.names.append(s)
        return k


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        normal = [s for _, s, k in v.pieces if k == NORMAL]
        self.unknown = float(np.float32(min(normal, default=0.0)) - np.float32(UNKNOWN_COST))
        top = max(normal, default=0.0)
        self.prefix, self.bytes = v.prefix, v.byte_fallback
        usable = [(t, len(t.encode()) * top - 0.1 if k == USER else s) for t, s, k in v.pieces if k in (NORMAL, USER) and t]
        self.auto = ahocorasick.Automaton()
        for t, s in usable:
            self.auto.add_word(t, (len(t), s))
        self.auto.make_automaton()
        inner = sorted({ch for t, _ in usable if len(t) > 1 for ch in t} - {MARK})
        self.inner = frozenset({*inner, MARK})
        if self.bytes and all(MARK not in t.lstrip(MARK) for t, _ in usable):
            self.cut = re.compile(f"{MARK}+[{re.escape(''.join(inner))}]*|[{re.escape(''.join(inner))}]+|." if inner else f"{MARK}+|.", re.S)
        else:
            self.cut = None
        own = {t for t, _ in usable if len(t) == 1}
        #: Characters of longer pieces that are no piece by themselves.
        self.bare = frozenset({*inner, MARK} - own)
        self.machine = Machine(dict(usable))
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.tokens, self.scores, self.margins = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.cost_at, self.cost_n, self.costs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def solve(self, s: str) -> tuple[int, float, float]:
        """Tokens on the best path through s, its score and its margin; every character is a piece or part of one."""
        n = len(s)
        score, second, count, margin = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [0] * (n + 1), [math.inf] * (n + 1)
        score[0] = 0.0
        for end, (size, cost) in self.auto.iter(s):
            e = end + 1
            p = end + 1 - size
            c = score[p] + cost
            if c > score[e]:
                second[e] = score[e]
                score[e] = c
                count[e] = count[p] + 1
                gap = score[p] - second[p]
                margin[e] = gap if gap < margin[p] else margin[p]
            elif c > second[e]:
                second[e] = c
        return count[n], score[n], min(margin[n], score[n] - second[n])

    def trace(self, s: str, start: float = 0.0, single: bool = False) -> tuple[int, list[float]]:
        """Tokens on the best path through s and the costs along it, from a running sum; single: in the tokenizer's arithmetic."""
        if not self._plain(s):
            return self.exact(s, start, single)
        n, rounded = len(s), array("f", [0.0])
        score, count, path = [-math.inf] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        score[0] = start
        for end, (size, cost) in self.auto.iter(s):
            e = end + 1
            c = score[e - size] + cost
            if single:
                rounded[0] = c
                c = rounded[0]
            if c > score[e]:
                score[e] = c
                count[e] = count[e - size] + 1
                path[e] = (path[e - size], cost)
        costs, cell = [], path[n]
        while cell:
            cell, cost = cell
            costs.append(cost)
        return count[n], costs[::-1]

    def _plain(self, s: str) -> bool:
        """Every character of s is a piece, and s isn't a lone character that no longer piece holds."""
        return s[0] in self.inner and self.bare.isdisjoint(s)

    def _closed(self, s: str, single: bool, start: float) -> Iterator[tuple[int, int, float, float, bool]]:
        """By end position: (end, size of the best last piece, score, its cost, is it unknown); single: in the tokenizer's arithmetic."""
        n, unknown, rounded = len(s), self.unknown, array("f", [0.0])

        def add(a: float, b: float) -> float:
            if not single:
                return a + b
            rounded[0] = a + b
            return rounded[0]

        score = [start] + [-math.inf] * n
        found: list[tuple[int, tuple[int, float]]] = []
        matches = iter(self.auto.iter(s))
        nxt = next(matches, None)
        for e in range(1, n + 1):
            found.clear()
            while nxt is not None and nxt[0] + 1 == e:
                found.append(nxt[1])
                nxt = next(matches, None)
            best = None
            for size, cost in found:
                c = add(score[e - size], cost)
                if best is None or c > best[0]:
                    best = c, size, cost, False
            if not any(size == 1 for size, _ in found):
                c = add(score[e - 1], unknown)
                if best is None or c > best[0]:
                    best = c, 1, unknown, True
            score[e] = best[0]
            yield e, best[1], best[0], best[2], best[3]

    def exact(self, s: str, start: float = 0.0, single: bool = True) -> tuple[int, list[float]]:
        """Tokens on the best path through s from a running sum, unknown characters included, and the costs along it."""
        count, path, unknown = [0], [()], [False]
        for e, size, _, cost, bare in self._closed(s, single, start):
            p = e - size
            more = 1 if not bare else len(s[e - 1].encode()) if self.bytes else int(not unknown[p])
            count.append(count[p] + more)
            path.append((path[p], cost))
            unknown.append(bare)
        costs, cell = [], path[-1]
        while cell:
            cell, cost = cell
            costs.append(cost)
        return count[-1], costs[::-1]

    def _solved(self, s: str) -> tuple[int, float, float]:
        """Tokens, score, and the margin for each of the sums that can be rounded."""
        if self._plain(s):
            count, score, margin = self.solve(s)
            return count, score, margin / (2 * (len(s) + 1))
        count, costs = self.exact(s, single=False)
        # a lone character that no longer piece holds has one way only; the others are solved anew in every text
        return count, math.fsum(costs), math.inf if len(s) == 1 and s not in self.inner else -math.inf

    def numbers(self, segments: Iterable[str]) -> np.ndarray:
        """The segments' numbers, after solving those that are new."""
        ids = np.fromiter(map(self.known.__getitem__, segments), np.int64)
        first, names = len(self.tokens), self.known.names
        if first < len(names):
            found = np.zeros((3, len(names) - first))
            step = self.machine.takes(names[first:])
            for k in np.flatnonzero(~step).tolist():
                found[:, k] = self._solved(names[first + k])
            at = np.flatnonzero(step)
            for i in range(0, len(at), 1 << 15):
                own = at[i : i + (1 << 15)]
                tokens, score, margin = self.machine.read([names[first + k] for k in own.tolist()])
                found[0, own], found[1, own], found[2, own] = tokens, score, margin / (2 * (np.array([len(names[first + k]) for k in own.tolist()]) + 1))
            self.tokens = np.concatenate((self.tokens, found[0].astype(np.int64)))
            self.scores, self.margins = np.concatenate((self.scores, found[1])), np.concatenate((self.margins, found[2]))
        return ids

    def _trace_all(self, ids: np.ndarray) -> None:
        """Makes the costs along the best paths of segments known."""
        room = len(self.tokens) - len(self.cost_n)
        self.cost_at, self.cost_n = np.concatenate((self.cost_at, np.zeros(room, np.int64))), np.concatenate((self.cost_n, np.zeros(room, np.int64)))
        new = np.unique(ids[self.cost_n[ids] == 0])
        if len(new):
            names = [self.known.names[k] for k in new.tolist()]
            step = self.machine.takes(names)
            parts = [self.costs]
            for k in np.flatnonzero(~step).tolist():
                own = np.array(self.trace(names[k])[1], dtype=np.float32)
                self.cost_n[new[k]] = len(own)
                parts.append(own)
            order = [np.flatnonzero(~step)]
            at = np.flatnonzero(step)
            for i in range(0, len(at), 1 << 15):
                own = at[i : i + (1 << 15)]
                costs, n = self.machine.read([names[k] for k in own.tolist()], paths=True)
                self.cost_n[new[own]] = n
                parts.append(costs)
                order.append(own)
            order = new[np.concatenate(order)]
            n = self.cost_n[order]
            self.cost_at[order] = len(self.costs) + np.cumsum(n) - n
            self.costs = np.concatenate(parts)

    def path_costs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The costs along the best paths of segments, one after the other, and how many each has."""
        self._trace_all(ids)
        n = self.cost_n[ids]
        return self.costs[np.repeat(self.cost_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _near(self, ids: np.ndarray, near: list[int], start: np.float32 = np.float32(0), whole: bool = False) -> tuple[int, np.float32]:
        """What near ties change in the tokens of a text, and (whole) the exact sum at its end; start: the exact sum before it."""
        costs, n = self.path_costs(ids if whole else ids[: near[-1] + 1])
        end = np.cumsum(n)
        run = np.add.accumulate(np.concatenate(([start], costs)), dtype=np.float32)
        more, apart, at, known = 0, False, 0, start
        add = lambda first, own: np.add.accumulate(np.concatenate((np.array([first], np.float32), own)), dtype=np.float32)[-1]
        for i in near:
            first = int(end[i] - n[i])
            before = add(known, costs[at:first]) if apart else run[first]
            count, own = self.trace(self.known.names[ids[i]], float(before), True)
            more += count - int(self.tokens[ids[i]])
            known, at = add(before, np.array(own, np.float32)), int(end[i])
            apart = apart or known != run[at]  # from here on the sums start from another value
        return more, (add(known, costs[at:]) if apart else run[-1]) if whole else known

    def _long(self, text: str) -> int:
        """A text slice by slice, cut before marks, with the exact sum carried on."""
        total, at, run, start = 0, 0, 0.0, np.float32(0)
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                cut = next((k for k in (text.rfind(MARK, at + 1, end), text.find(MARK, end)) if k > at), len(text))
                while cut > at + 1 and cut < len(text) and text[cut - 1] == MARK:
                    cut -= 1
                end = cut if cut > at else len(text)
            if len(self.known) > REMEMBER:
                self._forget()
            ids = self.numbers(self.cut.findall(text[at:end]))
            sums = run + np.cumsum(self.scores[ids])
            near = np.flatnonzero(self.margins[ids] <= np.abs(sums) * ROUNDING).tolist()
            more, start = self._near(ids, near, start, whole=True)
            total += int(self.tokens[ids].sum()) + more
            run, at = float(sums[-1]), end
        return total

    def _together(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBER:
            self._forget()
        segments = list(map(self.cut.findall, texts))
        size = np.array([len(x) for x in segments])
        ids = self.numbers(chain.from_iterable(segments))
        end = np.cumsum(size)
        total = np.add.reduceat(self.tokens[ids], end - size)
        sums = np.cumsum(self.scores[ids])
        sums -= np.repeat(np.concatenate(([0.0], sums[end[:-1] - 1])), size)
        near = np.flatnonzero(self.margins[ids] <= np.abs(sums) * ROUNDING)
        text = np.searchsorted(end, near, side="right")
        if len(near):  # all that the texts with near ties need at once
            upto = np.zeros(len(texts), dtype=np.int64)
            upto[text] = near + 1  # ascending, so that the last of a text stays
            first = end - size
            need = np.maximum(upto - first, 0) * (upto > 0)
            self._trace_all(ids[np.repeat(first - (np.cumsum(need) - need), need) + np.arange(int(need.sum()))])
        for k in np.unique(text).tolist():
            first = int(end[k] - size[k])
            total[k] += self._near(ids[first : end[k]], (near[text == k] - first).tolist())[0]
        return total.tolist()

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        out: list[int] = []
        group: list[str] = []
        at: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for k, n in zip(at, self._together(group) if group else [], strict=True):
                out[k] = n
            group.clear()
            at.clear()
            size = 0

        for text in texts:
            out.append(0)
            if not text:
                continue
            text = (MARK if self.prefix else "") + text.replace(" ", MARK)
            if self.cut is None:
                out[-1] = self.exact(text)[0]
            elif len(text) > SLICE:
                out[-1] = self._long(text)
            else:
                group.append(text)
                at.append(len(out) - 1)
                size += len(text)
                if size >= SLICE:
                    flush()
        flush()
        return out

    def __call__(self, text: str | None) -> int:
        return self.counts([text])[0]


_COUNTERS: dict[int, Counter] = {}


def _count(shared, names: list[str], rank_scores: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((shared.value, rank_scores))
        if key not in _COUNTERS:
            _COUNTERS.clear()
            v = Vocabulary(shared.value)
            _COUNTERS[key] = Counter(v.by_rank() if rank_scores else v)
        count = _COUNTERS[key]
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], pa.array(count.counts(x.as_py() for x in b.column(len(names))), pa.int64())], names=[*names, "n_tokens"])

    return f


def token_counts(docs: DataFrame, model: bytes, keep: list[str], text_col: str = "text", rank_scores: bool = False) -> DataFrame:
    """The columns named in keep and n_tokens.

    model: the bytes of a SentencePiece model file, read as a unigram model; rank_scores: with scores by rank instead of
    its own, for files whose scores are merge numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, names, kinds = kept_columns(docs, keep, ["n_tokens"])
    d = docs.select(*own, docs[text_col].cast("string").alias("_text"))
    return d.mapInArrow(_count(shared, names, rank_scores), ", ".join([*kinds, "n_tokens long"]))
