"""Fuzzy substring join: which texts hold a needle, give or take a few characters, by its phonetic reading.

A needle of n characters is contained with a similarity of at least t if some part of the text is at most k = floor((1 - t) n) edits away. Cut into
k + 1 pieces, one of them at least must then stand in that part unharmed, where every character shares a reading with its counterpart. So the pieces are an
inverted index over sequences of readings: a text looks up what is read at each of its places. The same holds for any run of j pieces with less than j edits, one of whose halves
then has less edits than pieces. So from each place found the runs that hold the piece are tried from the shortest to the longest, each by a bit-parallel edit distance over a window as much wider as its edits, and
only where all of them fit the whole needle is verified. The score is exact wherever it reaches t.

The join does the same on many texts at once: hits are arrays, a run is tried on all of its hits together, and needles share the runs that they have in common. The piece that stands
unharmed holds a run in place, so the edits left and right of it are counted within a band that is as wide as they may be. The best of a needle's hits is exact.
Most hits are dropped before that: a letter that stands nowhere near its place is an edit for certain, which bits tell for a whole run at once, on top of the edits that are known from the shorter run. And where
a run stands unharmed, all its pieces do and lead to the same, so only the first one's hit goes on.

Needles go out in blocks of bounded size, each broadcast; the texts are dealt to as many tasks as are configured, since looking into them costs far more than reading them. Equal texts stand beside
each other and are looked into once for each batch, so a text with very many copies costs one task the writing of its rows alone, and work grows with the distinct texts times the number of blocks. Needles are distinct texts; null or empty ones (which any text holds) are left out. A null text holds none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.phonetic import Encoder, Pattern
from tallyvox.shipping import Sent

#: The readings of so many characters of a piece are its key, which bounds the combinations where characters have several readings.
KEY = 5
#: Needles in a block, and their characters.
BLOCK_NEEDLES, BLOCK_CHARS = 100_000, 4_000_000
#: Characters of texts, and hits in them, that are looked at together.
TEXT_CHARS, HITS = 1 << 20, 1 << 17


def allowed(n: int, threshold: float) -> int:
    """The most edits with which a needle of n characters still has the similarity."""
    k = int((1 - threshold) * n) + 1
    while k and 1.0 - k / n < threshold:
        k -= 1
    return k


class Needle:
    """A needle's pattern, the edits it may have, its pieces, and for each piece the runs of pieces around it, the shortest first: where they begin, their pattern and edits."""

    def __init__(self, tokens: Sequence[frozenset], k: int):
        self.pattern, self.k = Pattern(tokens), k
        self.edges = [len(tokens) * i // (k + 1) for i in range(k + 2)]
        self.around: list[list[tuple[int, Pattern, int]]] = [[] for _ in range(k + 1)]
        halves = [(0, k + 1)]
        while halves:
            first, last = halves.pop()
            if last - first > 1:
                if last - first <= k:  # not the whole needle
                    begin = self.edges[first]
                    run = (begin, Pattern(tokens[begin : self.edges[last]]), last - first - 1)
                    for piece in range(first, last):
                        self.around[piece].insert(0, run)
                middle = (first + last + 1) // 2
                halves += [(first, middle), (middle, last)]

    def fits(self, tokens: Sequence[frozenset], piece: int, place: int) -> bool:
        """Whether the runs around a piece that stands at a place fit there, too."""
        begin = place - self.edges[piece]
        for at, pattern, edits in self.around[piece]:
            start = begin + at
            if pattern.within(tokens[max(0, start - edits) : start + pattern.n + edits]) > edits:
                return False
        return True


class Index:
    """Needles by the readings of their pieces."""

    def __init__(self, needles: Iterable[str], encoder: Encoder, threshold: float = 0.75):
        self.needles, self.encoder, self.threshold = list(needles), encoder, threshold
        self.sizes, self.at, self.known = set(), {}, []
        for no, needle in enumerate(self.needles):
            tokens = encoder.encode(needle)
            known = Needle(tokens, allowed(len(tokens), threshold))
            self.known.append(known)
            for piece, (begin, end) in enumerate(zip(known.edges, known.edges[1:])):
                key = tokens[begin : min(end, begin + KEY)]
                self.sizes.add(len(key))
                for readings in product(*key):
                    self.at.setdefault(readings, []).append((no, piece))

    def windows(self, tokens: Sequence[frozenset]) -> dict[int, list[tuple[int, int]]]:
        """For each needle that may be contained the places where it would have to be."""
        found: dict[int, set[int]] = {}
        single = [next(iter(t)) if len(t) == 1 else None for t in tokens]
        for size in self.sizes:
            for place in range(len(tokens) - size + 1):
                key = tuple(single[place : place + size])
                for readings in [key] if None not in key else product(*tokens[place : place + size]):
                    for no, piece in self.at.get(readings, ()):
                        needle = self.known[no]
                        start = place - needle.edges[piece]
                        if start not in found.get(no, ()) and needle.fits(tokens, piece, place):
                            found.setdefault(no, set()).add(start)
        out = {}
        for no, starts in found.items():
            needle = self.known[no]
            spans: list[tuple[int, int]] = []
            for start in sorted(starts):
                begin, end = max(0, start - needle.k), min(len(tokens), start + needle.pattern.n + needle.k)
                if spans and begin <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)  # windows that meet are one
                else:
                    spans.append((begin, end))
            out[no] = spans
        return out

    def found(self, text: str) -> Iterator[tuple[int, float | None]]:
        """The number and similarity of each needle that was looked at; None for those below the threshold."""
        tokens = self.encoder.encode(text)
        for no, spans in self.windows(tokens).items():
            needle = self.known[no]
            edits = min(needle.pattern.within(tokens[a:b]) for a, b in spans)
            yield no, 1.0 - edits / needle.pattern.n if edits <= needle.k else None


def grouped(owner: np.ndarray, member: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members by owner: where those of each of n owners begin, how many they are, and all of them."""
    counts = np.bincount(owner, minlength=n)
    return np.cumsum(counts) - counts, counts, member[np.argsort(owner, kind="stable")]


def stretches(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of numbers whose sums are at most HITS, or that are one number."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
        yield at, to
        at = to


def each(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of n members from where they begin, for all owners in a row."""
    last = np.cumsum(n)
    return np.arange(last[-1]) + np.repeat(begin - last + n, n)


@dataclass
class Step:
    """From owners, which are keys or shorter runs, to runs of one shape: where those of each owner begin and how many they are, the runs, the edits they may have. For either side's letters that the owner
    doesn't hold two stretches of the text, from a place on and so wide, in which the nearer and the farther half of them may stand, and each run's letters as bits, by code modulo 32; letters of several readings have none."""

    shape: int
    begin: np.ndarray
    counts: np.ndarray
    members: np.ndarray
    edits: int
    sections: list[list[tuple[int, int]]]
    marks: list[np.ndarray]


class Sieve:
    """Needles to be found in many texts at once.

    A run is a stretch of a needle with one piece of it held in place: where its characters begin, those left of the piece's key, the key's and those right of it, the edits it may have. Runs lead from the
    shortest to the longest, the whole needle; a run that several needles share is one.
    """

    def __init__(self, needles: Iterable[str], encoder: Encoder, threshold: float = 0.75):
        self.needles, self.encoder = list(needles), encoder
        code: dict[str, int] = {}
        keys: dict[tuple[int, ...], int] = {}
        known: dict[tuple, int] = {}
        runs: list[tuple[int, int, int, int, int, int]] = []
        first: dict[tuple[int, int], None] = {}
        after: dict[tuple[int, int], None] = {}
        letters: list[tuple[int, ...]] = []
        for no, text in enumerate(self.needles):
            tokens = [tuple(code.setdefault(r, len(code) + 1) for r in sorted(t)) for t in encoder.encode(text)]
            k, at = allowed(len(tokens), threshold), len(letters)
            edges = [len(tokens) * i // (k + 1) for i in range(k + 2)]
            letters += tokens
            around: list[list[tuple[int, int]]] = [[] for _ in range(k + 1)]
            halves = [(0, k + 1)]
            while halves:
                a, b = halves.pop()
                for piece in range(a, b) if b - a > 1 or not k else ():
                    around[piece].insert(0, (a, b))
                if b - a > 1:
                    middle = (a + b + 1) // 2
                    halves += [(a, middle), (middle, b)]
            for piece, chain in enumerate(around):
                size = min(edges[piece + 1] - edges[piece], KEY)
                below = None
                for a, b in chain:
                    whole, begin, end = b - a == k + 1, edges[a], edges[b]
                    left, edits = edges[piece] - begin, b - a - 1
                    key = (no if whole else tuple(tokens[begin:end]), left, size, edits)
                    run = known.setdefault(key, len(runs))
                    if run == len(runs):
                        runs.append((at + begin, left, size, end - begin - left - size, edits, no if whole else -1))
                    if below is None:
                        for readings in product(*tokens[edges[piece] : edges[piece] + size]):
                            first[keys.setdefault(readings, len(keys)), run] = None
                    else:
                        after[below, run] = None
                    below = run
        self.code, self.base = code, len(code) + 2
        shapes, shape = np.unique(np.array([(*r[1:5], r[5] >= 0) for r in runs], np.int64).reshape(-1, 5), axis=0, return_inverse=True)
        self.shapes, shape = shapes.tolist(), shape.reshape(-1)
        # runs are numbered within their shape, after those of the shapes before
        order = np.argsort(shape, kind="stable")
        number, shape = np.argsort(order, kind="stable"), shape[order]
        self.begin, self.no = np.array([(r[0], r[5]) for r in runs], np.int64).reshape(-1, 2)[order].T.copy()
        self.lowest = np.searchsorted(shape, np.arange(len(self.shapes) + 1))
        self.lengths = np.array([len(encoder.encode(n)) for n in self.needles], np.int64)
        self.most = max((r[4] for r in runs), default=0)
        self.reach = int(self.lengths.max(initial=0)) + self.most + 1
        self.kind = np.uint8 if self.base < 256 else np.uint16 if self.base < 65_536 else np.uint32
        self.letters = self.arrays(letters, self.base - 1)
        # steps from run to run, by the shapes of both
        self.after: list[list[Step]] = []
        steps = number[np.array(list(after), np.int64).reshape(-1, 2)]
        for source in range(len(self.shapes)):
            low, high = self.lowest[source : source + 2]
            own = steps[shape[steps[:, 0]] == source]
            own[:, 0] -= low
            self.after.append(self.steps(shape, own, high - low, *self.shapes[source][:3:2]))
        # the keys as a trie: a state and the next reading lead to a state of the next level
        self.levels: list[np.ndarray] = []
        self.firsts: list[list[Step]] = []
        by_key: dict[int, list[int]] = {}
        for key, run in first:
            by_key.setdefault(key, []).append(run)
        states: dict[tuple[int, ...], int] = {(): 0}
        for depth in range(max(map(len, keys), default=0) + 1):
            if depth:
                steps = sorted({(states[k[: depth - 1]], k[depth - 1], k[:depth]) for k in keys if len(k) >= depth})
                states = {prefix: i for i, (_, _, prefix) in enumerate(steps)}
                self.levels.append(np.array([s * self.base + c for s, c, _ in steps], np.int64))
            here = [(states[k], run) for k, i in keys.items() if len(k) == depth for run in by_key[i]]
            own = np.array(here, np.int64).reshape(-1, 2)
            own[:, 1] = number[own[:, 1]]
            self.firsts.append(self.steps(shape, own, len(states), 0, 0))
        # a run comes before those it lies in
        self.order = sorted(range(len(self.shapes)), key=lambda s: sum(self.shapes[s][:3]))

    def arrays(self, tokens: Sequence[tuple[int, ...]], none: int) -> list[np.ndarray]:
        """The first readings of all tokens, the second ones and so on; none: where there are fewer."""
        most = max(map(len, tokens), default=1) or 1
        return [np.array([t[i] if i < len(t) else none for t in tokens], self.kind) for i in range(most)]

    def steps(self, shape: np.ndarray, pairs: np.ndarray, n: int, left: int, right: int) -> list[Step]:
        """Pairs of one of n owners and a run, by the run's shape; the edits left and right of the key are known for so many letters."""
        out, of = [], shape[pairs[:, 1]]
        for to in np.unique(of).tolist():
            some = pairs[of == to]
            begin, counts, members = grouped(some[:, 0], some[:, 1], n)
            sections, marks = [], []
            bits = np.left_shift(np.uint64(1), self.letters[0].astype(np.uint64) % np.uint64(32))
            for more in self.letters[1:]:
                bits[more != self.base - 1] = 0
            whole_left, size, whole_right, edits, _ = self.shapes[to]
            for known, length, step in ((right, whole_right, 1), (left, whole_left, -1)):
                if known == length:
                    continue
                mark, section = np.zeros(len(members), np.uint64), []
                for half, (a, b) in enumerate(((known, (known + length + 1) // 2), ((known + length + 1) // 2, length))):
                    near, far = max(0, a - edits), b + edits
                    section.append((size + near if step > 0 else -far, max(1, far - near)))
                    for i in range(a, b):
                        mark |= bits[self.begin[members] + whole_left + (size + i if step > 0 else -1 - i)] << np.uint64(32 * half)
                sections.append(section)
                marks.append(mark)
            out.append(Step(to, begin, counts, members, edits, sections, marks))
        return out

    def spread(self, heard: Callable[[int], np.ndarray], places: np.ndarray, owners: np.ndarray, paid: np.ndarray | None, step: Step) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each place with each run of its owner, HITS at a time, if it may stand there after what is paid for the letters that are known: any other that isn't near its place costs an edit, too."""
        n = step.counts[owners]
        some = np.flatnonzero(n)
        places, begin, n = places[some], step.begin[owners[some]], n[some]
        seen = [~(heard(w0).take(places + a0).astype(np.uint64) | heard(w1).take(places + a1).astype(np.uint64) << np.uint64(32)) for (a0, w0), (a1, w1) in step.sections]
        room = None if paid is None else np.minimum(step.edits - paid[some], 255).astype(np.uint8)
        for at, to in stretches(n):
            some = n[at:to]
            which, here = each(begin[at:to], some), np.repeat(places[at:to], some)
            missing = [np.bitwise_count(mark.take(which) & np.repeat(there[at:to], some)) for mark, there in zip(step.marks, seen)]
            if missing:
                fits = np.flatnonzero(reduce(np.add, missing) <= (step.edits if room is None else np.repeat(room[at:to], some)))
                which, here = which.take(fits), here.take(fits)
            yield here, step.members.take(which)

    def beside(self, text: Sequence[np.ndarray], begin: np.ndarray, letters: Sequence[np.ndarray], at: np.ndarray, length: int, edits: int, step: int) -> np.ndarray:
        """The least edits between so many letters and any stretch of the text, both read from a place on (step 1) or before it (step -1); more than edits: at least one more.

        A cell of the band is a diagonal of the edit table; all hits go through it together.
        """
        kind = np.uint8 if length + edits < 250 else np.int64
        away = lambda arrays, places, i: [a.take(places + (i if step > 0 else -1 - i)) for a in arrays]
        heard = [away(text, begin, j) for j in range(length + edits)]
        cells = {d: kind(d if d >= 0 else edits + 1) for d in range(-edits, edits + 1)}
        for i in range(length):
            own, new = away(letters, at, i), {}
            for d in cells:
                if i + d < -1:
                    new[d] = kind(edits + 1)
                elif i + d == -1:
                    new[d] = kind(i + 1)
                else:
                    differs = reduce(np.logical_and, [x != y for x in heard[i + d] for y in own])
                    cell = cells[d] + differs.view(np.uint8)
                    if d < edits:
                        cell = np.minimum(cell, cells[d + 1] + kind(1))
                    if d > -edits:
                        cell = np.minimum(cell, new[d - 1] + kind(1))
                    new[d] = cell
            cells = new
        return np.broadcast_to(reduce(np.minimum, cells.values()), begin.shape)

    def tried(self, text: Sequence[np.ndarray], places: np.ndarray, runs: np.ndarray, shape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hits whose runs, all of one shape, stand at their places with no more edits than they may have, and the edits."""
        left, size, right, edits, _ = self.shapes[shape]
        cost = np.zeros(len(runs), np.int64)
        for length, step in ((right, 1), (left, -1)):
            if length and len(runs):
                begin, at = (places + size, self.begin[runs] + left + size) if step > 0 else (places, self.begin[runs] + left)
                cost = cost + self.beside(text, begin, self.letters, at, length, edits, step)
                fits = np.flatnonzero(cost <= edits)
                places, runs, cost = places[fits], runs[fits], cost[fits]
        return places, runs, cost

    def states(self, text: Sequence[np.ndarray], places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of keys the places and the states of the trie that are read there."""
        state = np.zeros(len(places), np.int64)
        for depth in range(len(self.firsts)):
            if depth:
                level, steps = self.levels[depth - 1], []
                for readings in text:
                    want = state * self.base + readings.take(places + depth - 1)
                    to = np.minimum(np.searchsorted(level, want), len(level) - 1)
                    there = level[to] == want
                    steps.append((places[there], to[there]))
                places, state = (np.concatenate(x) for x in zip(*steps))
            yield depth, places, state

    def read(self, texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The readings of all texts in a row, the places in them (a text's end is one, too), and where each text begins."""
        # between texts stand characters without readings, more than there may be edits
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = self.most + 1
        starts = self.reach + np.cumsum(sizes + gap) - (sizes + gap)
        row = "\0" * self.reach + "".join(t + "\0" * gap for t in texts) + "\0" * self.reach
        inside = np.zeros(len(row), bool)
        places = np.repeat(starts, sizes + 1) + np.arange(len(texts) + sizes.sum()) - np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
        inside[np.delete(places, np.cumsum(sizes + 1) - 1)] = True
        signs = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.unique(signs)
        codes = [tuple(c for r in sorted(self.encoder._encode(chr(sign))[0]) if (c := self.code.get(r))) for sign in known.tolist()]
        phrases = [(p, [tuple(c for r in sorted(t) if (c := self.code.get(r))) for t in said]) for p, said in self.encoder.phrases.items() if p in row]
        most = max([1, *map(len, codes), *(len(t) for _, said in phrases for t in said)])
        readings, of = [], np.zeros(int(known[-1]) + 1, self.kind)
        for i in range(most):
            of[known] = [t[i] if i < len(t) else 0 for t in codes]
            readings.append(np.where(inside, of[signs], self.kind(0)))
        for phrase, said in phrases:
            at = row.find(phrase)
            while at >= 0:
                for j, t in enumerate(said):
                    for i in range(most):
                        readings[i][at + j] = t[i] if i < len(t) else 0
                at = row.find(phrase, at + len(phrase))
        return readings, places, starts

    def together(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, needle (both by number) and similarity of all pairs that reach the threshold."""
        text, where, starts = self.read(texts)
        bits = np.zeros(len(text[0]), np.uint32)
        for readings in text:
            bits |= np.where(readings > 0, np.left_shift(np.uint32(1), readings.astype(np.uint32) % np.uint32(32)), np.uint32(0))
        wide: dict[int, np.ndarray] = {1: bits}

        def heard(width: int) -> np.ndarray:
            """The marks of all stretches so wide, by where they begin."""
            if width not in wide:
                half = heard((width + 1) // 2)
                both = half.copy()
                both[: len(half) - width // 2] |= half[width // 2 :]
                wide[width] = both
            return wide[width]

        span, found = self.most + 1, [np.empty(0, np.int64)]
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.shapes]
        held = [0] * len(self.shapes)

        def add(places: np.ndarray, owners: np.ndarray, paid: np.ndarray | None, step: Step) -> None:
            """Hits wait until they are many."""
            for hits in self.spread(heard, places, owners, paid, step):
                waiting[step.shape].append(hits)
                held[step.shape] += len(hits[0])
                if held[step.shape] >= HITS:
                    settle(step.shape)

        def settle(shape: int) -> None:
            if held[shape]:
                places, runs = (np.concatenate(x) for x in zip(*waiting[shape]))
                waiting[shape], held[shape] = [], 0
                places, runs, cost = self.tried(text, places, runs, shape)
                if self.shapes[shape][0]:
                    # where a whole run stands unharmed all its pieces do: the hit of the first one goes on
                    harmed = np.flatnonzero(cost)
                    places, runs, cost = places[harmed], runs[harmed], cost[harmed]
                if self.shapes[shape][4]:
                    pair = (np.searchsorted(starts, places, "right") - 1) * len(self.needles) + self.no[runs]
                    found.append(np.unique(pair * span + cost))
                for step in self.after[shape]:
                    add(places, runs - self.lowest[shape], cost, step)

        for at in range(0, len(where), TEXT_CHARS):
            for depth, places, states in self.states(text, where[at : at + TEXT_CHARS]):
                for step in self.firsts[depth]:
                    add(places, states, None, step)
        for shape in self.order:
            settle(shape)
        found = np.unique(np.concatenate(found))
        found = found[np.unique(found // span, return_index=True)[1]]  # of a pair's hits the one with the least edits
        pair, edits = found // span, found % span
        text, no = pair // max(1, len(self.needles)), pair % max(1, len(self.needles))
        return text, no, 1.0 - edits / self.lengths[no]


def blocks(needles: DataFrame, column: str) -> Iterator[list[str]]:
    """The distinct needles in blocks that are small enough to be sent."""
    block, chars = [], 0
    for row in needles.select(F.col(column).alias("needle")).filter("needle <> ''").distinct().sort("needle").toLocalIterator():
        if len(block) == BLOCK_NEEDLES or (block and chars + len(row.needle) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append(row.needle)
        chars += len(row.needle)
    if block:
        yield block


def portions(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts that are looked at together, with the number of the first."""
    some, first, chars = [], 0, 0
    for i, text in enumerate(texts):
        if some and chars + len(text) > TEXT_CHARS:
            yield first, some
            some, first, chars = [], i, 0
        some.append(text)
        chars += len(text)
    if some:
        yield first, some


def mentions(sieve: Sieve, rows: Sequence[int], texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, needle and similarity of all pairs that reach the threshold, a bounded number at a time; each row has one of the texts, which are distinct, by number."""
    begin, counts, members = grouped(np.asarray(rows, np.int64), np.arange(len(rows)), len(texts))
    for first, some in portions(texts):
        at, no, score = sieve.together(some)
        n = counts[at + first]
        for a, b in stretches(n):
            yield members[each(begin[at[a:b] + first], n[a:b])], np.repeat(no[a:b], n[a:b]), np.repeat(score[a:b], n[a:b])


def contained(texts: DataFrame, needles: DataFrame, encoder: Encoder, key: str, text: str = "text", needle: str = "needle", threshold: float = 0.75) -> DataFrame:
    """key, needle, similarity of all pairs of a text and a needle that it holds with at least the threshold. Both sides' texts are normalised."""
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, needle string, similarity double"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = texts.select(F.col(key), F.col(text).alias("text")).repartition(parts, "text").sortWithinPartitions("text")

    def pass_of(block: list[str]) -> DataFrame:
        sent = Sent(spark, Sieve(block, encoder, threshold))

        def look(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sieve = sent.value
            names = pa.array(sieve.needles, pa.string())
            for batch in batches:
                said = batch.column(1).fill_null("").dictionary_encode()
                for row, no, score in mentions(sieve, said.indices.to_numpy(), said.dictionary.to_pylist()):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(no)), pa.array(score, pa.float64())], names=[key, "needle", "similarity"])

        return known.mapInArrow(look, schema)

    passes = [pass_of(block) for block in blocks(needles, needle)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
