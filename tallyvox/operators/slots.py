"""Slot extraction: a normalised sentence into its named key elements.

Layers of patterns claim spans in order; a span is claimed only if all of it is still free, so
what an earlier layer took no later one can take. What stays free is the residual.

The words of all layers, assets among them, are one trie with failure links: a text is read once, from left to right, whatever the number of words, and
its finds are then claimed by layer, the longest words first.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox import settings as S
from tallyvox.shipping import Sent

SLOTS = "array<struct<name: string, value: string, grp: string, start: int, end: int>>"
Slot = tuple[str, str, str | None, int, int]


def alternatives(terms: Iterable[str]) -> str:
    """One of the terms; nothing matches where there are none."""
    return "|".join(map(re.escape, terms)) or "(?!)"


class Trie:
    """Several words found in one pass over a text.

    A state is the longest part read so far that begins any word. Where no arc goes on, its failure link leads to the state of the longest
    end of that part which begins a word as well; its output link to the next shorter end that is a word.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: dict[int, int] = {}  # from a state and a sign, in one number, to a state
        self.word: list[str | None] = [None]
        levels: list[list[tuple[int, int, int]]] = []
        for word in words:
            state = 0
            for depth, sign in enumerate(map(ord, word)):
                following = self.arcs.get(state << 21 | sign)
                if following is None:
                    following = self.arcs[state << 21 | sign] = len(self.word)
                    self.word.append(None)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((state, sign, following))
                state = following
            if state:
                self.word[state] = word
        self.fail, self.shorter = array("q", [0]) * len(self.word), array("q", [0]) * len(self.word)
        for level in levels:  # a shorter end is known before it is needed
            for state, sign, following in level:
                end = self.step(self.fail[state], sign) if state else 0
                self.fail[following] = end
                self.shorter[following] = end if self.word[end] is not None else self.shorter[end]

    def step(self, state: int, sign: int) -> int:
        while state and state << 21 | sign not in self.arcs:
            state = self.fail[state]
        return self.arcs.get(state << 21 | sign, 0)

    def finds(self, text: str) -> dict[str, list[int]]:
        """The places of each word that occurs, as a search from left to right finds them that goes on after each find."""
        found: dict[str, list[int]] = {}
        state, arcs, word, shorter = 0, self.arcs, self.word, self.shorter
        for end, sign in enumerate(map(ord, text), 1):
            following = arcs.get(state << 21 | sign)
            state = self.step(state, sign) if following is None else following
            known = state if word[state] is not None else shorter[state]
            while known:
                w = word[known]
                places = found.setdefault(w, [])
                if not places or places[-1] + len(w) <= end - len(w):
                    places.append(end - len(w))
                known = shorter[known]
        return found


class Extractor:
    """normalise projects the word lists into the space of the texts; a plain function of strings."""

    def __init__(self, normalise: Callable[[str], str], assets: Sequence[str] = (), words: S.Vocabulary | None = None):
        words = words or S.Vocabulary()

        def listed(terms: Iterable[str]) -> list[str]:
            return sorted({normalise(t) for t in terms} - {""}, key=lambda t: (-len(t), t))

        positions, actions, suffixes = listed(words.positions), listed(words.actions), alternatives(listed(words.suffixes))
        self.stopwords = listed(words.stopwords)
        prefix = f"(?:{alternatives(sorted(set(normalise(words.prefix_chars))))})"
        place = alternatives(positions)
        self.switch = re.compile(f"(?:由|从)?({place})(?:{alternatives(listed(S.SWITCH_VERBS))})({place})")
        self.confirmed = re.compile(f"(?:确在|处于|在)({place})(?:位置|状态)")
        self.voltage = re.compile(r"\d{1,4}(?:kv|mw|kw|kva|v|a)")
        self.devices = [re.compile(rf"{prefix}{{0,4}}\d{{1,5}}号?(?:{suffixes})"), re.compile(rf"{prefix}{{1,4}}(?:{suffixes})")]
        # a position that is an action as well counts as a position only within a switch or a confirmation
        self.layers = [
            ("object", "object", listed(words.objects)),
            ("handle", "handle", listed(words.handles)),
            ("device", "device", listed(assets)),
            ("position", "position", [p for p in positions if p not in actions]),
            ("check_type", "check_type", listed(words.checks)),
            ("action", "action", actions),
            ("panel", None, listed(words.panels)),
            ("state", None, listed(words.states)),
        ]
        #: Which layers a word stands in, and the order in which words are claimed: by layer, the longest first.
        self.places = {}
        for no, (_, _, terms) in enumerate(self.layers):
            for rank, term in enumerate(terms):
                self.places.setdefault(term, []).append((no, rank))
        self.trie = Trie(self.places)
        #: The values of each exclusive group, for telling a wrong word from a missing one.
        self.groups = {"position": positions, "object": self.layers[0][2], "handle": self.layers[1][2], "action": actions, "check_type": self.layers[4][2]}

    def extract(self, text: str) -> list[Slot]:
        free, found = [True] * len(text), []

        def claim(start: int, end: int, *slots: Slot) -> None:
            if all(free[start:end]):
                free[start:end] = [False] * (end - start)
                found.extend(slots)

        for m in self.switch.finditer(text):
            claim(*m.span(), ("src_position", m[1], "position", *m.span(1)), ("dst_position", m[2], "position", *m.span(2)), ("action", "切至", "action", *m.span()))
        for m in self.confirmed.finditer(text):
            claim(*m.span(1), ("position", m[1], "position", *m.span(1)))
        for m in self.voltage.finditer(text):
            claim(*m.span(), ("voltage", m[0], "voltage", *m.span()))
        places = self.trie.finds(text)
        for no, _, term in sorted((no, rank, term) for term in places for no, rank in self.places[term]):
            name, group, _ = self.layers[no]
            for at in places[term]:
                if not (name == "position" and term == "合闸" and text[:at].endswith("重")):
                    claim(at, at + len(term), (name, term, group, at, at + len(term)))
        for pattern in self.devices:
            for start, end in self.gaps(free):
                for m in pattern.finditer(text[start:end]):
                    a, b = start + m.start(), start + m.end()
                    claim(a, b, ("device", m[0], "device", a, b))
        rest = "".join(text[a:b] for a, b in self.gaps(free))
        for word in self.stopwords:
            rest = rest.replace(word, "")
        if rest := re.sub(r"[^一-鿿0-9a-z]", "", rest):
            found.append(("residual", rest, None, 0, 0))
        return sorted(found, key=lambda s: s[3])

    @staticmethod
    def gaps(free: Sequence[bool]) -> list[tuple[int, int]]:
        """The runs of free places."""
        edges = [i for i in range(len(free) + 1) if (i < len(free) and free[i]) != (i > 0 and free[i - 1])]
        return list(zip(edges[::2], edges[1::2]))


def with_slots(texts: DataFrame, extractor: Extractor, column: str = "norm", to: str = "slots") -> DataFrame:
    """texts with the slots of a column of normalised text; one Arrow pass, each distinct text of a batch once. Null has no slots."""
    sent = Sent(texts.sparkSession, extractor)  # word lists only

    @F.pandas_udf(SLOTS)
    def extract(norm: pd.Series) -> pd.Series:
        found = {t: [dict(zip(("name", "value", "grp", "start", "end"), s)) for s in sent.value.extract(t)] for t in norm.dropna().unique()}
        return norm.map(lambda t: found.get(t, []))

    return texts.withColumn(to, extract(F.col(column)))


def occurrences(texts: DataFrame, words: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """key, word, n of every word that a text holds: how often a search from left to right finds it, words of different lengths independently. One pass over each text; null holds none."""
    sent = Sent(texts.sparkSession, Trie(sorted(set(words) - {""})))  # as large as the list of words, which the caller holds

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple[int, str, int]] = []
            for i, value in enumerate(batch.column(1)):
                rows += [(i, word, len(places)) for word, places in sent.value.finds(value.as_py() or "").items()]
            at, found, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=[key, "word", "n"])

    return texts.select(F.col(key), F.col(text).alias("text")).mapInArrow(scan, f"{key} {texts.schema[key].dataType.simpleString()}, word string, n bigint")
