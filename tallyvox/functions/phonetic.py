"""Phonetic encoding with a dialect's confusions, and similarities of encoded texts.

A text becomes one set of readings per character: a Chinese character its syllable in the
dialect's representative form, a digit itself and its readings, anything else itself. Two
positions match if their sets share a reading. Syllables come from the transliterator that
ships with Spark, read once on the driver; the table has a fixed size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.settings import DIALECT
from tallyvox.shipping import Sent

FIRST, LAST = 0x4E00, 0x9FFF
#: Phrases whose reading differs from that of their characters alone.
PHRASES = {"就地": ["jiu", "di"], "重合": ["chong", "he"], "重复": ["chong", "fu"], "一行": ["yi", "hang"]}
_TABLES: dict[str, dict[str, str]] = {}


def syllables(spark: SparkSession) -> dict[str, str]:
    """The toneless syllable of each Chinese character that has one."""
    if "han" not in _TABLES:
        latin = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; NFD; [:Mn:] Remove; NFC; Lower")
        umlaut = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Lower")
        table = {}
        for at in range(FIRST, LAST + 1, 4096):
            chars = [chr(c) for c in range(at, min(at + 4096, LAST + 1))]
            plain, toned = (t.transliterate("\n".join(chars)).split("\n") for t in (latin, umlaut))
            for ch, p, t in zip(chars, plain, toned):
                p = p.strip()
                if p.isascii() and p.isalpha():
                    table[ch] = p.replace("u", "v") if any(u in t for u in "üǖǘǚǜ") else p
        _TABLES["han"] = table
    return _TABLES["han"]


class Dialect:
    """The representative of each syllable: first its initial, then its final, then the whole."""

    def __init__(self, groups: Mapping[str, object] = DIALECT, enabled: bool = True):
        named = {part: {m: g[0] for g in groups.get(part) or [] for m in g} for part in ("initials", "finals", "syllables")}
        by_length = lambda names: sorted(names, key=lambda n: (-len(n), n))
        self.enabled = enabled
        self.initials = [(k, named["initials"][k]) for k in by_length(named["initials"])]
        self.finals = [(k, named["finals"][k]) for k in by_length(named["finals"])]
        self.whole = named["syllables"]
        self.digits = {str(d): frozenset([str(d), *map(self.folded, r)]) for d, r in (groups.get("digits") or {}).items()}

    def folded(self, syllable: str) -> str:
        if not self.enabled or not syllable:
            return syllable
        start = next((x for x in self.initials if syllable.startswith(x[0])), ("", ""))
        syllable = start[1] + syllable[len(start[0]) :]
        end = next((x for x in self.finals if syllable.endswith(x[0])), ("", ""))
        syllable = syllable[: len(syllable) - len(end[0])] + end[1]
        return self.whole.get(syllable, syllable)


def load_dialect(path: str, root: str = ".") -> Dialect:
    """A dialect from a YAML file: enabled, initials, finals, syllables, digit_readings. Several readings of one character can't be had, so a file that asks for them is an error."""
    import yaml

    from tallyvox.settings import rooted

    tree = yaml.safe_load(rooted(path, root).read_text(encoding="utf-8")) or {}
    if tree.get("heteronym"):
        raise ValueError("heteronym: one reading a character is known")
    return Dialect({**{k: tree.get(k) or [] for k in ("initials", "finals", "syllables")}, "digits": tree.get("digit_readings") or {}}, tree.get("enabled", True))


#: Characters of texts whose readings an encoder remembers, and characters whose own sets it does.
REMEMBERED, SINGLES = 1_000_000, 65_536


class Encoder:
    """Texts to sequences of reading sets. Equal characters share one set, and what is remembered is bounded in characters, not in texts."""

    def __init__(self, table: Mapping[str, str], dialect: Dialect | None = None, phrases: Mapping[str, Sequence[str]] = PHRASES):
        dialect = dialect or Dialect()
        self.of = {ch: frozenset([dialect.folded(s)]) for ch, s in table.items()} | dialect.digits
        self.phrases = {p: [frozenset([dialect.folded(s)]) for s in r] for p, r in phrases.items()}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[frozenset, ...]] = {}
        self.single: dict[str, frozenset] = {}
        self.room = REMEMBERED

    def encode(self, text: str) -> tuple[frozenset, ...]:
        tokens = self.known.get(text)
        if tokens is None:
            tokens = self._encode(text)
            if len(text) <= REMEMBERED // 10:
                self.room -= len(text) + 1
                if self.room < 0:
                    self.known.clear()
                    self.room = REMEMBERED - len(text) - 1
                self.known[text] = tokens
        return tokens

    def alone(self, ch: str) -> frozenset:
        """The set of a character that has no reading but itself."""
        found = frozenset([ch])
        if len(self.single) < SINGLES:
            self.single[ch] = found
        return found

    def _encode(self, text: str) -> tuple[frozenset, ...]:
        of, single = self.of.get, self.single.get
        out = [of(ch) or single(ch) or self.alone(ch) for ch in text]
        for phrase, readings in self.phrases.items():
            at = text.find(phrase)
            while at >= 0:
                out[at : at + len(phrase)] = readings
                at = text.find(phrase, at + len(phrase))
        return tuple(out)

    def readable(self, text: str) -> list[str]:
        return ["|".join(sorted(t)) or "?" for t in self.encode(text)]

    def __reduce__(self):
        return _restored, (self.of, self.phrases)


def _restored(of, phrases) -> Encoder:
    e = Encoder.__new__(Encoder)
    e.of, e.phrases = of, phrases
    e.forget()
    return e


class Pattern:
    """A sequence of reading sets, ready to be aligned with others: for each reading the places that have it, as bits of one integer."""

    def __init__(self, tokens: Sequence[frozenset]):
        self.n, self.places = len(tokens), {}
        for i, readings in enumerate(tokens):
            for r in readings:
                self.places[r] = self.places.get(r, 0) | 1 << i

    def costs(self, other: Sequence[frozenset], anywhere: bool) -> Iterator[int]:
        """The edits between the whole pattern and each prefix of other, from the empty one on; anywhere: of the prefix only its best ending counts.

        A column of the edit table is two bit vectors: where a cell is one more than the one above it, and where one less. A column follows from
        the one before in a few operations on whole integers, whatever the pattern's length; places match where the sets share a reading.
        """
        top, full, first = 1 << self.n >> 1, (1 << self.n) - 1, 0 if anywhere else 1
        more, less, cost, places = full, 0, self.n, self.places.get
        yield cost
        if not self.n:
            yield from (first * (j + 1) for j in range(len(other)))
            return
        for readings in other:
            equal = 0
            for r in readings:
                equal |= places(r, 0)
            diagonal = (((equal & more) + more) ^ more) | equal
            right_more, right_less = less | (full & ~(diagonal | more)), more & diagonal
            if right_more & top:
                cost += 1
            elif right_less & top:
                cost -= 1
            yield cost
            right_more, right_less = right_more << 1 | first, right_less << 1
            straight = equal | less
            more, less = (right_less | ~(straight | right_more)) & full, right_more & straight & full

    def distance(self, other: Sequence[frozenset], limit: int | None = None) -> int:
        """The edits between both; with a limit, limit + 1 as soon as they are known to be more."""
        if limit is None:
            return deque(self.costs(other, False), 1)[0]
        left = len(other)
        if abs(self.n - left) > limit:
            return limit + 1
        for cost in self.costs(other, False):
            if cost - left > limit:
                return limit + 1
            left -= 1
        return min(cost, limit + 1)

    def within(self, other: Sequence[frozenset]) -> int:
        """The least edits between the pattern and any part of other."""
        best = self.n
        for cost in self.costs(other, True):
            if cost < best:
                best = cost
                if not best:
                    break
        return best


def _alignment(a: Sequence[frozenset], b: Sequence[frozenset], anywhere: bool) -> np.ndarray:
    """The last row of the edit table of a against b: costs of all of a against each prefix of b.

    anywhere: an alignment may begin at any place of b for nothing.
    """
    return np.fromiter(Pattern(a).costs(b, anywhere), dtype=np.int64, count=len(b) + 1)


def edit_distance(a: Sequence[frozenset], b: Sequence[frozenset]) -> int:
    return Pattern(a).distance(b)


def similarity(a: Sequence[frozenset], b: Sequence[frozenset]) -> float:
    """One minus the edits by the longer length; 1 for two empty sequences."""
    longest = max(len(a), len(b))
    return 1.0 if not longest else max(0.0, 1.0 - edit_distance(a, b) / longest)


def containment(needle: Sequence[frozenset], hay: Sequence[frozenset]) -> float:
    """How well the needle stands anywhere in the hay; 1 for an empty needle, else 0 in an empty hay."""
    if not needle or not hay:
        return float(not needle)
    return max(0.0, 1.0 - Pattern(needle).within(hay) / len(needle))


def contains(encoder: Encoder, needle: str, hay: str, threshold: float = 0.75) -> tuple[bool, float]:
    score = containment(encoder.encode(needle), encoder.encode(hay))
    return score >= threshold, score


def similarities(pairs: DataFrame, encoder: Encoder, a: str, b: str, to: str = "similarity") -> DataFrame:
    """pairs with the similarity of two columns of normalised texts; null where one is null. One Arrow pass."""
    sent = Sent(pairs.sparkSession, encoder)  # the syllable table: a fixed size

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        encode = sent.value.encode
        return pd.Series([None if s is None or t is None else similarity(encode(s), encode(t)) for s, t in zip(x, y)], dtype="float64")

    return pairs.withColumn(to, similar(F.col(a), F.col(b)))


def encoder_for(spark: SparkSession, dialect: Dialect | None = None) -> Encoder:
    return Encoder(syllables(spark), dialect)


def native_tokens(text: Column, table: Mapping[str, str], dialect: Dialect | None = None) -> Column:
    """The reading sets as array<array<string>> without Python, for texts over a small alphabet of characters: table needs only those."""
    dialect = dialect or Dialect()
    known = {ch: [dialect.folded(s)] for ch, s in table.items()} | {d: sorted(r) for d, r in dialect.digits.items()}
    of = F.create_map(*(x for ch, r in known.items() for x in (F.lit(ch), F.array(*map(F.lit, r)))))
    return F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.coalesce(F.element_at(of, ch), F.array(ch)))


def native_readable(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.array_join(F.array_sort(t), "|"))


def native_last_row(a: Column, b: Column, anywhere: bool) -> Column:
    """The last row of the edit table as a Column, for a and b of array<array<string>>."""
    zero = F.lit(0)
    start = F.transform(F.sequence(zero, F.size(b)), lambda j: F.lit(0) if anywhere else j)

    def row(above: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            differs = F.when(F.arrays_overlap(x, F.get(b, j - 1)), 0).otherwise(1)
            return F.concat(done, F.array(F.least(F.get(above, j - 1) + differs, F.get(above, j) + 1, F.element_at(done, -1) + 1)))

        inner = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(inner, F.array(F.get(above, zero) + 1), cell)

    return F.aggregate(a, start, row)


def native_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.element_at(native_last_row(a, b, False), -1) / longest))


def native_containment(needle: Column, hay: Column) -> Column:
    score = F.greatest(F.lit(0.0), 1.0 - F.array_min(native_last_row(needle, hay, True)) / F.size(needle))
    return F.when(F.size(needle) == 0, 1.0).when(F.size(hay) == 0, 0.0).otherwise(score)
