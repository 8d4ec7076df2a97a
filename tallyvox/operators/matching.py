"""Matching utterances with checklist items: slot outcomes, scores and verdicts.

Pairs come from an equi-join on the ticket (with a band of item positions where the pointer is known);
the score of each distinct pair of texts is computed once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.functions.phonetic import Encoder, containment, similarity
from tallyvox.operators.fuzzy import Index
from tallyvox.operators.slots import Extractor, Slot
from tallyvox.settings import Settings
from tallyvox.shipping import Sent
from tallyvox.tables import free_name

WEAK = "匹配证据偏弱，未发现必要槽位矛盾"
OUTCOMES = "array<struct<name: string, value: string, outcome: string, score: double, required: boolean, weight: double, heard: string>>"
MATCH = f"struct<score: double, verdict: string, slot_score: double, sentence_similarity: double, penalty: double, outcomes: {OUTCOMES}, reasons: array<string>>"


def described(name: str, value: str, outcome: str, score: float, heard: str | None) -> str:
    if outcome == "CONFLICT":
        return f"{name}: 票面「{value}」但复述为「{heard}」"
    return f"{name}: 缺失「{value}」" if outcome == "MISSING" else f"{name}: 命中「{value}」({score:.2f})"


class Matcher:
    """Scores one item's text against one utterance; both normalised."""

    def __init__(self, extractor: Extractor, encoder: Encoder, settings: Settings | None = None):
        self.extractor, self.encoder, self.settings = extractor, encoder, settings or Settings()
        self.rivals = {group: Index(filter(None, values), encoder, self.settings.hit) for group, values in extractor.groups.items()}

    def instead(self, value: str, group: str | None, text: str, than: float) -> str | None:
        """The value of the group that stands in the text in place of the expected one: the most similar that reaches the threshold and beats it, the first of equals."""
        index = self.rivals.get(group)
        heard = [(-score, no) for no, score in index.found(text) if score is not None and score > than and index.needles[no] != value] if index else []
        return index.needles[min(heard)[1]] if heard else None

    def alike(self, a: str, b: str) -> float:
        return similarity(self.encoder.encode(a), self.encoder.encode(b))

    def within(self, needle: str, hay: str) -> float:
        return containment(self.encoder.encode(needle), self.encoder.encode(hay))

    def outcome(self, slot: Slot, heard: Sequence[Slot], text: str) -> tuple[str, float, str | None]:
        """HIT, MISSING or CONFLICT of one slot, its score, and what was said instead."""
        name, value, group = slot[:3]
        hit, groups = self.settings.hit, re.findall(r"\d+", text)
        number = "".join(re.findall(r"\d+", value)) if name in self.settings.exact_digits else ""
        said = [s[1] for s in heard if s[0] == name]
        if said:
            fit = [v for v in said if "".join(re.findall(r"\d+", v)) == number] if number else said
            closest = max(fit or said, key=lambda v: self.alike(value, v))
            score = self.alike(value, closest) if fit else 0.0
            return ("HIT", score, None) if fit and score >= hit else ("CONFLICT", 0.0, closest)
        if number and number not in groups:
            frame = re.sub(r"\d+", "", value)
            if frame and self.within(frame, text) >= hit:
                return "CONFLICT", 0.0, "编号" + ("/".join(groups) or "无")
            return "MISSING", 0.0, None
        own = self.within(value, text)
        if own >= hit:
            return "HIT", own, None
        other = self.instead(value, group, text, own)
        return ("MISSING", own, None) if other is None else ("CONFLICT", 0.0, other)

    def verdict(self, score: float, outcomes: Sequence[dict]) -> tuple[str, list[str]]:
        told = [o for o in outcomes if o["outcome"] == "CONFLICT" or (o["outcome"] == "MISSING" and o["required"])]
        reasons = [described(o["name"], o["value"], o["outcome"], o["score"], o["heard"]) for o in told]
        missing = any(o["outcome"] == "MISSING" for o in told)
        if any(o["outcome"] == "CONFLICT" and o["required"] for o in told) or (missing and self.settings.missing_fails):
            return "FAIL", reasons
        if score >= self.settings.passing:
            return ("REVIEW" if missing else "PASS"), reasons
        return "REVIEW", reasons if score >= self.settings.review else [*reasons, WEAK]

    def match(self, item: str, utterance: str) -> dict:
        own, heard = self.extractor.extract(item), self.extractor.extract(utterance)
        outcomes = []
        for slot in own:
            outcome, score, instead = self.outcome(slot, heard, utterance)
            outcomes.append({"name": slot[0], "value": slot[1], "outcome": outcome, "score": score, "required": slot[0] in self.settings.required, "weight": float(self.settings.weights.get(slot[0], 1.0)), "heard": instead})
        weight = sum(o["weight"] for o in outcomes) or 1.0
        slot_score = sum(o["weight"] * o["score"] for o in outcomes) / weight
        sentence = self.alike(item, utterance)
        extra = {s[0] for s in heard if s[0] in self.settings.discriminative} - {s[0] for s in own}
        penalty, share = self.settings.extra_penalty * len(extra), self.settings.sentence_weight
        score = max(0.0, (1 - share) * slot_score + share * sentence - penalty)
        verdict, reasons = self.verdict(score, outcomes)
        return {"score": score, "verdict": verdict, "slot_score": slot_score, "sentence_similarity": sentence, "penalty": penalty, "outcomes": outcomes, "reasons": reasons}


def scored_pairs(pairs: DataFrame, matcher: Matcher, item: str = "norm", utterance: str = "heard") -> DataFrame:
    """pairs with a struct `match`; each distinct pair of texts is scored once."""
    sent = Sent(pairs.sparkSession, matcher)  # word lists, the syllable table and settings: a fixed size

    @F.pandas_udf(MATCH)
    def score(items: pd.Series, said: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = [known.get(k) or known.setdefault(k, sent.value.match(*k)) for k in zip(items, said)]
        return pd.DataFrame(rows, columns=["score", "verdict", "slot_score", "sentence_similarity", "penalty", "outcomes", "reasons"])

    distinct = pairs.select(item, utterance).distinct()
    return pairs.join(distinct.withColumn("match", score(F.col(item), F.col(utterance))), [item, utterance])


def candidates(utterances: DataFrame, items: DataFrame) -> DataFrame:
    """All items of an utterance's ticket; items of one ticket are few.

    Comparing texts costs far more than reading them, so the partitions are as many as configured and aren't merged by their bytes.
    """
    parts = int(utterances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return utterances.repartition(parts, "ticket_id").join(items.repartition(parts, "ticket_id"), "ticket_id")


def band_candidates(utterances: DataFrame, items: DataFrame, settings: Settings, pointer: str = "pointer", pos: str = "pos") -> DataFrame:
    """The items from lookback before to lookahead after each utterance's pointer, joined by stretches of positions.

    Positions fall into stretches as long as the band, so an utterance meets two of them at most and the join gives rows in proportion to the band, however long a ticket is.
    """
    width = settings.lookback + settings.lookahead + 1
    stretch = free_name(utterances, free_name(items, "_stretch"))
    reached = F.sequence(F.floor((F.col(pointer) - settings.lookback) / width), F.floor((F.col(pointer) + settings.lookahead) / width))
    parts = int(utterances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = utterances.filter(F.col(pointer).isNotNull()).withColumn(stretch, F.explode(reached)).repartition(parts, "ticket_id", stretch)
    placed = items.withColumn(stretch, F.floor(F.col(pos) / width)).repartition(parts, "ticket_id", stretch)
    return in_window(said.join(placed, ["ticket_id", stretch]), settings, pointer, pos).drop(stretch)


def in_window(pairs: DataFrame, settings: Settings, pointer: str = "pointer", pos: str = "pos") -> DataFrame:
    """Only the items from lookback before to lookahead after the pointer."""
    return pairs.filter(F.col(pos).between(F.col(pointer) - settings.lookback, F.col(pointer) + settings.lookahead))


def best_per_utterance(pairs: DataFrame, key: Sequence[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """The best candidate of each utterance; of equal scores the one with the lowest position."""
    to = free_name(pairs, "_place")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), F.asc(pos)))
    return pairs.withColumn(to, place).filter(F.col(to) == 1).drop(to)


def outcomes_of(matches: DataFrame) -> DataFrame:
    """One row for each slot outcome, for conflicts and missing slots in the order of the slots."""
    return matches.select("*", F.posexplode("match.outcomes").alias("slot_no", "slot")).select("*", "slot.*").drop("slot")


def conflicts(outcomes):
    return F.filter(outcomes, lambda o: o["outcome"] == "CONFLICT")


def missing(outcomes):
    return F.filter(outcomes, lambda o: o["outcome"] == "MISSING")
