"""Evaluation of recognition and matching: rows, summaries and comparison of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import error_kinds, error_rate, normalise

ITEM_STATES = ["VERIFIED", "FLAGGED", "FAILED", "UNCONFIRMED"]


def with_reference(clips: DataFrame, items: DataFrame) -> DataFrame:
    """clips (seq, ...) with the text of the item of their number as `reference`; null where there is none."""
    return clips.join(items.select("seq", F.col("raw").alias("reference")), "seq", "left")


def evaluated(clips: DataFrame) -> DataFrame:
    """clips (reference, hypothesis, ...) with cer_raw, cer_norm and error_kinds; null where there is no reference."""
    ref, hyp = normalise(F.col("reference")), normalise(F.col("hypothesis"))
    has = F.col("reference").isNotNull()
    return clips.select("*", F.when(has, error_rate(F.col("reference"), F.col("hypothesis"))).alias("cer_raw"), F.when(has, error_rate(ref, hyp)).alias("cer_norm"), F.when(has, error_kinds(ref, hyp)).alias("error_kinds"))


def summary(rows: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """clips, audio and inference seconds, rtf (null without audio), mean error rates, alignment accuracy."""
    audio, infer = F.sum("audio_seconds"), F.sum("infer_seconds")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clips"), F.round(audio, 2).alias("total_audio_seconds"), F.round(infer, 2).alias("total_infer_seconds"), F.round(F.try_divide(infer, audio), 4).alias("rtf"),
        F.round(F.avg("cer_raw"), 4).alias("mean_cer_raw"), F.round(F.avg("cer_norm"), 4).alias("mean_cer_norm"), F.round(F.avg(F.col("aligned").cast("double")), 4).alias("align_accuracy"),
    )


def verdicts(rows: DataFrame, by: Sequence[str] = ("label",), column: str = "verdict") -> DataFrame:
    """by, verdicts: a map of how often each verdict occurs; rows without one don't count."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("verdicts"))


def histogram(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def state_pivot(states: DataFrame, by: Sequence[str], column: str = "state", values: Sequence[str] = ITEM_STATES) -> DataFrame:
    """One row per group with a count for each of the fixed states, 0 where none."""
    wide = states.groupBy(*by).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.fillna(0, list(values))


def compared(before: DataFrame, after: DataFrame, by: Sequence[str], values: Sequence[str] = ITEM_STATES) -> DataFrame:
    """Runs side by side for the groups that both have: before_x, after_x and change_x for each state x."""
    named = lambda df, side: df.select(*by, *(F.col(v).alias(f"{side}_{v}") for v in values))
    both = named(before, "before").join(named(after, "after"), list(by))
    return both.select("*", *((F.col(f"after_{v}") - F.col(f"before_{v}")).alias(f"change_{v}") for v in values))
