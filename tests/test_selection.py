"""Exact medians against Spark's own, and the band join."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvox.operators import selection, speech
from tallyvox.operators.matching import band_candidates, candidates, in_window
from tallyvox.settings import Settings


def made(seed, n=900):
    draw = random.Random(seed)
    rows = [("many", draw.choice([0.0, 1.0, 2.0, 2.0, None])) for _ in range(n)] + [("wide", draw.choice([1, -1]) * 10 ** draw.uniform(-300, 300)) for _ in range(n + 1)]
    rows += [("edge", x) for x in [1.0] * 300 + [2.0] * 300] + [("one", 5.0), ("none", None), (None, 3.0), (None, 4.0), ("odd", 7.0), ("odd", 7.0), ("odd", -1.0)]
    return rows + [("even", float(i)) for i in range(600)]


@pytest.mark.parametrize("limit,steps", [(5, 4), (50, 16), (10_000, 256)])
def test_medians_equal_sparks(spark, monkeypatch, limit, steps):
    monkeypatch.setattr(selection, "STEPS", steps)
    df = spark.createDataFrame(made(limit), "g string, x double").selectExpr("*", "1 AS _value", "'q' AS k")
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    got = {r.g: r["median"] for r in selection.medians(df, ["g"], "x", limit=limit).collect()}
    assert got == want
    assert selection.medians(df, [], "x", limit=limit).first()[0] == df.agg(F.median("x")).first()[0]


def test_medians_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert selection.medians(empty, ["g"], "x").count() == 0


def test_bands_with_clashing_names(spark):
    df = spark.createDataFrame([("a", i, float(i % 4)) for i in range(9)], "recording string, idx long, rms double")
    odd = df.selectExpr("*", "1 AS middle", "2 AS _middle", "3 AS _role", "4 AS _turn", "5 AS _filled")
    want = [tuple(r) for r in speech.temporal_prior(speech.role_bands(df)).orderBy("idx").collect()]
    found = speech.temporal_prior(speech.role_bands(odd)).orderBy("idx")
    assert [tuple(r) for r in found.select("recording", "idx", "rms", "ratio", "role", "confidence", "source").collect()] == want
    assert found.select("middle", "_middle", "_role", "_turn", "_filled").distinct().collect() == [(1, 2, 3, 4, 5)]


@pytest.mark.parametrize("before,after", [(1, 2), (0, 0), (3, 1)])
def test_band_join_gives_the_window(spark, before, after):
    draw = random.Random(before)
    items = spark.createDataFrame([(t, p, f"{t}{p}") for t in "ab" for p in range(40)], "ticket_id string, pos int, norm string").withColumn("_stretch", F.lit(0))
    said = spark.createDataFrame([(t, i, draw.choice([None, draw.randint(-5, 45)])) for t in "abc" for i in range(60)], "ticket_id string, idx long, pointer int")
    s = Settings(lookback=before, lookahead=after)
    got = band_candidates(said, items, s)
    want = in_window(candidates(said, items), s)
    key = lambda df: sorted(map(tuple, df.select("ticket_id", "idx", "pos").collect()))
    assert key(got) == key(want)
    # an utterance meets two stretches at most
    assert "_stretch" in got._jdf.queryExecution().toString() and got.count() <= said.count() * (before + after + 1)
