"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyvox.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def features(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, longest, buckets):
            s[f] += 1
    for text in target:
        for f in features(text, longest, buckets):
            t[f] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for doc, text in docs:
        found = features(text, longest, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = i + 1
    return sorted(map(lambda r: tuple(r[:5]), rows), key=str)


@pytest.mark.parametrize("lengths", [[1], [0, 1, 2, 63, 64, 65], [5000, 1, 70_000]])
def test_crc_of_concatenations(lengths):
    draw = random.Random(1)
    pairs = [(draw.randbytes(draw.randint(0, 9)), draw.randbytes(n)) for n in lengths * 5]
    got = importance.joined(*(np.array(x) for x in ([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs], [len(b) for _, b in pairs])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_runs_over_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    text = "Aa bb, ccc-d é日本 E F2 " * 9 + "x" * 500
    for longest in (1, 2, 4):
        got = [f for _, part in importance.feature_blocks(text, importance.Words(), longest, 977) for f in part.tolist()]
        assert sorted(got) == sorted(features(text, longest, 977))
    assert sum(n for n, _ in importance.feature_blocks(text, importance.Words(), 3, 977)) == len(words(text))


def made(seed=5, n=120):
    draw = random.Random(seed)
    vocabulary = ["Ab", "bc", "été", "日本", "x1", "THE", "of", "q" * 80] + [f"w{i}" for i in range(60)]
    docs = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(n)]
    docs += [(n, docs[3][1]), (3, docs[3][1]), (n + 1, ""), (n + 2, None), (None, docs[5][1] + " a b" * 20), (n + 3, "... !"), (n + 4, "one " * 40_000)]
    return docs, [" ".join(draw.choices(vocabulary[8:30], k=30)) for _ in range(6)] + [None, ""]


def tables(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'r' AS rank", "1 AS bucket", "2 AS n", "'s' AS score")
    return d, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 500, 50), (2, 7, 100)])
def test_against_brute_force(spark, longest, buckets, percent):
    docs, target = made()
    out = importance.resampled(*tables(spark, docs, target), longest=longest, buckets=buckets, percent=percent)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(docs, target, longest, buckets, percent=percent)


def test_query(spark, tmp_path):
    docs, target = made(7, 200)
    d, t = tables(spark, docs, target)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    t.selectExpr("1L AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op13_importance(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, target)


def test_empty_tables(spark):
    docs, target = made()
    assert importance.resampled(*tables(spark, [], target)).count() == 0
    got = importance.resampled(*tables(spark, docs, [])).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, [])
