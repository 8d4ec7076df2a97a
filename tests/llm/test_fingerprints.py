"""Fingerprints against a brute-force version."""

import hashlib
import random
import re
import unicodedata

import pytest
import xxhash

from tallyvox.llm import fingerprints, queries


def canonical(text):
    t = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().encode()


def brute(docs, bits=128):
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest(r[1].encode())))
    n = len(rows)
    edited = []
    for i, (_, t) in enumerate(rows):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + rows[(i + 1) % n][1][:half])
    buckets = {}
    for t in [t for _, t in rows] + edited:
        c = canonical(t)
        buckets.setdefault(xxhash.xxh3_128_digest(c)[16 - bits // 8 :], set()).add(c)

    def of(t):
        c = canonical(t)
        d = xxhash.xxh3_128_digest(c)[16 - bits // 8 :]
        return d.hex() + (f"-{sorted(buckets[d]).index(c) + 1}" if len(buckets[d]) > 1 else "")

    out = []
    for i, (d, t) in enumerate(rows):
        own, edit, following = of(t), of(edited[i]), of(rows[(i + 1) % n][1])
        out.append((d, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), own, edit, float(own == edit), float(own == following), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n=120, seed=3):
    draw = random.Random(seed)
    words = ["the", "The", "of", "ﬁne", "fine", "STRASSE", "straße", "é", "é", "Å", "日本", "　", "\n", "  ", "x", "①", "1"]
    docs = [(i * 3, " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 3, 9])))) for i in range(n)]
    docs += [(i, "same text of a large group") for i in range(1, 90, 3)] + [(i, "Same  text of a LARGE group") for i in range(2, 90, 3)]
    return docs + [(500, None), (501, ""), (None, "no id"), (None, "no other id"), (3, docs[1][1]), (3, docs[1][1]), (3, "third"), (900, "long " * 50_000), (901, "long " * 50_000), (902, "a" + "̣́" * 10)]


def frame(spark, docs, parts=5):
    rows = list(docs)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS digest", "1 AS part", "'k' AS _key", "2 AS n_chars").repartition(parts)


@pytest.mark.parametrize("bits", [128, 8])
def test_against_brute_force(spark, bits):
    docs = made()
    got = fingerprints.neighbours(frame(spark, docs), bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, bits)


def test_query(spark, tmp_path):
    docs = made(40, 8)
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_fingerprints(spark, str(tmp_path))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs)


def test_small_tables(spark):
    for docs in ([], [(1, "alone in it")], [(1, None)], [(None, "a b c d"), (2, "e")]):
        assert sorted(map(tuple, fingerprints.neighbours(frame(spark, docs, 2)).collect()), key=str) == brute(docs)


def test_canonical_contents():
    same = ["Straße  ONE", "strasse one", "STRASSE　one\n", " straSSe\tone"]
    assert len({fingerprints.canonical(t) for t in same}) == 1
    assert fingerprints.canonical("é") == fingerprints.canonical("É") and fingerprints.canonical(None) == b""
    assert len(fingerprints.canonical("a" + "̣́" * 300_000)) > 600_000  # in linear time
