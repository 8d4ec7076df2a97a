"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import pytest

from tallyvox.llm import exact_dedup, minhash
from tallyvox.llm.components import components

SCHEMA = "doc_id bigint, text string, n bigint, id string, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", "y") for i, t in rows], SCHEMA)


def test_exact_groups(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (9, "a b"), (3, None), (4, ""), (None, "a b"), (None, "z"), (7, " a b"), (8, "x" * 100_000)]
    got = exact_dedup.decided(table(spark, rows), files_per_batch=1).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for key, ids in by.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(own) == len(ids) and all(r.keep_id == (min(known) if known else None) and r.group_size == len(ids) for r in own)
        assert sum(r.kept for r in own) == 1


@pytest.mark.parametrize("digits", [64, 1])
def test_deliveries_meet_the_state_of_those_before(spark, tmp_path, monkeypatch, digits):
    """Also with a digest of one digit, under which different texts clash."""
    whole = exact_dedup.digest_of
    monkeypatch.setattr(exact_dedup, "digest_of", lambda content: whole(content).substr(1, digits))
    deliveries = [[(5, "a b"), (6, "a  b"), (None, "z"), (7, None)], [], [(1, "a b"), (2, "new"), (3, "new"), (4, ""), (8, "z"), (9, "y " * 9000)], [(0, "new"), (10, "more"), (10, "more")]]
    seen = {}
    for number, rows in enumerate(deliveries):
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((number, i))
        for _ in range(2 if number == 2 else 1):  # a repeated call changes nothing
            got = exact_dedup.delivered(table(spark, rows), str(tmp_path), number, files_per_batch=1).collect()
            want = []
            for text, places in seen.items():
                own = [(n, i) for n, i in places if n == number]
                digest = hashlib.sha256(text.encode()).hexdigest()[:digits]
                want += [(i, places[0][1], len(places), digest, places[0][0] == number and k == 0) for k, (_, i) in enumerate(own)]
            assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_exact_kept_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "a"), (None, None)]
    kept = exact_dedup.deduplicated(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "id", "kept"]
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([(1, "a"), (1, "b"), (None, None)], key=str)


def test_exact_empty(spark):
    assert exact_dedup.decided(table(spark, [])).count() == 0
    assert exact_dedup.deduplicated(table(spark, [])).count() == 0


def words(text):
    return (text or "").encode().lower().split()


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = [(i, s) for i, ss in sets.items() for s in ss if s and i is not None]
    for k, (i, a) in enumerate(every):
        for j, b in every[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


@pytest.fixture(scope="module")
def near_rows():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = draw.choices(vocabulary, k=draw.choice([3, 8, 30, 120, 400]))
        for _ in range(draw.choice([1, 1, 2, 6, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "One"), (904, "one"), (None, "one"), (903, "two words"), (905, "two  WORDS"), (906, "long " * 50_000)]


def test_near_components(spark, near_rows):
    got = minhash.linked(table(spark, near_rows)).collect()
    want = brute(near_rows)
    assert len(got) == len(near_rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {(i, len({tuple(words(t)[k : k + 5]) for k in range(max(len(words(t)) - 4, 1))}) if words(t) else 0) for i, t in near_rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_near_kept_rows(spark, near_rows):
    rows = near_rows[:40]
    want = brute(rows)
    assert {r.doc_id for r in minhash.deduplicated(table(spark, rows)).collect()} == {i for i, c in want.items() if i == c}


def test_near_empty(spark):
    assert minhash.linked(table(spark, [])).count() == 0
    assert minhash.linked(table(spark, [(1, None)])).collect()[0].component_id == 1


def test_blocks_join_all_components(spark, monkeypatch):
    """A large group whose centre is far from many members, in small blocks."""
    draw, base = random.Random(8), [f"w{i}" for i in range(100)]
    rows = []
    for n in range(60):
        copy = list(base)
        for k in draw.sample(range(100), draw.choice([1, 2, 3, 4])):
            copy[k] = f"x{n}-{k}"
        rows.append((n, " ".join(copy)))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in minhash.linked(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_registers_estimate_similarity():
    hashes = minhash.Hashes()
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(400, 4400))
    ra, rb = (minhash.registers(minhash.shingles(t, hashes)) for t in (a, b))
    j, some = minhash.estimate(ra[None], rb[None])
    assert abs(j[0] - 3592 / 4400) < 0.1 and some[0] == minhash.BUCKETS


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_columns_named_like_helpers_stay(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words stand in here", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string").selectExpr("*", *(f"mark AS {c}" for c in ("_key", "_dropped", "_digest", "_gone", "_language", "_keep")))
    for kept in (exact_dedup.deduplicated(docs), minhash.deduplicated(docs)):
        assert kept.columns == docs.columns and sorted((r.doc_id, r._key, r._gone) for r in kept.collect()) == [(1, "x", "x"), (3, "z", "z")]
