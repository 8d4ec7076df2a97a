"""Nearest neighbours and licence scans against brute force."""

import numpy as np
import pytest

from tallyvox.llm import licenses, neighbours


def brute(rows, k, every=20):
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q % every == 0:
            out[q] = sorted({(-float((v * w).sum()), i) for i, w in fine if i != q})[:k]
    return out


def rows_of(n, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(n)]


def found(spark, rows, **kw):
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' AS id", "1 AS v", "2 AS score")
    out = {}
    for r in neighbours.nearest(v, v.filter("vec_id % 20 = 0"), **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_exact_where_all_leaves_are_opened(spark):
    odd = [(20_000, None), (20_020, [0.0] * 8), (20_040, [1.0] * 7 + [None]), (20_060, [float("nan")] * 8), (20_080, [1.0] * 7), (None, [1.0] * 8)]
    rows = rows_of(300)
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(1040, rows[3][1])] * 2 + odd
    got, want = found(spark, rows, trees=2, leaf=32, probes=10_000), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[0] for x in got[q]] == list(range(1, len(want[q]) + 1)) and [x[1] for x in got[q]] == [i for _, i in want[q]]
        assert [x[2] for x in got[q]] == pytest.approx([-s for s, _ in want[q]], abs=1e-12)


def test_recall(spark):
    rows = rows_of(3000, 2)
    got, want = found(spark, rows, trees=16, leaf=64, probes=60), brute(rows, 20)
    hit = sum(len({x[1] for x in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_recall_holds_where_the_trees_have_many_more_leaves_than_are_opened_at_least(spark):
    rows = rows_of(6000, 3)
    got, want = found(spark, rows, trees=8, leaf=32, probes=8), brute(rows, 20)
    hit = sum(len({x[1] for x in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_exact_where_leaves_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKED", 20)
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(-2, 3, 8).astype(np.float32).tolist()) for i in range(500)]  # many equal scores and equal vectors
    rows += [(500 + i, [1.0] * 7 + [2.0]) for i in range(60)]
    got, want = found(spark, rows, trees=2, leaf=128, probes=10_000, block=16), brute(rows, 20)
    assert {q: [(i, s) for _, i, s in x] for q, x in got.items()} == {q: [(i, -s) for s, i in x] for q, x in want.items()}


def test_places_in_the_walk():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 8))
    forest = neighbours.grown(x, 4, float(np.linalg.norm(x, axis=1).max()), 3)
    first = []
    for q in x[:20]:
        order = np.argsort(forest.margins(forest.lifted(q[None], True)[0]), kind="stable")
        walk = forest.probes(q[None], 48)[0]
        assert [(i >> 4, i & 15) for i in order.tolist()] == walk
        first.append(min(walk.index((t, leaf)) for t, leaf in enumerate(forest.leaves(q[None])[0].tolist())))
    assert forest.needed(x[:20], [q[None] for q in x[:20]], 1.0) == max(first) + 1


def test_few_and_none(spark):
    assert found(spark, []) == {} and found(spark, [(0, [1.0, 0.0])]) == {}
    assert [x[1] for x in found(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])])[0]] == [1, 2]


TEXTS = [
    (1, "Licensed under CC BY-NC 4.0."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "x All RIGHTS  reserved y all rights reserved"),
    (4, "all rights are reserved; cc, by"), (5, ""), (6, None), (7, "Released under the MIT License"), (8, "the license the license under the"), (9, "ccéby cc-by"), (10, "general " * 60_000 + "public license"),
]


def test_licenses(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "'x' AS labels")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    for i, text in TEXTS:
        words = licenses.words_of(text)
        places = sorted({(k, p) for p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()})
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({licenses.BASE[p] for _, p in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1].labels == "cc-by,cc-by-nc-4.0" and got[2].labels == "gpl,gpl-3.0" and got[7].labels == "mit" and got[8].labels == ""
    assert licenses.scanned(df.limit(0)).count() == 0


def test_all_notices_of_a_file_are_found():
    texts = [t.text for t in licenses.TEMPLATES]
    common = {w: 900 - i for i, w in enumerate("the of and to is any this in version 2 0 4 license under licensed work".split())}
    index = licenses.Index(licenses.TEMPLATES, licenses.BASE, common, 1000)
    for k in range(1, len(texts) + 1):
        for at in range(len(texts)):
            some = [(at + i) % len(texts) for i in range(k)]
            labels = index.scan(licenses.words_of(" filler words that mean nothing here at all ".join(texts[i] for i in some)))[4]
            assert {licenses.TEMPLATES[i].label for i in some} <= labels


def test_every_start_with_enough_words_in_place_is_found():
    draw, index = np.random.default_rng(6), licenses.Index(licenses.TEMPLATES, licenses.BASE, {}, 10)
    for label, words, required in index.templates:
        fixed = {i for p in required for i in range(len(words)) for j in range(len(p)) if words[i - j : i - j + len(p)] == p and i >= j}
        for _ in range(50):
            free = draw.permutation([i for i in range(len(words)) if i not in fixed])
            gone = set(free[: int(len(words) * (1 - licenses.LEAST) + 1e-9)].tolist())
            assert label in index.scan(["x", *("zz" if i in gone else w for i, w in enumerate(words))])[4]


def brute_labels(words, templates):
    """Each template at each start, word by word."""
    found = set()
    for label, t, required in templates:
        for start in range(1 - len(t), len(words)):
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t)) / len(t)
            if share >= licenses.LEAST:
                near = words[max(0, start - licenses.REACH) : start + len(t) + licenses.REACH]
                if all(any(near[i : i + len(p)] == p for i in range(len(near))) for p in required):
                    found.add(label)
    return found


def test_labels_equal_brute_force():
    draw, n = np.random.default_rng(12), 0
    for frequent in ({}, {w: 900 - i for i, w in enumerate("the of and to is any this in version 2 0 4 license under licensed work".split())}):
        index = licenses.Index(licenses.TEMPLATES, licenses.BASE, frequent, 1000)
        every = sorted({w for _, t, _ in index.templates for w in t})
        for _ in range(150):
            words = []
            for t in draw.choice(len(index.templates), draw.integers(0, 4)):
                part = list(index.templates[t][1])
                for _ in range(draw.integers(0, 4)):
                    i = int(draw.integers(len(part)))
                    part[i : i + int(draw.integers(0, 2))] = [str(draw.choice(every))] * int(draw.integers(0, 2))
                    part = part or ["x"]
                words += part + [str(x) for x in draw.choice(every + ["zz"], draw.integers(0, 6))]
            want = brute_labels(words, index.templates)
            assert index.scan(words)[4] == want
            n += len(want)
    assert n > 200
