"""Language identification by held-out accuracy; language-model scores against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyvox.llm import langid, lm, queries

WORDS = {"en": "the of and that with from have this", "de": "der und nicht mit auf sich eine ist", "fr": "les des une que dans pour avec est", "es": "los del que una por con para como", "it": "gli che della con per una sono non", "nl": "het een van dat niet met voor zijn"}


def corpus(langs):
    draw = np.random.default_rng(4)
    return [(i, " ".join(draw.choice(WORDS[lang].split(), 30)), lang) for i, lang in enumerate(langs * 20)]


def write(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS score", "'y' AS block", "'z' AS held_out").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("langs", [["en"], ["en", "de"], ["en", "de", "fr", "es"], list(WORDS)])
def test_held_out_accuracy(spark, tmp_path, langs):
    rows = corpus(langs)
    got = queries.op4_language(spark, write(spark, rows, tmp_path)).collect()
    of = {i: lang for i, _, lang in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred == of[r.doc_id] and 0 <= r.score <= 1 and not r.ambiguous


def test_odd_texts(spark, tmp_path):
    rows = corpus(["en", "de"]) + [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 ...", None), (1003, "the of and der und nicht", None), (1004, "the of " * 40_000, None), (None, "the of and", "en")]
    got = {r.doc_id: r for r in queries.op4_language(spark, write(spark, rows, tmp_path)).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004].lang_pred == "en" and got[None].held_out is False
    assert got[1003].score < got[1004].score


def test_nothing_learned(spark, tmp_path):
    got = queries.op4_language(spark, write(spark, [(1, "the", None), (2, None, None)], tmp_path)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert queries.op4_language(spark, write(spark, [], tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", range(2, 12))
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code.tolist()}) == n and (np.abs(code.sum(axis=0, dtype=int)) < n).all()


def brute_language(rows, text):
    """Language, score and flag of a text by dictionaries over the learned (lang, text) rows, trigram by trigram."""
    cell = lambda g: ((int.from_bytes(g, "big") * 0x9E3779B1) % (1 << 32)) >> 17
    grams = lambda t: [cell(d[i : i + 3]) for d in [b" " + langid.folded(t) + b" "] for i in range(len(d) - 2)]
    langs = sorted({lang for lang, _ in rows})
    count = {lang: Counter(g for of, t in rows if of == lang for g in grams(t)) for lang in langs}
    share = {lang: [(count[lang][c] + 0.5) / (sum(count[lang].values()) + 0.5 * langid.CELLS) for c in range(langid.CELLS)] for lang in langs}
    code = langid.codewords(len(langs)).tolist()
    sides = [([i for i in range(len(langs)) if code[i][b] > 0], [i for i in range(len(langs)) if code[i][b] < 0]) for b in range(len(code[0]))]
    mean = lambda some, c: sum(share[langs[i]][c] for i in some) / len(some)
    weight = [sum((mean(p, c) - mean(q, c)) * math.log(mean(p, c) / mean(q, c)) for c in range(langid.CELLS)) for p, q in sides]
    weight = [w * len(weight) / sum(weight) for w in weight]

    def decoded(some):
        margin = [sum(math.log(mean(p, c) / mean(q, c)) for c in some) / len(some) for p, q in sides]
        loss = [sum(w * math.log1p(math.exp(-langid.EVIDENCE * x * m)) for w, x, m in zip(weight, word, margin)) for word in code]
        best = loss.index(min(loss))
        return best, 1 / sum(math.exp(min(loss) - x) for x in loss), sum((m > 0) - (m < 0) != x for m, x in zip(margin, code[best]))

    def fits(some):
        return max(sum(math.log((count[x][c] * langid.CELLS / sum(count[x].values()) + 0.01) / 1.01) for c in some) / len(some) for x in langs) >= 0

    of = grams(text)
    if not fits(of):
        return "und", 0.0, True
    best, score, wrong = decoded(of)
    parts = [of[i : i + 128] for i in range(0, len(of) - 127, 128)]
    votes = [decoded(x)[0] for x in parts if fits(x)]
    mixed = len(votes) > 1 and sum(v != best for v in votes) >= 0.2 * len(votes)
    return langs[best], score, score < 0.6 or wrong * 4 > len(code[0]) or mixed


def test_decoding_equals_brute_force(spark):
    rows = [(lang, text) for _, text, lang in corpus(["en", "de", "nl"])][:24]
    model = langid.learned(spark.createDataFrame(rows, "lang string, text string"))
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice(sum((WORDS[x].split() for x in some), []), n)) for some in (["en"], ["de"], ["en", "nl"], ["de", "nl"]) for n in (1, 3, 40)]
    texts += [f"{rows[0][1]} {rows[1][1]}", "xyzzy qqq", "the", "é", f"{rows[0][1] * 2} 123 {rows[2][1]}"]
    for text, lang, score, flag in zip(texts, *model.predict(texts)):
        want = brute_language(rows, text)
        assert (lang, flag) == (want[0], want[2]) and score == pytest.approx(want[1], rel=1e-4, abs=1e-6), text


def test_mixtures_are_flagged(spark):
    rows = corpus(["en", "de", "fr", "es"])
    model = langid.learned(spark.createDataFrame([(lang, text) for _, text, lang in rows], "lang string, text string"))
    some = {lang: " ".join(t for _, t, x in rows if x == lang) for lang in ("en", "de", "fr", "es")}
    mixed = [some[a][:400] + " " + some[b][:400] for a in some for b in some if a < b]
    assert all(model.predict(mixed)[2]) and not any(model.predict([t[:900] for t in some.values()])[2])


def test_languages_are_bounded_and_blocks_change_nothing(spark, monkeypatch):
    rows = [(lang, text) for _, text, lang in corpus(["en", "de", "fr"])] + [("it", "gli che della"), ("nl", "het een van"), ("nl", None), ("qq", "123")] + [("en", "the of and")] * 3
    model = langid.learned(spark.createDataFrame(rows, "lang string, text string"), 3)
    assert model.languages == ["de", "en", "fr"]
    text = " ".join(t for _, t in rows[:60:3]) * 20
    whole = model.predict([text])
    monkeypatch.setattr(langid, "BLOCK", 256)
    assert model.predict([text])[0] == whole[0] and model.predict([text])[1] == pytest.approx(whole[1])
    tie = langid.learned(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    assert tie.predict(["same words"])[0] == ["a"] and tie.predict(["same words"])[2] == [True]


def test_a_very_long_text_takes_a_few_times_its_size(spark):
    import tracemalloc

    langs = [f"l{i:02}" for i in range(20)]
    draw = np.random.default_rng(6)
    model = langid.learned(spark.createDataFrame([(x, " ".join("".join(draw.choice(list("abcdefghij"), 5)) for _ in range(50))) for x in langs], "lang string, text string"))
    text = "abcde fghij " * 400_000
    tracemalloc.start()
    model.predict([text])
    assert tracemalloc.get_traced_memory()[1] < 8 * len(text)
    tracemalloc.stop()


def brute(rows):
    """The automaton by dictionaries, token by token."""
    docs = [(i, (t or "").encode().lower().split() + ["END"]) for i, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    train = [w for (_, w), h in zip(docs, out) if not h]
    n_grams = lambda w, k: [tuple((["START"] + w)[j : j + k]) for j in range(len(w) + 2 - k)]
    count = {1: Counter(x for w in train for x in w), 2: Counter(g for w in train for g in n_grams(w, 2)), 3: Counter(g for w in train for g in n_grams(w, 3))}
    n, v = sum(count[1].values()), len(count[1])
    history = lambda g: (len(train) if g[0] == "START" else count[1][g[0]]) if len(g) == 2 else count[2][g[:2]]
    seen, once = Counter(), Counter()
    for k in (2, 3):
        for w in train:
            for g in n_grams(w, k):
                c = int(lm.class_of(np.array([history(g)]))[0])
                seen[k, c] += 1
                once[k, c] += count[k][g] == 1
    fail = lambda g: (once[len(g), int(lm.class_of(np.array([history(g)]))[0])] + 1) / (seen[len(g), int(lm.class_of(np.array([history(g)]))[0])] + 2)

    def weight(g):
        if len(g) == 1:
            return (count[1][g[0]] + 1) / (n + v + 1)
        return (1 - fail(g)) * count[len(g)][g] / history(g) + fail(g) * weight(g[1:]) if history(g) else weight(g[1:])

    rows = []
    for (i, w), h in zip(docs, out):
        base = sum(math.log10(weight((x,))) for x in w)
        model = sum(math.log10(weight(tuple((["START"] + w)[max(0, j - 1) : j + 2]))) for j in range(len(w)))
        rows.append((i, h, len(w), sum(count[1][x] > 0 for x in w), n, base, model))
    return rows, weight, train


def test_scores(spark, tmp_path):
    rows = [(i, t) for i, t, _ in corpus(["en", "de", "fr"])] + [(500, None), (501, ""), (502, "The THE the"), (502, "the"), (None, "of the"), (503, "é É " * 20_000)]
    got = queries.op9_lm(spark, write(spark, [(i, t, "en") for i, t in rows], tmp_path)).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows)[0], key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_scores_of_documents_that_are_no_files(spark):
    rows = [(1, "a b c a b"), (2, "a b"), (2, "a b")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(r[6] for r in brute(rows)[0]))
    assert lm.scored(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def same(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows)[0], key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_long_texts_are_split_and_carry_their_state(spark):
    draw = np.random.default_rng(8)
    text = lambda n: " ".join(draw.choice(WORDS["en"].split(), n))
    rows = [(i, text(int(n))) for i, n in enumerate(draw.integers(1, 60, 40))] + [(100, text(3000)), (101, "\n\n" + "y" * 700 + "  " + text(900) + " " * 600), (102, " " * 900), (102, text(200)), (103, "  " * 400 + "of the")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), segment=256, block_bytes=4096).collect()
    same(got, rows)


def test_a_text_of_50_megabytes(spark):
    rows = [(1, "of the and " * 20), (2, "the of " * 7_500_000), (3, None)]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame([(1, rows[0][1], 1), (2, "the of ", 7_500_000), (3, None, 1)], "doc_id bigint, text string, n int").selectExpr("doc_id", "repeat(text, n) AS text")).collect()}
    assert got[2].n_tokens == 15_000_001 and got[1].n_tokens == 61 and got[3].n_tokens == 1 and got[2].n_known == 15_000_001
    assert got[2].score > got[2].base_score


def test_weights_out_of_every_state_sum_to_one():
    rows = [(i, t) for i, t, _ in corpus(["en"])][:12] + [(50, "x of of the"), (51, "")]
    _, weight, train = brute(rows)
    words = sorted({x for w in train for x in w if x != "END"}) + ["END", "never seen"]
    for h in [(), ("START",), *((x,) for x in words if x != "END"), *{tuple((["START"] + w)[j : j + 2]) for w in train for j in range(len(w) - 1)}]:
        assert sum(weight((*h, x)) for x in words) == pytest.approx(1.0)


def test_packed_numbers():
    draw = np.random.default_rng(9)
    for n in (0, 1, 5, 3000):
        code = np.unique(draw.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (lm.unpacked_codes(lm.packed_codes(code)) == code).all() and (lm.spread_out(lm.squeezed(code)) == code).all()
    for size in (1, 2, 3, 100):
        parts = lm.split(b"  ab cd  e\n", size)
        assert b"".join(parts) == b"  ab cd  e\n" and b" ".join(parts).split() == b"  ab cd  e".split()


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    draw = np.random.default_rng(10)
    words = WORDS["en"].split() + WORDS["de"].split()
    follow = {w: draw.choice(words, 3) for w in words}

    def text():
        out = [draw.choice(words)]
        while len(out) < 40:
            out.append(draw.choice(follow[out[-1]]))
        return " ".join(out)

    got = [r for r in lm.scored(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id bigint, text string")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score > r.base_score for r in got) > 0.9 * len(got)
