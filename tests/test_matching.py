import itertools
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tallyvox.functions import phonetic as P
from tallyvox.functions.plain import normalised
from tallyvox.operators import fuzzy
from tallyvox.operators.matching import Matcher, best_per_utterance, candidates, in_window, scored_pairs
from tallyvox.operators.slots import Extractor, Trie, occurrences
from tallyvox.plans import fixtures
from tallyvox.settings import Settings


@pytest.fixture(scope="module")
def matcher(spark):
    return Matcher(Extractor(normalised), P.encoder_for(spark))


def match(matcher, seq, said):
    return matcher.match(normalised(fixtures.TICKET[seq - 1]), normalised(said))


def outcome(found, name):
    return next(o["outcome"] for o in found["outcomes"] if o["name"] == name)


@pytest.mark.parametrize(
    "seq, said",
    [(4, fixtures.TICKET[3]), (4, "检查测控屏110kV桥100开关电气位置指示确已拉开"), (3, "拉开幺幺零千伏桥幺零零开关"), (4, "检查测控屏110kV桥100开关电器位置只是确已拉开"), (4, "测控屏110kV桥100开关电气位置指示拉开")],
)
def test_passes(matcher, seq, said):
    assert match(matcher, seq, said)["verdict"] == "PASS"


def test_reversed_direction_fails(matcher):
    found = match(matcher, 2, "将测控屏110kV桥100开关操作方式把手由就地切至远方位置")
    assert found["verdict"] == "FAIL" and outcome(found, "src_position") == outcome(found, "dst_position") == "CONFLICT"


def test_mechanical_for_electrical_fails(matcher):
    found = match(matcher, 4, "检查测控屏110kV桥100开关机械位置指示确已拉开")
    assert found["verdict"] == "FAIL" and outcome(found, "object") == "CONFLICT"


@pytest.mark.parametrize("said", ["拉开110kV桥200开关", "拉开35kV桥100开关"])
def test_wrong_number_does_not_pass(matcher, said):
    assert match(matcher, 3, said)["verdict"] != "PASS"


@pytest.mark.parametrize("said", ["今天天气真好啊", "小李你吃饭了吗", "等一下我接个电话"])
def test_chatter_scores_low(matcher, said):
    assert max(match(matcher, s, said)["score"] for s in range(1, 10)) < Settings().chatter


def test_missing_is_not_conflict(matcher):
    found = match(matcher, 2, "将测控屏桥100开关操作方式把手由远方切至就地位置")
    assert outcome(found, "voltage") == "MISSING" and found["verdict"] != "FAIL"
    strict = Matcher(matcher.extractor, matcher.encoder, Settings(missing_fails=True))
    assert match(strict, 2, "将测控屏桥100开关操作方式把手由远方切至就地位置")["verdict"] == "FAIL"


def test_worked_score(matcher):
    found = match(matcher, 3, "桥100开关")
    assert found["score"] == pytest.approx(0.5737, abs=1e-4) and found["verdict"] == "REVIEW"


def test_every_item_matches_itself_best(matcher):
    for i, raw in enumerate(fixtures.TICKET):
        scores = [match(matcher, s, raw)["score"] for s in range(1, 10)]
        assert scores.index(max(scores)) == i and match(matcher, i + 1, raw)["verdict"] == "PASS"


def test_slots_of_the_sample_ticket():
    found = [[(s[0], s[1]) for s in Extractor(normalised).extract(normalised(t))] for t in fixtures.TICKET]
    assert found[0] == [("check_type", "检查"), ("residual", "解环"), ("voltage", "110kv"), ("state", "符合")]
    assert found[2] == [("action", "拉开"), ("voltage", "110kv"), ("device", "桥100开关")]
    assert found[7] == [("voltage", "110kv"), ("handle", "电压并列把手"), ("action", "切至"), ("src_position", "并列"), ("dst_position", "解列")]
    assert found[8] == [("check_type", "检查"), ("voltage", "110kv"), ("device", "1段母线"), ("object", "电压3相指示"), ("state", "正确")]


def test_assets_and_confirmed_positions():
    e = Extractor(normalised, ["丹东线111开关", "111-1"])
    found = {(s[0], s[1]) for s in e.extract(normalised("检查丹东线111开关机械位置指示确在分闸位置"))}
    assert ("device", "丹东线111开关") in found and ("position", "分闸") in found and not any(n == "action" for n, _ in found)
    assert not any(s[0] == "position" for s in e.extract("投入重合闸"))
    assert e.extract("") == []


def loop_claims(e, text):
    """The word layers claimed by a search for each word, after the switches, confirmations and voltages."""
    free, found = [True] * len(text), []

    def claim(a, b, slot=None):
        if all(free[a:b]):
            free[a:b] = [False] * (b - a)
            found.extend([slot] if slot else [])

    for pattern, group in ((e.switch, 0), (e.confirmed, 1), (e.voltage, 0)):
        for m in pattern.finditer(text):
            claim(*m.span(group))
    for name, group, terms in e.layers:
        for term in terms:
            at = text.find(term)
            while at >= 0:
                if not (name == "position" and term == "合闸" and text[:at].endswith("重")):
                    claim(at, at + len(term), (name, term, group, at, at + len(term)))
                at = text.find(term, at + len(term))
    return found


def test_trie_claims_what_a_loop_over_words_claims():
    draw = random.Random(11)
    signs = "合闸重远方就地开关母线桥1aab"
    for _ in range(30):
        assets = {"".join(draw.choices(signs, k=draw.randint(1, 5))) for _ in range(60)}
        e = Extractor(normalised, assets)
        for _ in range(20):
            text = "".join(draw.choices(signs, k=draw.randint(0, 40)))
            words = {name for name, _, _ in e.layers}
            got = {s for s in e.extract(text) if s[0] in words}
            assert set(loop_claims(e, text)) <= got
            # what else is there comes from patterns
            assert all(s in loop_claims(e, text) or s[0] in ("action", "position", "device") for s in got)


def test_trie_finds_every_word(spark):
    draw = random.Random(12)
    words = {"".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(200)}
    texts = [(i, "".join(draw.choices("abcd", k=draw.randint(0, 80)))) for i in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(texts, "id long, text string").selectExpr("*", "'w' AS word", "1 AS n")
    got = {(r.id, r.word): r.n for r in occurrences(df, [*words, ""], "id").collect()}
    assert got == {(i, w): n for i, t in texts for w in words if (n := (t or "").count(w))}
    many = Trie("".join(draw.choices("abcdefghij", k=12)) for _ in range(50_000))
    text = "".join(draw.choices("abcdefghij", k=200_000))
    began = time.perf_counter()
    many.finds(text)
    assert time.perf_counter() - began < 3  # a loop over the words takes some 50,000 x 20 microseconds at least


def plain_distance(a, b, anywhere):
    row = [0 if anywhere else j for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (not x & y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def test_distances_against_brute_force():
    draw = random.Random(1)
    sets = [frozenset(c) for n in (1, 2) for c in itertools.combinations("abc", n)]
    for _ in range(300):
        a, b = ([draw.choice(sets) for _ in range(draw.randint(0, 6))] for _ in range(2))
        for anywhere in (False, True):
            assert P._alignment(a, b, anywhere).tolist() == plain_distance(a, b, anywhere)
        assert P.edit_distance(a, b) == P.edit_distance(b, a)


def test_long_distances_and_limits():
    draw = random.Random(2)
    sets = [frozenset(c) for n in (1, 2, 3) for c in itertools.combinations("abcdef", n)]
    for _ in range(60):
        a, b = (tuple(draw.choice(sets) for _ in range(draw.randint(0, 150))) for _ in range(2))
        whole, anywhere = plain_distance(a, b, False)[-1], min(plain_distance(a, b, True))
        assert P.edit_distance(a, b) == whole and P.Pattern(a).within(b) == anywhere
        for limit in (0, 1, whole - 1, whole, whole + 3):
            if limit >= 0:
                assert P.Pattern(a).distance(b, limit) == min(whole, limit + 1)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9, 1.0])
def test_fuzzy_index_against_brute_force(spark, threshold):
    draw, e = random.Random(3), P.encoder_for(spark)
    signs = "桥母线开关刀闸一幺二两三100123断路器远方就地知资"
    needles = sorted({"".join(draw.choices(signs, k=draw.randint(1, 9))) for _ in range(150)})
    index = fuzzy.Index(needles, e, threshold)
    for _ in range(40):
        text = "".join(draw.choices(signs, k=draw.randint(0, 25)))
        got = {needles[no]: s for no, s in index.found(text) if s is not None}
        want = {n: s for n in needles if (s := P.containment(e.encode(n), e.encode(text))) >= threshold}
        assert got == want


def test_fuzzy_join(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK_NEEDLES", 7)
    draw, e = random.Random(5), P.Encoder({}, P.Dialect({}), {})
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(4, 9))) for _ in range(40)]
    texts = [(i, " ".join(draw.choices(words, k=8)).replace(draw.choice("abc"), draw.choice(["", "h"]))) for i in range(60)] + [(60, None), (61, "")]
    needles = spark.createDataFrame([(w,) for w in [*words, *words[:5], None, ""]], "needle string")
    df = spark.createDataFrame(texts, "id long, text string").selectExpr("*", "1 AS similarity", "'n' AS needle")
    got = {(r.id, r.needle): r.similarity for r in fuzzy.contained(df, needles, e, "id").collect()}
    want = {(i, w): s for i, t in texts for w in set(words) if (s := P.containment(e.encode(w), e.encode(t or ""))) >= 0.75}
    assert got == want and fuzzy.contained(df, needles.limit(0), e, "id").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("signs", ["abcdef", "123一二三ab"])
def test_many_texts_at_once_against_brute_force(monkeypatch, threshold, signs):
    monkeypatch.setattr(fuzzy, "HITS", 500)
    monkeypatch.setattr(fuzzy, "TEXT_CHARS", 100)
    draw, e = random.Random(4), P.Encoder({"一": "yi", "二": "er", "三": "san"}, P.Dialect({"digits": {"1": ["yi", "yao"], "2": ["er"], "3": ["san"]}}), {})
    needles = sorted({"".join(draw.choices(signs, k=draw.randint(1, 24))) for _ in range(40)})
    texts = ["".join(draw.choices(signs + " ", k=draw.randint(0, 70))) for _ in range(12)] + ["", needles[3], f"{needles[5]} {needles[6]}"]
    text, no, score = fuzzy.Sieve(needles, e, threshold).together(texts)
    got = {(int(t), needles[n]): s for t, n, s in zip(text, no, score)}
    assert len(got) == len(text) and got == {(i, n): s for i, t in enumerate(texts) for n in needles if (s := P.containment(e.encode(n), e.encode(t))) >= threshold}


def test_many_needles_of_few_syllables(spark):
    draw, e = random.Random(6), P.Encoder({}, P.Dialect({}), {})
    syllables = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 4))) for _ in range(30)]
    word = lambda least: next(w for w in iter(lambda: "".join(draw.choices(syllables, k=draw.randint(1, 6))), None) if len(w) >= least)
    needles, texts = sorted({word(12) for _ in range(2_000)}), [" ".join(word(1) for _ in range(120)) for _ in range(40)]
    sieve = fuzzy.Sieve(needles, e)
    began = time.perf_counter()
    text, no, score = sieve.together(texts)
    assert time.perf_counter() - began < 4  # text by text and hit by hit 8 of the 40 texts took 5.6 seconds
    some = range(0, len(needles), 100)
    want = {(i, n): s for i, t in enumerate(texts[:8]) for n in some if (s := P.containment(e.encode(needles[n]), e.encode(t))) >= 0.75}
    assert {(t, n): s for t, n, s in zip(text.tolist(), no.tolist(), score) if t < 8 and n in some} == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    found = fuzzy.contained(df, spark.createDataFrame([(n,) for n in needles[::100]], "needle string"), e, "id")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edits_are_counted_for_few_hits(monkeypatch):
    draw, e = random.Random(7), P.Encoder({}, P.Dialect({}), {})
    syllables = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 4))) for _ in range(30)]
    word = lambda least: next(w for w in iter(lambda: "".join(draw.choices(syllables, k=draw.randint(1, 6))), None) if len(w) >= least)
    needles, texts = sorted({word(12) for _ in range(1_000)}), [" ".join(word(1) for _ in range(100)) for _ in range(12)]
    sieve, counted = fuzzy.Sieve(needles, e), []
    beside = sieve.beside
    monkeypatch.setattr(sieve, "beside", lambda text, begin, *more: counted.append(len(begin)) or beside(text, begin, *more))
    text, no, score = sieve.together(texts)
    assert sum(counted) < 8 * sum(map(len, texts))  # 3.4 for each character; 20.5 when the edits of every hit were counted
    some = range(0, len(needles), 40)
    want = {(i, n): s for i, t in enumerate(texts) for n in some if (s := P.containment(e.encode(needles[n]), e.encode(t))) >= 0.75}
    assert {(t, n): s for t, n, s in zip(text.tolist(), no.tolist(), score) if n in some} == want


def test_read_texts_are_encoded_texts(spark):
    e = P.encoder_for(spark)
    texts = ["就地1重", "", "\0a重合闸就就地", "b", "𝄞就 地", "重复重合一行"]
    sieve = fuzzy.Sieve(["就地重合闸", "一行100", "\0a𝄞重复"], e)
    readings, places, starts = sieve.read(texts)
    known = {c: r for r, c in sieve.code.items()}
    for text, start in zip(texts, starts):
        got = [{known[int(r[start + i])] for r in readings if r[start + i]} for i in range(len(text))]
        assert got == [set(t) & sieve.code.keys() for t in e.encode(text)] and not any(r[start - 1] or r[start + len(text)] for r in readings)
    assert len(places) == sum(len(t) + 1 for t in texts)


def test_equal_texts_are_looked_into_once(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "HITS", 50)
    e = P.Encoder({}, P.Dialect({}), {})
    needles, texts, rows = ["abcdefgh", "stuvwxyz"], ["no", "an abcdefg, stuvxyz", "stuvwxyz"], [1, 0, 1, 2] * 40
    sieve, looked = fuzzy.Sieve(needles, e), []
    monkeypatch.setattr(sieve, "together", lambda some: looked.extend(some) or fuzzy.Sieve.together(sieve, some))
    got = [(int(r), needles[n], s) for row, no, score in fuzzy.mentions(sieve, rows, texts) for r, n, s in zip(row, no, score)]
    want = {(i, n): s for i, t in enumerate(rows) for n in needles if (s := P.containment(e.encode(n), e.encode(texts[t]))) >= 0.75}
    assert looked == texts and len(got) == len(want) == 200 and {(i, n): s for i, n, s in got} == want
    df = spark.createDataFrame([(i, texts[t]) for i, t in enumerate(rows)], "id long, text string")
    found = fuzzy.contained(df, spark.createDataFrame([(n,) for n in needles], "needle string"), e, "id").collect()
    assert len(found) == 200 and {(r.id, r.needle): r.similarity for r in found} == want


def test_rivals_are_those_of_the_loop(matcher):
    draw = random.Random(8)
    said = [normalised(t) for t in fixtures.TICKET] + ["".join(draw.choices("远方就地并列解列合闸分断开投入拉退出检查位置", k=9)) for _ in range(60)]
    for text in said:
        for group, values in matcher.extractor.groups.items():
            for value in values:
                own = matcher.within(value, text)
                scores = [(matcher.within(v, text), -i, v) for i, v in enumerate(values) if v != value]
                best = max(scores, default=(0.0, 0, None))
                want = best[2] if best[0] >= 0.75 and best[0] > own else None
                assert matcher.instead(value, group, text, own) == want


def test_encoder_remembers_a_bounded_number_of_characters():
    e, draw = P.Encoder({}, P.Dialect({}), {}), random.Random(9)
    texts = ["".join(draw.choices("abcdefghij 知", k=1_000)) for _ in range(1_500)]
    tracemalloc.start()
    for text in texts:
        assert e.encode(text) is e.encode(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20_000_000  # a set for each character of 20,000 texts: over 300 MB for these
    assert sum(map(len, e.known)) <= P.REMEMBERED
    long = "a" * P.REMEMBERED
    assert e.encode(long) == (frozenset("a"),) * len(long) and long not in e.known


def test_dialect_and_readings(spark):
    e = P.encoder_for(spark)
    assert e.readable("女就地") == ["lv", "jiu", "di"] and e.readable("知资") == ["zi", "zi"] and e.readable("灰飞") == ["fei", "fei"]
    assert e.readable("1k") == ["1|yao|yi", "k"] and e.encode("")  == ()
    assert P.contains(e, "桥100", "合上桥幺零零开关")[1] > 0.7 and P.similarity((), ()) == 1.0 and P.containment((), e.encode("a")) == 1.0


def test_native_similarity_agrees(spark):
    e, table = P.encoder_for(spark), P.syllables(spark)
    pairs = [("拉开桥100", "合上桥200"), ("知道", "资道"), ("", "a"), ("a", ""), ("", ""), ("远方", "将远方切至")]
    df = spark.createDataFrame(pairs, "a string, b string")
    few = {c: table[c] for a, b in pairs for c in a + b if c in table}
    a, b = P.native_tokens(F.col("a"), few), P.native_tokens(F.col("b"), few)
    for r in df.select("a", "b", P.native_similarity(a, b).alias("s"), P.native_containment(a, b).alias("c"), P.native_readable(a).alias("r")).collect():
        assert r.s == pytest.approx(P.similarity(e.encode(r.a), e.encode(r.b))) and r.c == pytest.approx(P.containment(e.encode(r.a), e.encode(r.b)))


def test_pairs_as_tables(spark, matcher):
    items, said = fixtures.ticket_items(spark), fixtures.utterances(spark, [(t, "OPERATOR") for t in fixtures.TICKET[:3]] * 2)
    scored = scored_pairs(candidates(said, items), matcher)
    best = best_per_utterance(scored.withColumn("score", F.col("match.score")), ["ticket_id", "idx"]).collect()
    assert {(r.idx, r.pos) for r in best} == {(i, i % 3) for i in range(6)}
    near = in_window(said.withColumn("pointer", F.lit(1)).join(items, "ticket_id"), Settings())
    assert {r.pos for r in near.select("pos").distinct().collect()} == {0, 1, 2, 3}
