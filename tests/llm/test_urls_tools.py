"""URL verdicts and tool-call linking."""

import itertools
import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyvox.llm import queries, tools, urls


def rule_of(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, say) for say, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    made = ["http://WWW.Example.com/en/1", "http://example.com/en/1?x=1", "http://m.example.com/EN/1", "https://a.net/fr/2#t", "https://a.net", "x", "", None, "ftp://É.com/", "http://notexample.com/en/", "://com/a", "a://b://c/d", "http://bad.org/en/x"]
    made += [f"http://spam{i % 3}.example.com/en/{i}" for i in range(60)] + [f"http://good.shop.com/de/{i}" for i in range(60)] + ["http://spam1.test.org/xx/1", "http://good.test.org/yy/2"]
    rows = [(i, u) for i, u in enumerate(made)] + [(0, made[0]), (None, made[1])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' AS host", "'k' AS key", "'t' AS tokens")
    got = urls.judged(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for i, u in rows[:-1]:
        host, path, (rule, say) = rule_of(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), u
        assert by[i].verdict == (say or by[i].verdict) and by[i].verdict in ("allow", "block")
    assert by[len(made) - 2].verdict == "block" and by[len(made) - 1].verdict == "allow"
    assert urls.judged(pages.limit(0)).count() == 0


def test_mined_rules_are_pruned(spark):
    rows = [(["a", "b"], "block")] * 30 + [(["c"], "allow")] * 30
    got = {(tuple(r.antecedent), r.says) for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert got == {(("a",), "block"), (("b",), "block"), (("c",), "allow")}


def brute_rules(rows, support, confidence, lift):
    """All rules of any length by counting, over one token for each set of tokens that always stand together; then pruned."""
    rows = [(frozenset(t), v) for t, v in rows]
    least, where = max(1, math.ceil(support * len(rows) - 1e-9)), defaultdict(set)
    for i, (t, _) in enumerate(rows):
        for x in t:
            where[x].add(i)
    says = sorted({v for _, v in rows})
    mixed = {x for x, at in where.items() if len({rows[i][1] for i in at}) > 1 and max(Counter(rows[i][1] for i in at).values()) >= least}
    leaders = {min(y for y in mixed if where[y] == where[x]) for x in mixed}
    rules = {}
    for size in range(1, len(leaders) + 2):
        for some in itertools.combinations(sorted(where if size == 1 else leaders), size):
            at = set.intersection(*(where[x] for x in some))
            for v in says:
                n = sum(rows[i][1] == v for i in at)
                sure = n / len(at) if at else 0
                if n >= least and sure >= confidence and sure / (sum(w == v for _, w in rows) / len(rows)) >= lift:
                    rules[some, v] = sure
    return {(a, v): c for (a, v), c in rules.items() if not any(set(x) < set(a) and w == v and d >= c for (x, w), d in rules.items())}


@pytest.mark.parametrize("seed, wide", [(1, 10), (2, 10), (3, 4), (4, 4), (5, 2), (6, 1)])
def test_mined_rules_equal_brute_force(spark, seed, wide):
    draw = random.Random(seed)
    rows = []
    for _ in range(120):
        t = [x for x in "abcdefg" if draw.random() < 0.5]
        verdict = "block" if {"a", "b"} <= set(t) or ({"c", "d", "e"} <= set(t) and "f" not in t) else draw.choice(["allow"] * 9 + ["block"])
        rows.append((t + ["a2"] * ("a" in t), verdict))
    got = urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.03, 0.8, 1.2, wide).collect()
    want = brute_rules(rows, 0.03, 0.8, 1.2)
    found = {(tuple(r.antecedent), r.says): r for r in got}
    assert found.keys() == want.keys() and any(len(a) > 1 for a, _ in want)
    assert {k: r.confidence for k, r in found.items()} == pytest.approx(want)
    assert all(["a", "a2"] in r.members for r in got if "a" in r.antecedent and len(r.antecedent) > 1)


@pytest.mark.parametrize("wide", [10, 3])
def test_wide_urls_take_no_rules_from_others(spark, wide):
    draw, rows = random.Random(3), []
    for _ in range(300):
        t = [x for x in "abcd" if draw.random() < 0.6]
        rows.append((t, "block" if {"a", "b", "c"} <= set(t) else draw.choice(["allow"] * 19 + ["block"])))
    rows += [([f"w{draw.randrange(40)}" for _ in range(18)], draw.choice(["allow", "block"])) for _ in range(60)]
    got = {(tuple(r.antecedent), r.says): r.confidence for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9, 1.2, wide).collect()}
    rows = [(sorted(set(t)), v) for t, v in rows]
    want = {(a, v): c for (a, v), c in brute_rules([([x for x in t if x[0] != "w"], v) for t, v in rows], 0.02, 0.9, 1.2).items()}
    assert (("a", "b", "c"), "block") in want
    assert {k: c for k, c in got.items() if not any(x[0] == "w" for x in k[0])} == pytest.approx(want)


def brute_verdict(tokens, rules):
    """The verdict of the surest rule all of whose members the tokens have one of."""
    fits = [(r.confidence, r.support, len(r.antecedent), r.says) for r in rules if all(set(m) & set(tokens) for m in r.members)]
    return max(fits)[3] if fits else "allow"


def test_verdicts_equal_the_surest_rule(spark):
    draw = random.Random(8)
    pages = []
    for i in range(400):
        dirs = [x for x in ("ad", "buy", "win", "doc") if draw.random() < 0.5]
        bad = {"ad", "buy"} <= set(dirs) or (draw.random() < 0.05)
        host = draw.choice(["s.org", "t.org"]) if i % 2 else "x.net" if bad else "y.com"
        pages.append((i, f"http://{host}/{'es/' if host == 'x.net' else ''}{'/'.join(dirs)}/?k{draw.randrange(3)}=1"))
    table = spark.createDataFrame(pages, "page_id bigint, url string")
    rows = table.select("page_id", "url", *(c.alias(n) for c, n in zip(urls.parts(table.url), ("host", "path", "query"))))
    rows = rows.select("page_id", urls.tokens(rows.host, rows.path, rows.query).alias("tokens"), urls.ruled(rows.host, rows.path, urls.RULES)[1].alias("verdict")).collect()
    named = {"h:com", "h:net", "h:example", "h:www", "p:en", "p:es", "p:fr"}
    rows = [(r.page_id, [t for t in r.tokens if t not in named], r.verdict) for r in rows]
    rules = urls.mined(spark.createDataFrame([(t, v) for _, t, v in rows if v], "tokens array<string>, verdict string")).collect()
    got = {r.page_id: r.verdict for r in urls.judged(table).collect()}
    assert got == {i: v or brute_verdict(t, rules) for i, t, v in rows} and {"allow", "block"} <= {got[i] for i, _, v in rows if not v}


def test_urls_with_many_tokens_are_mined_in_bounded_work(spark):
    keys = "&".join(f"k{i}=1" for i in range(25))
    rows = [(i, f"http://{'x.example.com/en' if i % 2 else 'y.com/de'}/{i}?{keys}") for i in range(50)] + [(50 + i, f"http://y.com/fr/{i}") for i in range(50)]
    rows += [(100, f"http://z.org/?{keys}"), (101, "http://x.org/"), (102, "http://z.org/" + "/".join(f"d{i}" for i in range(20_000)))]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(got) == 103 and got[101].verdict == "block" and got[102].verdict == "allow"


CALL = "conv_id bigint, turn bigint, call_id string, tool string, arguments string, after array<string>"
RESULT = "conv_id bigint, turn bigint, call_id string, content string"
PLAIN = (("ask", "chars", "integer", True), ("ask", "text", "string", True))


def test_calls(spark):
    calls = [
        (1, 0, "a", "ask", '{"text":"x\\"é\\u0001","chars":3}', []), (1, 2, "b", "ask", '{"chars":"no","more":1}', ["a"]), (1, 4, "c", "what", "{}", ["b", "gone"]), (1, 6, "d", "ask", None, None),
        (1, 6, "d", "ask", "[1]", None), (2, 0, None, "ask", "{}", []),
    ]
    results = [(1, 1, "a", "yes\n"), (1, 1, "a", "zzz"), (1, 9, "q", None), (None, None, None, "lost")]
    got = tools.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), tools.schema_table(spark, PLAIN)).collect()
    by = {r.call_id: r for r in got if r.call_id}
    assert len(got) == 7 and {k: r.status for k, r in by.items()} == {"a": "linked", "b": "no_result", "c": "no_result", "d": "no_result", "q": "no_call"}
    assert by["a"].valid and by["a"].copies == 3 and json.loads(by["a"].json) == {"arguments": {"chars": 3, "text": 'x"é\x01'}, "id": "a", "name": "ask", "result": "yes\n"}
    assert by["b"].problems == "missing text;mistyped chars;unknown more" and by["c"].problems == "unknown tool" and by["d"].problems == "no object"
    assert [by[k].level for k in "abcd"] == [0, 1, 2, 0]
    assert sorted(r.status for r in got if not r.call_id) == ["no_id", "no_id"]


def levels_of(calls):
    """Longest chains by peeling, over (call_id, after) alone."""
    after = {c: {x for x in a or [] if x in dict(calls)} for c, a in calls}
    level = {}
    while True:
        new = {c: max((level[x] + 1 for x in a), default=0) for c, a in after.items() if c not in level and all(x in level for x in a)}
        if not new:
            return {c: (level.get(c), c not in level) for c in after}
        level |= new


def ordered(spark, calls):
    return {r.call_id: (r.level, r.cyclic) for r in tools.ordered(spark.createDataFrame(calls, "call_id string, after array<string>")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_topological_order(spark, seed):
    draw = random.Random(seed)
    calls = [(f"r{i}", draw.sample([f"r{j}" for j in range(i)], min(i, draw.choice([0, 1, 1, 1, 2, 3])))) for i in range(60)]
    calls += [("x", ["y"]), ("y", ["x"]), ("z", ["y"]), ("w", ["z", "r1"]), ("self", ["self"]), ("p", ["q", "r5"]), ("q", ["p", "r2"]), ("none", None), ("gone", ["nothing", None]), ("twice", ["r3", "r3"]), ("u", ["p"])]
    calls += [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(70)]
    draw.shuffle(calls)
    assert ordered(spark, calls) == levels_of(calls)


def test_a_call_may_come_after_one_of_another_conversation(spark):
    calls = [(1, 1, "a", "t", "{}", ["b"]), (2, 50, "b", "t", "{}", [])]
    got = {r.call_id: r for r in tools.linked(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), tools.schema_table(spark)).collect()}
    assert (got["a"].level, got["a"].cyclic, got["b"].level, got["b"].cyclic) == (1, False, 0, False)


SCHEMA = (("f", "n", "integer", True), ("f", "x", "number", False), ("f", "s", "string", False), ("f", "b", "boolean", False), ("f", "o", "object", False), ("f", "o.k", "integer", True), ("f", "l", "array", False), ("g", "q", "string", False))
ARGUMENTS = [
    ('{"n":5}', "missing o.k", '{"n":5}'),
    ('{"n":"5","o":{"k":1}}', "mistyped n", '{"n":"5","o":{"k":1}}'),
    ('{"o":{"k":2,"a":[1,{"z":1,"y":2.50}]},"n":1.0,"s":7}', "mistyped s", '{"n":1,"o":{"a":[1,{"y":2.5,"z":1}],"k":2},"s":7}'),
    ('{"n":1,"x":1,"b":true,"l":[],"s":"é\\n","o":{"k":1}}', "", '{"b":true,"l":[],"n":1,"o":{"k":1},"s":"é\\n","x":1}'),
    ('{"n":1,"n":2}', "repeated n", None), ('{"n":1,"o":{"k":1,"k":2}}', "repeated key inside", None), ("[1]", "no object", None), ("x", "no object", None), (None, "no object", None), ("", "no object", None),
    ('{"n":null,"o":{"k":1}}', "missing n", '{"n":null,"o":{"k":1}}'), ('{"n":1.5,"b":"true","l":{},"o":[1]}', "missing o.k;mistyped b;mistyped l;mistyped n;mistyped o", '{"b":"true","l":{},"n":1.5,"o":[1]}'),
    ('{"n":1,"o":{"k":1},"z.y":0}', "unknown z.y", '{"n":1,"o":{"k":1},"z.y":0}'), ('{"n":1,"o":{"k":1},"s":"' + "x" * 300_000 + '"}', "", '{"n":1,"o":{"k":1},"s":"' + "x" * 300_000 + '"}'),
]


def test_types_nested_values_and_repeated_keys(spark):
    calls = [(1, i, f"c{i}", "f", a, None) for i, (a, _, _) in enumerate(ARGUMENTS)] + [(1, 99, "g", "g", "{}", None)]
    df = spark.createDataFrame(calls, CALL).selectExpr("*", "1 AS level", "'p' AS params", "2 AS n")
    got = {r.call_id: r for r in tools.linked(df, spark.createDataFrame([], RESULT).selectExpr("*", "'z' AS json"), tools.schema_table(spark, SCHEMA)).collect()}
    for i, (_, wrong, text) in enumerate(ARGUMENTS):
        r = got[f"c{i}"]
        assert (r.problems, r.valid) == (wrong, wrong == ""), ARGUMENTS[i]
        assert r.json == f'{{"arguments":{text or "null"},"id":"c{i}","name":"f","result":null}}'
    assert got["g"].valid and len(got) == len(calls)


def test_no_calls(spark):
    calls, results = spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT)
    assert tools.linked(calls, results, tools.schema_table(spark)).count() == 0
    assert [r.status for r in tools.linked(calls, spark.createDataFrame([(1, 1, "a", "x")], RESULT), tools.schema_table(spark)).collect()] == ["no_call"]


def test_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 2, "user", None), (2, 1, "assistant", None), (None, 0, "user", "n"), (3, None, "assistant", "m"), (4, 0, "system", "s"), (5, 0, None, "r")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS call_id", "'y' AS json").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.result_turn): r for r in queries.op1_tool_links(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 0, 1): "linked", (1, 2, None): "no_result", (2, None, 1): "no_call", (None, 0, None): "no_id", (3, None, None): "no_id"}
    assert got[1, 0, 1].copies == 3 and not got[1, 2, None].valid
