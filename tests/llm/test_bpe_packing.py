"""Encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyvox.llm import bpe, packing, queries

ROWS = [(1, ""), (2, None), (3, "a"), (4, "Hello  world\n\n it's 's 12345 <|endoftext|> x"), (4, "Hello again"), (5, "à la\u3000mode\u2029 é x\tq"), (6, "tq zx " * 3000), (7, "z" * 5000), (None, "no id")]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_spec(bpe.default_path()))


def exact(codec, text):
    return codec.library.encode(text or "", add_special_tokens=False).ids


def test_cuts_never_stand_inside_a_token(codec):
    pairs = bpe.inner_pairs(codec.table)
    text = "one two,three\nfour à five\u00a0six  seven"
    parts = codec.fragment.findall(text)
    assert "".join(parts) == text
    for a, b in zip(parts, parts[1:]):
        assert (a.encode()[-1], b.encode()[0]) not in pairs


def test_ids_equal_the_librarys(codec):
    draw = random.Random(3)
    signs = list(" \n\t\r\x0b\x0c abcdefgh'stremvdlqzxj019.,!?-<|>éàß\xa0\u2009\u2029\u0085\x1c日本😀А") + ["<|endoftext|>", "  ", "'s", "'ll", " 's"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 40)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == exact(codec, text), text
        assert codec.decode(ids) == codec.library.decode(exact(codec, text), skip_special_tokens=False)


LONG = 1_200_000
RUNS = ["a" + " " * LONG + "x", "\n" * LONG, "\t" * LONG + "x", "1" * LONG, "z" * LONG, "tq" * (LONG // 2), "\xa0" * LONG + "a", "!" * LONG, " \n\t" * (LONG // 3) + "x", "é" * LONG]


@pytest.mark.parametrize("text", RUNS, ids=["spaces", "newlines", "tabs", "digits", "letter", "cuts", "no-break", "signs", "mixed", "accents"])
def test_very_long_runs(codec, text):
    ids = codec.encode(text)
    assert ids == np.array(exact(codec, text), dtype="<u4").tobytes()
    assert codec.decode(ids) == text


def documents(spark, tmp_path, rows=ROWS):
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'x' AS ids", "'y' AS decoded").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_of_encoding(spark, tmp_path, codec):
    got = sorted(map(tuple, queries.op5_bpe(spark, documents(spark, tmp_path)).collect()), key=str)
    want = []
    for doc, text in ROWS:
        ids = exact(codec, text)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_lengths_are_powers_of_two(n):
    found = packing.lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 1024 for x in found) and found == sorted(found, reverse=True)


def test_query_of_packing(spark, tmp_path, codec):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 4] + [ROWS[3]]
    got = queries.op10_packing(spark, documents(spark, tmp_path, rows)).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    for doc, text in rows:
        ids = [*exact(codec, text), 0]
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(r.length for r in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_queries_with_very_long_runs(spark, tmp_path, codec):
    rows = [(i, text) for i, text in enumerate(RUNS[:4])] + [(9, "short")]
    sf = documents(spark, tmp_path, rows)
    n = {r.doc_id: r.n_tokens for r in queries.op5_bpe(spark, sf).collect()}
    assert n == {doc: len(exact(codec, text)) for doc, text in rows}
    packed = queries.op10_packing(spark, sf).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, packed)) == {doc: n + 1 for doc, n in n.items()}


def test_empty_table(spark, tmp_path):
    sf = documents(spark, tmp_path, [])
    assert queries.op5_bpe(spark, sf).count() == 0 and queries.op10_packing(spark, sf).count() == 0
