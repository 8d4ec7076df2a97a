"""Alignment of two tokenizers against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyvox.llm import bpe, crosstok, queries


@pytest.fixture(scope="module")
def libraries():
    a_path, b_path = crosstok.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def tokens(libraries, text):
    """(id, start, end) of both sides' tokens by the libraries alone."""
    a, b = libraries
    if not text:
        return [], []
    letters = bpe.byte_letters()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], []
    out = []
    for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
        at, side = 0, []
        for i, part in zip(ids, parts):
            side.append((i, at, at + len(part)))
            at += len(part)
        out.append(side)
    return out


def groups(a, b):
    out, i, j = [], 0, 0
    for end in sorted({t[2] for t in a} & {t[2] for t in b}):
        k, m = i, j
        while k < len(a) and a[k][2] <= end:
            k += 1
        while m < len(b) and b[m][2] <= end:
            m += 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def links(a, b, kind):
    if kind == "groups":
        return [(x, y) for xs, ys in groups(a, b) for x in xs for y in ys]
    if kind == "ends":
        return [(x, y) for x in a for y in b if x[2] == y[2]]
    return [(x, y) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]


def brute(libraries, docs):
    found = [(doc, *tokens(libraries, text)) for doc, text in docs]
    counts = Counter((x[0], y[0]) for _, a, b in found for x, y in links(a, b, "ends"))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for doc, a, b in found:
        own = [counts[x[0], y[0]] == best[y[0]] for x, y in links(a, b, "ends")]
        text = ";".join(",".join(str(x[0]) for x in xs) + "|" + ",".join(str(y[0]) for y in ys) for xs, ys in groups(a, b))
        total = sum(counts[x[0], y[0]] for x, y in links(a, b, "ends"))
        rows.append((doc, len(a), len(b), len(groups(a, b)), len(own), sum(own), total, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(rows, key=str)


SIGNS = list("  \n\tabcdehtxzqABC019.,!?-<|>éàßç\xa0 日本語😀Аб　\x00﻿") + ["<|endoftext|>", "  ", "'s", " the", "<0x41>", "</s>", "▁", "ing", "    "]


def made(n=150, seed=4):
    draw = random.Random(seed)
    docs = [(i, "".join(draw.choice(SIGNS[:-4] if i % 3 else SIGNS) for _ in range(draw.randint(0, 60)))) for i in range(n)]
    return docs + [(n, docs[5][1]), (5, docs[5][1]), (n + 1, None), (n + 2, ""), (None, "no id"), (n + 3, " "), (n + 4, "x▁y"), (n + 5, "a" * 300), (n + 6, "<s> <|endoftext|>")]


def test_encoding_by_words_equals_the_library(libraries):
    pair = crosstok.Pair(*crosstok.read_specs(None))
    for _, text in made(1500, 9):
        a, b = tokens(libraries, text)
        got = pair.encoded(text)
        assert [i for x, _ in got for i in np.frombuffer(x, "<u4").tolist()] == [t[0] for t in a], repr(text)
        assert [i for _, x in got for i in np.frombuffer(x, "<u4").tolist()] == [t[0] for t in b], repr(text)


def test_possible_pairs_hold_every_link(libraries):
    pair = crosstok.Pair(*crosstok.read_specs(None))
    known = set(pair.pairs.tolist())
    for _, text in made(300, 2):
        assert all(x[0] << 32 | y[0] in known for x, y in links(*tokens(libraries, text), "ends"))
    assert len(known) <= 2 * sum(map(len, pair.a_bytes + pair.b_bytes))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS links", "1 AS n_a", "'y' AS pair")


@pytest.mark.parametrize("segment,batch,parts", [(1 << 18, 1 << 19, 200_000), (20, 200, 3)])
def test_query(spark, tmp_path, libraries, monkeypatch, segment, batch, parts):
    for name, value in (("SEGMENT", segment), ("BATCH_CHARS", batch), ("TEXT_GROUPS", parts)):
        monkeypatch.setattr(crosstok, name, value)
    docs = made() + [(900, "of the people and " * 200)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(libraries, docs)


@pytest.mark.parametrize("kind", crosstok.KINDS)
def test_kinds_and_spans(spark, libraries, monkeypatch, kind):
    monkeypatch.setattr(crosstok, "SEGMENT", 30)
    docs = [d for d in made(60, 8) if d[0] is not None] + [(901, "several plain words in a row " * 9)]
    docs = list(dict(docs).items())
    want = {doc: links(*tokens(libraries, text), kind) for doc, text in docs}
    got = {r.doc_id: np.frombuffer(r.links, "<i8").tolist() for r in crosstok.aligned(frame(spark, docs), kind).collect()}
    assert got == {doc: [x[0] << 32 | y[0] for x, y in found] for doc, found in want.items()}
    placed = {}
    for r in crosstok.spans(frame(spark, docs), kind).collect():
        placed.setdefault(r.doc_id, []).append(((r.a_no, r.a_id, r.a_start, r.a_end), (r.b_no, r.b_id, r.b_start, r.b_end)))
    for doc, text in docs:
        a, b = tokens(libraries, text)
        assert placed.get(doc, []) == [((a.index(x), *x), (b.index(y), *y)) for x, y in want[doc]]


def test_long_texts(spark, libraries):
    docs = [(1, "some words of a long text, " * 40_000), (2, "z" * 300_000), (3, "a" + " " * 1_100_000 + "b"), (4, "日本語" * 50_000)]
    rows = {r.doc_id: r for r in crosstok.linked(frame(spark, docs)).collect()}
    for doc, text in docs:
        a, b = tokens(libraries, text)
        shared = {t[2] for t in a} & {t[2] for t in b}
        assert (rows[doc].n_a, rows[doc].n_b, rows[doc].n_groups, rows[doc].n_links) == (len(a), len(b), len(shared), len(shared))


def test_empty_table(spark):
    assert crosstok.linked(frame(spark, [])).count() == 0
    assert crosstok.linked(frame(spark, [(1, None)])).first().n_links == 0
