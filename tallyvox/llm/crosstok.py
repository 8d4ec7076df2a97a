"""Alignment of two tokenizers over the bytes that both encode.

Both tokenizers read a text after one space; the bytes of their tokens are the same, cut at different places. The union of
both arrays of ends cuts the bytes into elementary intervals; a binary search finds the token of either side that owns an interval,
so each interval is the overlap of one pair of tokens. An interval whose end is an end on both sides closes a group: the
least runs of tokens that stand for the same bytes. A group's pairs are the product of its tokens.

`aligned` gives each document's links, of one kind:

    overlaps   pairs that share a byte: one for each elementary interval
    ends       pairs whose byte ranges end together: one for each group
    groups     all pairs of a group's tokens

Texts are read in segments of about SEGMENT characters, cut before a space where a token of either side certainly ends, and many
segments go through the arrays at once; so memory is bounded by a segment and the result of one document, whatever the text's length (a text without such a place is one segment).

`linked` counts how many links hold each pair of ids, over all documents. For links of ends the shorter token's bytes end the longer one's, so
the possible pairs follow from the vocabularies alone, at most two for each byte of a token: a fixed list of some hundred thousand codes, in which each link is a number. So links are written as these
numbers, each task adds up its own in one array, a pair is one row a task, and the totals go to all tasks as one array of proven size.

A text that is null or empty, or whose tokens' bytes on either side aren't the space and the text, has no tokens: counts 0 and no links. A null
doc_id stays null. Repeated rows are aligned and counted each. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm import bpe
from tallyvox.llm.tables import kept, written

SEGMENT, BATCH_CHARS, TEXT_GROUPS = 1 << 18, 1 << 19, 200_000
KINDS = ("overlaps", "ends", "groups")
KNOWN_FRAGMENTS, LONGEST_KNOWN = 250_000, 64
WORD_START = "▁"


# --- intervals ----------------------------------------------------------------


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the tokens of both sides that own it and whether its end is shared. Both arrays rise strictly to the same end."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return a, b, a_ends[a] == b_ends[b]


def grouped(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first token and the number of tokens of each group, for both sides."""
    last = np.flatnonzero(shared)
    a_last, b_last = a[last] + 1, b[last] + 1
    a_first, b_first = (np.concatenate([[0], x])[:-1] for x in (a_last, b_last))
    return a_first, a_last - a_first, b_first, b_last - b_first


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)


def product_pairs(a_first: np.ndarray, a_n: np.ndarray, b_first: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each group, in order of the first side's tokens."""
    a = ragged(a_first, a_n)
    group = np.repeat(np.arange(len(a_n)), a_n)
    return np.repeat(a, b_n[group]), ragged(b_first[group], b_n[group])


# --- tokenizers ---------------------------------------------------------------


class Pair:
    """Both tokenizers. Special tokens' strings are plain text."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece

        self.a = bpe.Codec(a_spec, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = self.a.table
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(t) for t in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes)]
        # A token of either side certainly ends between these letters and digits and a space; where a piece holds a word start
        # after another sign, or the text is changed before it is cut, texts are encoded whole.
        free = "".join(c for c in map(chr, range(128)) if c.isalnum() and not any(f"{c} ".encode() in t for t in self.a_bytes))
        self.local = not any(WORD_START in p.lstrip(WORD_START) for p in pieces)
        self.cut = re.compile(f"(?<=[{free}]) (?=[{free}])") if free and self.local else None
        self.known: dict[str, tuple[bytes, bool]] = {}

    def segments(self, text: str) -> Iterator[str]:
        """The space and the text, in parts that either side encodes alone as within the whole."""
        at, text = 0, " " + text
        while at < len(text):
            found = self.cut.search(text, at + SEGMENT) if self.cut and len(text) > at + SEGMENT else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def encoded(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """Both sides' ids (little-endian unsigned 32-bit) of each segment; nothing if the tokens' bytes aren't the space and the text."""
        out = []
        for segment in self.segments(text) if text else ():
            a, (b, same) = self.a.encode(segment), self.b_ids(segment)
            if not same or b"".join(map(self.a_bytes.__getitem__, np.frombuffer(a, "<u4").tolist())) != segment.encode():
                return []
            out.append((a, b))
        return out

    def b_ids(self, segment: str) -> tuple[bytes, bool]:
        """The second side's ids of a segment, which begins with the space that the library adds, and whether their bytes are the segment."""
        if not self.local:
            return self._b_ids(segment)
        # No piece holds a word start after another sign, so each word with the spaces before it is encoded by itself.
        known, parts, same = self.known, [], True
        if len(known) > KNOWN_FRAGMENTS:
            known.clear()
        for word in re.findall(" +[^ ]*", segment):
            found = known.get(word)
            if found is None:
                found = self._b_ids(word)
                if len(word) <= LONGEST_KNOWN:
                    known[word] = found
            parts.append(found[0])
            same = same and found[1]
        return b"".join(parts), same

    def _b_ids(self, segment: str) -> tuple[bytes, bool]:
        ids = self.b.encode(segment[1:]) if len(segment) > 1 else [self.b.piece_to_id(WORD_START)]  # the library adds no space to nothing
        return np.array(ids, dtype="<u4").tobytes(), b"".join(map(self.b_bytes.__getitem__, ids)) == segment.encode()

    @cached_property
    def pairs(self) -> np.ndarray:
        """The codes of all pairs of ids whose tokens can end together, sorted: the shorter one's bytes end the longer one's."""
        found = set()
        for one, other, code in ((self.a_bytes, self.b_bytes, lambda x, y: x << 32 | y), (self.b_bytes, self.a_bytes, lambda x, y: y << 32 | x)):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(other):
                ids.setdefault(t, []).append(i)
            found.update(code(i, j) for i, t in enumerate(one) for at in range(len(t)) for j in ids.get(t[at:], ()))
        return np.array(sorted(found), dtype=np.int64)


def pair_of(specs: tuple[str, bytes]) -> Pair:
    """The tokenizers of this Python process; a reused worker keeps them."""
    return kept("crosstok", specs, lambda: Pair(*specs))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def read_specs(paths: Sequence[str] | None) -> tuple[str, bytes]:
    a, b = paths or default_paths()
    with open(b, "rb") as f:
        return bpe.read_spec(a), f.read()


# --- documents ----------------------------------------------------------------


class Decimals:
    """Ids as decimal text, many at once."""

    def __init__(self, size: int):
        texts = [str(i).encode() for i in range(size)]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.signs = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def written(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of the ids, each with the sign after it, and where each one's text ends."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths + 1)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
        out[ragged(ends - lengths - 1, lengths)] = self.signs[ragged(self.firsts[ids], lengths)]
        out[ends - 1] = after
        return out, ends


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], decimals: Decimals) -> tuple[np.ndarray, np.ndarray]:
    """All groups as a1,a2|b1;a3|b2; and where each group's text ends."""
    a_first, a_n, b_first, b_n = groups
    total = a_n + b_n
    ends = np.cumsum(total)
    ids, after = np.empty(total.sum(), dtype=np.int64), np.full(total.sum(), ord(","), dtype=np.uint8)
    ids[ragged(ends - total, a_n)], ids[ragged(ends - b_n, b_n)] = a_ids[ragged(a_first, a_n)], b_ids[ragged(b_first, b_n)]
    after[ends - b_n - 1], after[ends - 1] = ord("|"), ord(";")
    text, token_ends = decimals.written(ids, after)
    return text, token_ends[ends - 1]


class Joint:
    """Segments of several documents in a row, aligned at once: all end on both sides, so no interval or group crosses them."""

    def __init__(self, pair: Pair, segments: list[tuple[bytes, bytes]]):
        self.a, self.b = (np.frombuffer(b"".join(s[side] for s in segments), dtype="<u4").astype(np.int64) for side in (0, 1))
        self.a_ends, self.b_ends = np.cumsum(pair.lengths[0][self.a]), np.cumsum(pair.lengths[1][self.b])
        self.a_at, self.b_at = (np.cumsum([0] + [len(s[side]) // 4 for s in segments]) for side in (0, 1))
        self.owners = overlaps(self.a_ends, self.b_ends)
        self.groups = grouped(*self.owners)
        self.group_at = np.searchsorted(self.groups[0], self.a_at)

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The tokens linked, by their number, in order of the first side's."""
        a, b, shared = self.owners
        return (a, b) if kind == "overlaps" else (a[shared], b[shared]) if kind == "ends" else product_pairs(*self.groups)

    def texts(self, decimals: Decimals) -> Iterator[tuple[int, bytes]]:
        """The text of the groups of each segment, in parts of whole groups."""
        i = 0
        for first in range(0, len(self.groups[0]), TEXT_GROUPS):
            last = min(first + TEXT_GROUPS, len(self.groups[0]))
            text, ends = group_text(self.a, self.b, tuple(x[first:last] for x in self.groups), decimals)
            at = np.concatenate([[0], ends])
            while i + 1 < len(self.group_at) and self.group_at[i] < last:
                begin, end = max(self.group_at[i], first), min(self.group_at[i + 1], last)
                if begin < end:
                    yield i, text[at[begin - first] : at[end - first]].tobytes()
                if self.group_at[i + 1] > last:
                    break
                i += 1


def joint_batches(batches: Iterator, pair: Pair) -> Iterator[tuple[list[tuple[int, int | None, bool]], Joint]]:
    """Segments of some BATCH_CHARS together: for each its document's number in the task, the doc_id and whether it is the document's last; and their alignment."""
    marks: list[tuple[int, int | None, bool]] = []
    segments: list[tuple[bytes, bytes]] = []
    number = size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts = pair.encoded(text.as_py()) or [(b"", b"")]
            number += 1
            for i, part in enumerate(parts):
                marks.append((number, doc, i + 1 == len(parts)))
                segments.append(part)
                size += len(part[0])
                if size > BATCH_CHARS:  # of ids, four bytes each: about as many as characters
                    yield marks, Joint(pair, segments)
                    marks, segments, size = [], [], 0
    if marks:
        yield marks, Joint(pair, segments)


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


def aligned(docs: DataFrame, kind: str = "ends", paths: Sequence[str] | None = None, numbered: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of every document; one narrow pass.

    groups_sha256 is that of `a1,a2|b1;a3|b2,b3`: both sides' ids of each group; empty without tokens. links: pairs of ids as little-endian 64-bit integers, the first
    side's in the high half; numbered (links of ends only): the pairs' numbers among the possible ones, as 32-bit integers. The vocabulary files are read on the driver and broadcast.
    """
    if kind not in KINDS or (numbered and kind != "ends"):
        raise ValueError(f"no such links: {kind}")
    specs = docs.sparkSession.sparkContext.broadcast(read_specs(paths))

    def align(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        pair = pair_of(specs.value)
        decimals = Decimals(max(len(pair.a_bytes), len(pair.b_bytes)))
        counts, digest, links = np.zeros(4, dtype=np.int64), hashlib.sha256(), []
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for marks, joint in joint_batches(batches, pair):
            a, b = joint.links(kind)
            codes = joint.a[a] << 32 | joint.b[b]
            codes = np.searchsorted(pair.pairs, codes).astype("<i4") if numbered else codes.astype("<i8")
            at = np.searchsorted(a, joint.a_at)
            texts: dict[int, list[bytes]] = {}
            for i, text in joint.texts(decimals):
                texts.setdefault(i, []).append(text)
            rows = []
            for i, (_, doc, last) in enumerate(marks):
                for text in texts.pop(i, ()):
                    digest.update(b";" + text[:-1] if counts[0] else text[:-1])
                    counts[0] = 1  # from here on a separator comes first
                counts[1:] += [joint.a_at[i + 1] - joint.a_at[i], joint.b_at[i + 1] - joint.b_at[i], joint.group_at[i + 1] - joint.group_at[i]]
                links.append(codes[at[i] : at[i + 1]].tobytes())
                if last:
                    whole = b"".join(links)
                    rows.append((doc, *counts[1:].tolist(), len(whole) // codes.itemsize, digest.hexdigest() if counts[0] else "", whole))
                    counts, digest, links = np.zeros(4, dtype=np.int64), hashlib.sha256(), []
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(align, ALIGNED)


SPANS = "doc_id bigint, a_no bigint, b_no bigint, a_id bigint, b_id bigint, a_start bigint, a_end bigint, b_start bigint, b_end bigint"


def spans(docs: DataFrame, kind: str = "overlaps", paths: Sequence[str] | None = None) -> DataFrame:
    """One row for each link: the tokens' numbers in the document, ids and byte ranges (of the space and the text)."""
    if kind not in KINDS:
        raise ValueError(f"no such links: {kind}")
    specs = docs.sparkSession.sparkContext.broadcast(read_specs(paths))

    def span(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = pair_of(specs.value)
        current, before = 0, np.zeros(3, dtype=np.int64)  # the document's tokens of both sides and bytes in earlier segments
        for marks, joint in joint_batches(batches, pair):
            a, b = joint.links(kind)
            at = np.searchsorted(a, joint.a_at)
            starts = [np.concatenate([[0], x]) for x in (joint.a_ends, joint.b_ends)]
            for i, (number, doc, _) in enumerate(marks):
                if number != current:
                    current, before = number, np.zeros(3, dtype=np.int64)
                x, y = a[at[i] : at[i + 1]], b[at[i] : at[i + 1]]
                own = starts[0][joint.a_at[i]]
                columns = [x - joint.a_at[i] + before[0], y - joint.b_at[i] + before[1], joint.a[x], joint.b[y]]
                columns += [c - own + before[2] for c in (starts[0][x], starts[0][x + 1], starts[1][y], starts[1][y + 1])]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(x), pa.int64()), *map(pa.array, columns)], names=[c.split()[0] for c in SPANS.split(", ")])
                before += [joint.a_at[i + 1] - joint.a_at[i], joint.b_at[i + 1] - joint.b_at[i], starts[0][joint.a_at[i + 1]] - own]

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(span, SPANS)


def linked(docs: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """Every document's doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, by links of ends.

    A pair of ids counts as often as any document's links hold it. n_best: how many links have the highest count of their second side's id, ties included;
    count_sum: the sum of the links' counts. Texts are encoded once; their links stand in a written table between the passes.
    """
    spark = docs.sparkSession
    rows = written(spark, aligned(docs, "ends", paths, numbered=True), "links")
    pairs = Pair(*read_specs(paths)).pairs  # bounded by the vocabularies, as all that follows from it

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len_pairs, dtype=np.int64)
        for batch in batches:
            for links in batch.column(0):
                found, n = np.unique(np.frombuffer(links.as_buffer(), dtype="<i4"), return_counts=True)
                total[found] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    len_pairs = len(pairs)
    counted = rows.filter("n_links > 0").select("links").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len_pairs, dtype=np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    best = np.zeros(int((pairs & 0xFFFFFFFF).max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(best, pairs & 0xFFFFFFFF, counts)
    sent = spark.sparkContext.broadcast((counts, counts == best[pairs & 0xFFFFFFFF]))

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, is_best = sent.value
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            for i, links in enumerate(batch.column(batch.num_columns - 1)):
                own = np.frombuffer(links.as_buffer(), dtype="<i4")
                sums[:, i] = is_best[own].sum(), n[own].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1])], names=[*names, "n_best", "count_sum"])

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = rows.select(*names, "links").mapInArrow(weigh, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
