"""Byte-level BPE encoding and decoding over certain cuts.

A pair of neighbouring bytes that stands inside no token of the vocabulary can
never be merged, so a token boundary is certain between them. Two kinds of such
pairs are used, both safe for the pattern that splits text before merging:

* a byte before ASCII white space: the pattern never joins the two either, and
  what follows is matched from the white space on as if it began the text;
* two ASCII letters: both stand in one run of letters in any case.

A text is cut at the first kind, and a fragment that isn't known yet also at the
second kind. The fragments are encoded independently, remembered while a bounded
memory lasts, and their ids concatenated. Cuts depend on the vocabulary alone, so
the ids are those of the whole text.

A fast encoder takes fragments up to LONGEST_FAST characters. Its pattern engine runs out of stack on
a run of a million spaces and its merging is quadratic in a word, so a longer
fragment without certain cuts (a run of white space, digits or one letter) goes through the library, at
some 250 bytes of memory a character.

A null text counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

from tallyvox.llm.tables import kept

WS = " \t\n\x0b\x0c\r"
#: The pattern of byte-level BPE vocabularies of this kind (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments of these characters only are split alike by every Unicode version of the pattern's classes.
PLAIN = re.compile("[\x00-\x7fÀ-ɏ]*")
UNEVEN = ["  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
#: What a process remembers is bounded in fragments and in the characters of one.
KNOWN_FRAGMENTS, LONGEST_KNOWN = 80_000, 64
LONGEST_FAST = 1000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files of this format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(spec: str) -> dict[bytes, int]:
    letters = byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in json.loads(spec)["model"]["vocab"].items()}


def inner_pairs(tokens: Iterable[bytes]) -> set[tuple[int, int]]:
    """The pairs of neighbouring bytes inside any token."""
    return {pair for token in tokens for pair in zip(token, token[1:])}


def cut_patterns(pairs: set[tuple[int, int]]) -> tuple[re.Pattern, re.Pattern | None]:
    """A pattern of the fragments between certain cuts before white space, and one of cuts between letters."""
    glued = sorted({b for b, w in pairs if chr(w) in WS and chr(b) not in WS})
    # Characters after which no cut is made: their last UTF-8 byte is a glued one, or other Unicode white space.
    after = {chr(b) for b in glued if b < 0x80} | {c for c in map(chr, range(0x80, 0xD800)) if c.encode()[-1] in glued or c.isspace()}
    after |= {c for c in map(chr, range(0xE000, 0x10000)) if c.encode()[-1] in glued} | {c for c in map(chr, range(0x1C, 0x20))} | {"\x85", "᠎"}
    held = "".join(re.escape(c) for c in sorted(after)) + "\U00010000-\U0010ffff"
    fragment = re.compile(f"[{WS}]*[^{WS}]+(?:(?<=[{held}])[{WS}]+[^{WS}]+)*|[{WS}]+")
    letters = [c for c in range(128) if chr(c).isalpha()]
    apart = [(chr(a), "".join(chr(b) for b in letters if (a, b) not in pairs)) for a in letters]
    inner = "|".join(f"(?<={a})(?=[{bs}])" for a, bs in apart if bs)
    return fragment, re.compile(inner) if inner else None


class Codec:
    """Encodes and decodes with one vocabulary; spec is the text of its tokenizers file. plain: special tokens' strings in a text are ordinary text."""

    def __init__(self, spec: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        vocab = vocabulary(spec)
        layout = json.loads(spec)
        self.special = {x["content"]: x["id"] for x in layout["added_tokens"]}
        letters = byte_letters()
        merged = [m if isinstance(m, list) else m.split(" ") for m in layout["model"]["merges"]]
        ids = [layout["model"]["vocab"]["".join(m)] for m in merged]
        self.ranked = ids == sorted(ids) and len(letters) == 256  # then ids are merge ranks
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}) if self.ranked else None
        pieces = dict(zip(vocab.values(), vocab.keys())) | {i: s.encode() for s, i in self.special.items()}
        self.table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.fragment, self.inner = cut_patterns(inner_pairs(vocab))
        self.marked = re.compile("|".join(map(re.escape, self.special))) if self.special and not plain else None
        self.known: dict[str, bytes] = {}
        self.known_whole: dict[str, bytes] = {}
        self.held = [c for c in map(chr, range(0xC0, 0x250)) if self.fragment.fullmatch(f"{c} x")]

    def even(self, text: str) -> bool:
        """Whether every space and line end of text is single and follows a certain cut."""
        if not text.isascii() and (not PLAIN.fullmatch(text) or any(c in text for c in self.held)):
            return False
        return text[0] not in WS and text[-1] not in WS and not any(x in text for x in UNEVEN)

    def ids_of(self, fragment: str, plain: bool = False) -> bytes:
        """The ids of one fragment, as little-endian unsigned 32-bit integers."""
        if not self.ranked or not (plain or PLAIN.fullmatch(fragment)) or (self.marked and self.marked.search(fragment)):
            ids = self.library.encode(fragment, add_special_tokens=False).ids
        elif self.inner and len(fragment) > 24:
            ids = [i for part in self.inner.split(fragment) for i in self.word_ids(part)]
        else:
            ids = self.word_ids(fragment)
        return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)

    def word_ids(self, part: str) -> list[int]:
        return self.fast.encode_ordinary(part) if len(part) <= LONGEST_FAST else self.library.encode(part, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        plain = self.even(text)
        known = self.known if plain else self.known_whole
        if len(known) > KNOWN_FRAGMENTS:
            known.clear()
        if not plain:
            parts = self.fragment.findall(text)
        else:
            # Cut before each space and line end; a fragment's own space is left out of its key,
            # and the first one, which has none, is marked by a space after it.
            parts = text.replace("\n", " \n").split(" ")
            parts[0] += " "
        out = list(map(known.get, parts))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    part = parts[i]
                    ids = known.get(part)
                    if ids is None:
                        whole = part if not plain or part[0] == "\n" else part[:-1] if part[-1] == " " else " " + part
                        ids = self.ids_of(whole, plain)
                        if len(part) <= LONGEST_KNOWN:
                            known[part] = ids
                    out[i] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become replacement characters."""
        import numpy as np

        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec_of(spec: str) -> Codec:
    """The codec of this Python process; a reused worker keeps it, with the fragments it knows."""
    return kept("codec", spec, lambda: Codec(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False):
    """docs' ids and texts as id_col, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded.

    One narrow pass, no shuffle. The vocabulary file is read on the driver and
    broadcast; its size is that of the file, whatever the data. Other columns of docs don't matter.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))
    schema = f"{id_col} bigint, ids binary" + (", decoded string" if decode else "")

    def encode_all(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = codec_of(spec.value)
        kinds = [pa.int64(), pa.binary()] + [pa.string()] * decode
        names = [id_col, "ids"] + ["decoded"] * decode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(encode_all, schema)
