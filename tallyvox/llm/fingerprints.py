"""Document fingerprints by a canonical exact digest.

A text's canonical content is its text after Unicode normalisation (NFKC), case folding, normalisation again and folding of white space
(runs of white space become one space, none is left at the ends), in UTF-8. Its digest is the 128-bit xxHash of that. Texts whose digests are equal stand in one
bucket, and inside a bucket the contents' bytes are compared: if all are the same, the digest in hexadecimal is the fingerprint; if not, each
different content has its place in byte order after it. So fingerprints are equal exactly if contents are, and the likeness of two fingerprints is 1 or 0.

`neighbours` fingerprints each document, a copy of it that was edited (its last half of code points, rounded down, replaced by as many first ones, or all, of the
next document), and the next document. The next one is that with the next higher doc_id, after the last the first. Rows of one doc_id
follow each other in order of the xxHash of their texts, a null doc_id comes last, a null text is empty. A single row follows itself. Repeated rows are rows of their own, other
columns don't matter, an empty table gives no rows.

For the order, texts are compressed and dealt once into ranges of doc_ids; each task streams its range, holding two texts at a time, and the
ends of the ranges are joined afterwards. Written down are digests only; buckets with several members are found from these, and only their members' contents are
compared: each task first drops equal ones within a batch, so a hot bucket costs a row for each batch. Edited texts of such buckets are made anew from
the documents that they consist of.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.tables import free_name, matched, written

BITS, LEVEL = 128, 1
LONGEST_MARKS = 30  # after so many marks in a row a joiner is put in, as in stream-safe text, so that sorting them stays linear


# --- contents -----------------------------------------------------------------


def canonical(text: str | None) -> bytes:
    """The bytes that stand for a text and all texts like it."""
    text = text or ""
    if not text.isascii():
        import regex

        text = regex.sub(rf"\p{{M}}{{{LONGEST_MARKS}}}(?=\p{{M}})", lambda m: m[0] + "͏", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "replace")


def digest(content: bytes, bits: int = BITS) -> bytes:
    """The last `bits` bits (a multiple of 8) of the content's xxHash."""
    import xxhash

    return xxhash.xxh3_128_digest(content)[16 - bits // 8 :]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- rows of a task -----------------------------------------------------------

TEXT = "doc_id bigint, tie bigint, body binary"
OWN = "doc_id bigint, n_chars bigint, sha string, digest binary"
PAIRED = f"{OWN}, edited_sha string, edited_digest binary, next_id bigint, next_sha string, next_digest binary, edited_body binary"
OPEN = f"{PAIRED}, part int, kind string, doc_body binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_of(rows: list[dict], schema: str):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (c.split() for c in schema.split(", "))], names=names(schema))


class Doc:
    """A document of the stream, and what is known of it."""

    def __init__(self, doc_id: int | None, body: bytes, bits: int):
        import zstandard

        self.doc_id, self.body, self.bits = doc_id, body, bits
        self.text = zstandard.ZstdDecompressor().decompress(body).decode()
        self.sha, self.digest = hashlib.sha256(self.text.encode()).hexdigest(), digest(canonical(self.text), bits)

    def before(self, following: Doc, bodies: bool) -> dict:
        text = edited(self.text, following.text)
        content = canonical(text)
        row = {"doc_id": self.doc_id, "n_chars": len(self.text), "sha": self.sha, "digest": self.digest, "edited_sha": hashlib.sha256(text.encode()).hexdigest(), "edited_digest": digest(content, self.bits)}
        row |= {"next_id": following.doc_id, "next_sha": following.sha, "next_digest": following.digest}
        return row | ({"edited_body": packed(content)} if bodies else {})


def packed(content: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(content)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, tie and the compressed text of each row."""

    def pack(batches: Iterator) -> Iterator:
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                rows.append({"doc_id": doc_id, "tie": xxhash.xxh3_64_intdigest(data) - (1 << 63), "body": packed(data)})
            yield batch_of(rows, TEXT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(pack, TEXT)


def paired(docs: DataFrame, bits: int = BITS, bodies: bool = False) -> DataFrame:
    """Each document with the next one, as a written table. bodies: with the edited text's content, compressed."""
    spark = docs.sparkSession

    def stream(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = Doc(doc_id, body.as_py(), bits)
                rows.append(held.before(doc, bodies) if held else {"part": part, "kind": "first", "doc_id": doc.doc_id, "doc_body": doc.body})
                held = doc
            yield batch_of(rows, OPEN)
        if held:
            yield batch_of([{"part": part, "kind": "last", "doc_id": held.doc_id, "doc_body": held.body}], OPEN)

    def close(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = batch.to_pylist()
            yield batch_of([Doc(r["doc_id"], r["doc_body"], bits).before(Doc(r["next_id"], r["next_body"], bits), bodies) for r in rows], PAIRED)

    order = [F.asc_nulls_last("doc_id"), F.asc("tie")]
    ranges = texts(docs).repartitionByRange(*order).sortWithinPartitions(*order, "body")
    rows = written(spark, ranges.select("doc_id", "body").mapInArrow(stream, OPEN), "ordered")
    # The last document of a range meets the first one of the next range that has any; both are as many as the partitions.
    parts = sorted(r.part for r in rows.filter("kind = 'first'").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = rows.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("doc_id").alias("next_id"), F.col("doc_body").alias("next_body"))
    last = rows.filter("kind = 'last'").select("part", "doc_id", "doc_body").join(F.broadcast(following), "part").join(first, "next_part")
    closed = written(spark, last.select("doc_id", "doc_body", "next_id", "next_body").mapInArrow(close, PAIRED), "ends")
    return rows.filter("kind IS NULL").select(*names(PAIRED)).unionByName(closed)


def own_contents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """digest, sha and the compressed content of each text."""

    def content_of(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py() or ""
                content = canonical(text)
                rows.append({"digest": digest(content, bits), "sha": hashlib.sha256(text.encode()).hexdigest(), "body": packed(content)})
            yield batch_of(rows, "digest binary, sha string, body binary")

    return docs.select("text").mapInArrow(content_of, "digest binary, sha string, body binary")


# --- buckets ------------------------------------------------------------------


def thinned(contents: DataFrame) -> DataFrame:
    """digest, sha and body, rows that are equal in a batch once, so that a hot bucket is small before it is shuffled."""

    def thin(batches: Iterator) -> Iterator:
        for batch in batches:
            seen = dict.fromkeys(zip(*(c.to_pylist() for c in batch.columns)))
            yield batch_of([dict(zip(("digest", "sha", "body"), r)) for r in seen], "digest binary, sha string, body binary")

    return contents.select("digest", "sha", "body").mapInArrow(thin, "digest binary, sha string, body binary")


def compared(contents: DataFrame) -> DataFrame:
    """digest, sha and place of the texts in buckets that hold different contents: place is the content's among the bucket's in byte order, from 1.

    contents: those of all members of buckets with several. Contents of a bucket are compared as they stand, byte by byte; a bucket with different ones is a collision of the hash, so rare.
    """
    spark = contents.sparkSession
    rows = written(spark, thinned(contents).distinct(), "contents")
    several = rows.select("digest", "body").distinct().groupBy("digest").count().filter("count > 1").select("digest")

    def unpack(batches: Iterator) -> Iterator:
        import zstandard

        for batch in batches:
            yield batch_of([{**r, "body": zstandard.ZstdDecompressor().decompress(r["body"])} for r in batch.to_pylist()], "digest binary, sha string, body binary")

    odd = matched(rows, written(spark, several, "collisions"), ["digest"], "left_semi").mapInArrow(unpack, "digest binary, sha string, body binary")
    odd = written(spark, odd, "collided")
    places = odd.alias("x").join(odd.select("digest", F.col("body").alias("other")).distinct().alias("y"), "digest").groupBy("digest", "sha", "body")
    # as many contents as don't stand behind one's own; equal contents that were compressed differently are one here
    placed = places.agg(F.sum((F.col("other") <= F.col("body")).cast("int")).alias("place"), F.count(F.lit(1)).alias("n"))
    return written(spark, placed.filter("n > 1").select("digest", "sha", "place").distinct(), "places")


def neighbours(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and text_sha256 of every document."""
    spark = docs.sparkSession
    pairs = paired(docs, bits)
    both = pairs.select(F.explode(F.array(F.struct("digest", F.lit(False).alias("edit")), F.struct(F.col("edited_digest").alias("digest"), F.lit(True).alias("edit")))).alias("x")).select("x.*")
    repeated = written(spark, both.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("edit").alias("edit")).filter("n > 1"), "repeated")
    buckets = repeated.select("digest")
    contents = matched(own_contents(docs, bits), buckets, ["digest"], "left_semi")
    edits = repeated.filter("edit").select(F.col("digest").alias("edited_digest"))
    if not edits.isEmpty():
        # an edited text needs its document and the next one, which stay neighbours among those that are needed
        wanted = written(spark, matched(pairs, edits, ["edited_digest"], "left_semi").select("doc_id", "next_id", F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")), "wanted")
        key = free_name(docs, "_key")
        ids = written(spark, wanted.select(F.explode(F.array("doc_id", "next_id")).alias(key)).select(key_of(F.col(key)).alias(key)).distinct(), "needed")
        needed = matched(docs.withColumn(key, key_of(F.col("doc_id"))), ids, [key], "left_semi")
        remade = paired(needed, bits, bodies=True).select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha"), F.col("edited_body").alias("body"))
        # others among the needed have a false next one
        contents = contents.unionByName(matched(remade, written(spark, wanted.select("digest", "sha").distinct(), "edits"), ["digest", "sha"], "left_semi"))
    places = compared(contents)
    if places.isEmpty():
        found = pairs.select("*", *(F.lower(F.hex(d)).alias(to) for d, to in (("digest", "own"), ("edited_digest", "edit"), ("next_digest", "next"))))
    else:
        found = pairs
        for d, sha, to in (("digest", "sha", "own"), ("edited_digest", "edited_sha", "edit"), ("next_digest", "next_sha", "next")):
            place = places.select(F.col("digest").alias(d), F.col("sha").alias(sha), F.concat(F.lit("-"), F.col("place")).alias("place"))
            found = matched(found, place, [d, sha], "left").withColumn(to, F.concat(F.lower(F.hex(d)), F.coalesce("place", F.lit("")))).drop("place")
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return found.select("doc_id", "n_chars", F.col("edited_sha").alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("edit").alias("edited_fingerprint"), same("own", "edit").alias("near_edited"), same("own", "next").alias("near_next"), F.col("sha").alias("text_sha256"))


def key_of(doc_id: Column) -> Column:
    """A doc_id as a join key that null has, too."""
    return F.coalesce(doc_id.cast("bigint").cast("string"), F.lit(""))
