"""Importance resampling towards a target distribution, over hashed n-gram features.

Every run of 1 to `longest` neighbouring words is a feature; its bucket is the CRC-32 of its words joined
by one space, modulo `buckets`. A bucket's gain is the log-ratio of its smoothed frequencies in the target and in
the corpus, a document's weight the sum of the gains of its features. To each weight a Gumbel variate drawn from the document's
id is added, and the documents of the highest scores are drawn: sampling without replacement, in proportion to the weights.

No n-gram is ever written out. Each word's CRC is computed once (and remembered while a bounded memory lasts); that of a
longer run follows from CRC algebra: appending a string of n bytes multiplies the CRC before it by the n-th power of the
matrix over GF(2) that shifts a CRC by one zero byte, and adds the CRC of what is appended. The powers of two of
this matrix are held as tables by byte, so a whole block of runs is extended by a word with a few gathers for each bit of the words' lengths.

Texts are read in blocks of about BLOCK bytes, cut between words; the last words of a block are carried over. Corpus
counts are summed in each task and then by bucket, so no bucket is hot and the driver holds `buckets` numbers. Scores are ordered
by range partitions with a running number in each, so ranks need no single task.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A null text has no words;
a document without features has weight 0. A null doc_id counts as an empty one in the variate and stands last among equal scores. Repeated rows are
rows of their own, each with a rank. Other columns don't matter. An empty table gives no rows; against an empty target every gain is that of its corpus count alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.tables import free_name, kept, written

#: Bytes of words, A-Z lower-cased; all others become spaces.
FOLDED = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK, KNOWN_WORDS, LONGEST_KNOWN = 1 << 20, 250_000, 64
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
LENGTH_BITS = 40


# --- CRC algebra --------------------------------------------------------------


def product(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as its images of each byte at each of the four places, times each CRC."""
    c = crc.astype(np.uint32)
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def by_byte(columns: np.ndarray) -> np.ndarray:
    """The tables of a matrix given by its images of the 32 single bits."""
    values, out = np.arange(256), np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> bit % 8 & 1, columns[bit], np.uint32(0)).astype(np.uint32)
    return out


@cache
def shifts() -> list[np.ndarray]:
    """Tables of the shifts by 1, 2, 4, ... zero bytes: each the square of the one before."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = by_byte(np.where(bits == 1, np.uint32(POLYNOMIAL), bits >> np.uint32(1)).astype(np.uint32))  # by one bit
    found = []
    for power in range(3 + LENGTH_BITS):
        if power >= 3:
            found.append(one)
        one = by_byte(product(one, product(one, bits)))
    return found


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says, without the constants of the start and the end."""
    out, longest = crc.astype(np.uint32), int(lengths.max(initial=0))
    for bit, tables in enumerate(shifts()):
        if longest >> bit == 0:
            break
        on = np.flatnonzero(lengths >> bit & 1)
        out[on] = product(tables, out[on])
    return out


def joined(before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs of concatenations: of strings with CRC `before` and others with CRC `after` of the given lengths in bytes."""
    return shifted(before, lengths) ^ after


SPACE = np.uint32(zlib.crc32(b" "))


def run_codes(crc: np.ndarray, lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For 1, 2, ... words the CRCs of the runs of so many that begin at each word (fewer near the end)."""
    yield crc
    if longest > 1:
        spaced = joined(np.broadcast_to(SPACE, crc.shape), crc, lengths)  # a word after a space
        run = crc
        for n in range(2, longest + 1):
            if len(crc) < n:
                return
            run = joined(run[:-1], spaced[n - 1 :], lengths[n - 1 :] + 1)
            yield run


# --- words --------------------------------------------------------------------


class Words(dict):
    """A word's CRC and length as one number, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word) | len(word) << 32
        if len(word) <= LONGEST_KNOWN and len(self) < KNOWN_WORDS:
            self[word] = code
        return code


def word_blocks(text: str | None, known: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRCs and lengths of a text's words, in blocks."""
    data = text.encode("utf-8", "replace").translate(FOLDED) if text else b""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at = end
        if words:
            codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            yield (codes & 0xFFFFFFFF).astype(np.uint32), codes >> 32


def feature_blocks(text: str | None, known: Words, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """How many new words a block has, and the buckets of the features that end in it."""
    crc, lengths = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    for new_crc, new_lengths in word_blocks(text, known):
        carried = len(crc)
        crc, lengths = np.concatenate([crc, new_crc]), np.concatenate([lengths, new_lengths])
        # runs that end among the carried words were given out before
        runs = [codes[max(0, carried - n + 1) :] for n, codes in enumerate(run_codes(crc, lengths, longest), 1)]
        yield len(new_crc), (np.concatenate(runs) % np.uint32(buckets)).astype(np.int64)
        keep = min(longest - 1, len(crc))
        crc, lengths = crc[len(crc) - keep :], lengths[len(lengths) - keep :]


# --- tables -------------------------------------------------------------------


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all docs fall into each bucket that has any. Each task brings at most `buckets` rows."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, found = kept("importance words", 0, Words), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, features in feature_blocks(text.as_py(), known, longest, buckets):
                    found += np.bincount(features, minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counts.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed frequencies) of each bucket."""
    t, s, k = target.astype(np.float64), corpus.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight of every document; one narrow pass."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # `buckets` numbers

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = kept("importance words", 0, Words)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = features = weight = 0
                for new, found in feature_blocks(text.as_py(), known, longest, buckets):
                    words, features, weight = words + new, features + len(found), weight + int(sent.value[found].sum())
                rows.append((words, features, weight))
            table = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(3))], names=[id_col, "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(weigh, f"{id_col} bigint, n_words bigint, n_features bigint, weight bigint")


def scored(weights: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """weights with score: the weight and a Gumbel variate in thousandths that follows from the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise.cast("bigint"))


def ranked(rows: DataFrame, order: list, to: str = "rank") -> DataFrame:
    """rows with their place in a total order, from 1, by range partitions; rows is written once, in that order."""
    spark = rows.sparkSession
    at, part = free_name(rows, "_at"), free_name(rows, "_part")
    # in a partition this number counts its rows up from the partition's number times 2^33
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ordered = written(spark, numbered, "ordered").withColumn(part, F.shiftright(at, 33))
    sizes, before, first = sorted(map(tuple, ordered.groupBy(part).count().collect())), 0, []  # a row for each partition
    for p, n in sizes:
        first.append((p, before))
        before += n
    offset = free_name(ordered, "_before")
    offsets = spark.createDataFrame(first, f"{part} bigint, {offset} bigint")
    place = F.col(offset) + F.col(at) - F.shiftleft(F.col(part), 33) + 1
    return ordered.join(F.broadcast(offsets), part).withColumn(to, place).drop(at, part, offset)


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank; rank is null for those that aren't drawn.

    Of the N documents with at least least_words words the floor(percent * N / 100) with the highest scores are drawn, ties to the smaller doc_id.
    """
    spark = docs.sparkSession
    gain = gains(dense(bucket_counts(target, longest, buckets), buckets), dense(bucket_counts(docs, longest, buckets), buckets))
    rows = written(spark, scored(weighed(docs, gain, longest), seed), "weighed")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]
    place = F.when(F.col("rank") <= drawn, F.col("rank"))
    short = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(enough, order).withColumn("rank", place).unionByName(short)
