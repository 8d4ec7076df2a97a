"""Near-duplicate detection by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct shingles of WORDS words. The set
is split by the hash's high bits into BUCKETS buckets; each keeps the smallest hash of its
part, compressed to a register of its count of leading zeros and MANTISSA bits after the
leading one. Bands of ROWS registers are compared: documents that agree in a band
become candidates. Their similarity is first estimated from the registers, corrected for
registers that agree by accident, and pairs far below the threshold (by Hoeffding's
bound, so that one link in ten million is lost) go; the rest are verified on
their full sets.

Documents with equal sets are one class; only its smallest id is compared. In each
band's group every document is compared with a few centres, not with all others: the
links found join most of a group of near copies. Then the groups that still hold several
components are gone through in blocks: each task takes two blocks of one group, compares all
their pairs across components, first by estimate, then exactly through an inverted index
of the shingles, and returns only the links that join components. Blocks that lie in one and the
same component are left out. So no pair that agrees in a band is left uncompared unless its documents
are already joined, and no pair is ever a row.

A set with few shingles leaves registers empty. For the bands only, an empty one borrows from the
first that isn't in a fixed random order of its own, so that it agrees with a probability of the
similarity too. At a similarity of 0.75 the chance that no band agrees is
(1 - 0.75^5)^51, about one in a million.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. With fewer than
WORDS words, the whole sequence is the one shingle. A null text, or one without words, has an
empty set and no links; a null doc_id has none either. Rows that share a doc_id are
one node of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.components import components
from tallyvox.llm.tables import free_name, kept, matched, written

WORDS, PERCENT = 5, 75
BUCKETS, MANTISSA, ROWS = 256, 10, 5
BANDS = BUCKETS // ROWS
MISS = 1e-7
BLOCK = 128
#: What a process remembers is bounded in words and in the bytes of one.
KNOWN_WORDS, LONGEST_KNOWN = 80_000, 64
U = np.uint64
# Odd multipliers from one generator; any fixed ones do.
ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
#: For each register, the order in which it looks for one to borrow from.
LENDERS = np.stack([np.random.default_rng(19 + i).permutation(BUCKETS) for i in range(BUCKETS)])
#: Masks that order ids differently, so that bands have different centres.
MASKS = [int(x) for x in np.random.default_rng(13).integers(0, 1 << 62, 4)]


class Hashes(dict):
    """Hashes of words, remembered but for long ones."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_KNOWN:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingles(text: str | None, hashes: dict, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) > KNOWN_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < width:
        return mixed((h * ODD[: len(h)]).sum(keepdims=True) + np.array([len(h)], dtype=np.uint64) * ODD[63:])
    n = len(h) - width + 1
    total = h[:n] * ODD[0]
    for i in range(1, width):
        total += h[i : i + n] * ODD[i]
    return np.unique(mixed(total))


def registers(found: np.ndarray) -> np.ndarray:
    """The registers of a sorted set: 0 if empty, else leading zeros + 1 above the mantissa bits."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(found):
        bucket = (found >> U(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        value = (found[first] & U((1 << 56) - 1)) >> U(4)
        length = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # bits of value, exact below 2^53
        mantissa = ((value << (52 - length).astype(np.uint64)) >> U(51 - MANTISSA)) & U((1 << MANTISSA) - 1)
        out[bucket[first]] = ((52 - length + 1) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Rows of registers with the empty ones borrowed; a row without any stays empty."""
    out, todo = regs.copy(), np.flatnonzero((regs == 0).any(axis=1) & (regs > 0).any(axis=1))
    for turn in range(BUCKETS):
        if not len(todo):
            break
        some = np.where(out[todo] == 0, regs[todo][:, LENDERS[:, turn]], out[todo])
        out[todo] = some
        todo = todo[(some == 0).any(axis=1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of registers: the Jaccard estimates, without the expected accidents, and the registers they rest on."""
    some = ((a > 0) | (b > 0)).sum(axis=-1)
    both = (a > 0) & (b > 0)
    same = (both & (a == b)).sum(axis=-1)
    # two different minima of sets of like size agree in leading zeros in about a third of cases, and then in the mantissa by 2^-MANTISSA
    accidents = both.sum(axis=-1) / (3.0 * (1 << MANTISSA))
    return (same - accidents) / np.maximum(some - accidents, 1.0), some


def may_link(j: np.ndarray, some: np.ndarray, percent: int) -> np.ndarray:
    """Whether estimates j, resting on so many registers, leave a link possible."""
    return j >= percent / 100 - np.sqrt(np.log(1 / MISS) / (2 * np.maximum(some, 1)))


def kept_hashes() -> Hashes:
    """The word hashes of this Python process, kept while its worker is reused."""
    return kept("hashes", None, Hashes)


def sketched(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n (set size), set_id (of equal sets; null if empty), registers (binary)."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = kept_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, n, ids, regs = batch.slice(at, 1024), [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, hashes, width)
                    n.append(len(found))
                    ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    regs.append(registers(found).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "set_id", "registers"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id bigint, n bigint, set_id binary, registers binary")


def banded(sketches: DataFrame) -> DataFrame:
    """key, id: one row for each band of a sketch that isn't empty."""

    def band(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                regs = filled(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None] * ODD[62], len(regs), axis=0)
                for i in range(ROWS):
                    keys = mixed(keys + regs[:, :, i] * ODD[10 + i])
                row, column = np.nonzero(regs.any(axis=2))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, column].view(np.int64)), pa.array(ids[row], pa.int64())], names=["key", "id"])

    return sketches.select("doc_id", "registers").mapInArrow(band, "key bigint, id bigint")


def likely(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of pairs (a, b, registers_a, registers_b) whose estimate doesn't rule a link out."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
                j, some = estimate(a, b)
                yield batch.select([0, 1]).filter(pa.array(may_link(j, some, percent)))

    return pairs.select("a", "b", "registers_a", "registers_b").mapInArrow(keep, "a bigint, b bigint")


def verified(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of pairs (a, b, set_a, set_b) that reach the threshold on their full sets."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                mask.append(100 * same >= percent * (len(both) - same))
            yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(keep, "a bigint, b bigint")


def full_sets(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """id, set (sorted hashes, binary), registers."""

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = kept_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [shingles(t, hashes, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([registers(x).tobytes() for x in found], pa.binary())], names=["id", "set", "registers"])

    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(sets, "id bigint, set binary, registers binary")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: likely by estimate, verified on full sets. sets: id, set, registers."""
    spark = pairs.sparkSession
    regs = sets.select("id", "registers")
    seen = pairs.join(regs.toDF("a", "registers_a"), "a").join(regs.toDF("b", "registers_b"), "b")
    some = written(spark, likely(seen, percent), "likely")
    full = sets.select("id", "set")
    seen = some.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b")
    return written(spark, verified(seen, percent).distinct(), "links")


def joins_in_block(ids: np.ndarray, sides: np.ndarray, components: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links join, as few as connect them. sides: 0 for rows to be compared with all, else 1 and 2 with each other."""
    names, of = np.unique(components, return_inverse=True)
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes, out = np.array([len(x) for x in sets]), []
    for x in range(len(sets)):
        other = (of != of[x]) & ((sides == 0) | (sides != sides[x]))
        other[: x + 1] = False
        small, large = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        at = np.flatnonzero(other & (100 * small >= percent * large))
        if len(at):
            at = at[may_link(*estimate(regs[at], regs[x][None]), percent)]
        if not len(at):
            continue
        low, high = np.searchsorted(every, sets[x]), np.searchsorted(every, sets[x], "right")
        found = np.concatenate([owner[a:b] for a, b in zip(low, high)])
        same = np.bincount(found, minlength=len(sets))[at]
        for y in at[100 * same >= percent * (sizes[at] + sizes[x] - same)]:
            a, b = top(of[x]), top(of[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(names[of[x]]), int(names[of[y]])))
    return out


def block_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b: components) across components within each cluster of rows (low, id, of).

    A component with many rows in a cluster has blocks of its own; the rest share blocks. Blocks of like component aren't paired.
    """
    spark = rows.sparkSession
    sizes = written(spark, rows.groupBy("low", "of").agg(F.count(F.lit(1)).alias("size")).withColumn("own", F.col("size") >= block // 2), "sizes")
    shared = written(spark, sizes.groupBy("low").agg(F.sum(F.when(~F.col("own"), F.col("size")).otherwise(0)).alias("rest")), "shared")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("bigint")
    sizes = written(spark, matched(sizes, shared, ["low"], "inner"), "sizes")
    dealt = matched(rows, sizes, ["low", "of"], "inner").withColumn("pure", F.when(F.col("own"), F.col("of")))
    number = F.when(F.col("own"), F.pmod(F.xxhash64("id"), parts(F.col("size")))).otherwise(F.pmod(F.xxhash64("of"), parts(F.col("rest"))))
    dealt = written(spark, dealt.select("low", "id", "of", "pure", number.alias("no")), "dealt")
    blocks = written(spark, dealt.select("low", "pure", "no").distinct().withColumn("block", F.xxhash64("low", "pure", "no")), "blocks")
    one, two = blocks.select("low", F.col("pure").alias("p"), F.col("block").alias("x")), blocks.select("low", F.col("pure").alias("q"), F.col("block").alias("y"))
    pairs = written(spark, one.join(two, "low").filter("x <= y and (p is null or q is null or p <> q)").select("x", "y"), "pairs")
    sided = pairs.select(F.col("x").alias("block"), "x", "y", F.when(F.col("x") == F.col("y"), 0).otherwise(1).alias("side")).union(pairs.filter("x <> y").select(F.col("y"), "x", "y", F.lit(2)))
    sided = written(spark, sided.withColumnRenamed("x", "first").withColumnRenamed("y", "second"), "pairs")
    full = dealt.select(F.xxhash64("low", "pure", "no").alias("block"), "id", "of").join(sets, "id")

    def compare(table):
        import pyarrow as pa

        sets_of = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
        found = joins_in_block(*(table.column(c).to_numpy() for c in ("id", "side", "of")), sets_of, regs, percent)
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return matched(full, sided, ["block"], "inner").groupBy("first", "second").applyInArrow(compare, "a bigint, b bigint")


def linked(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    sketches = written(spark, sketched(docs, width), "sketches")
    classes = sketches.filter("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"))
    classes = written(spark, classes.filter("id <> last").select("set_id", "id"), "classes")
    members = matched(sketches.select("doc_id", "n", "set_id"), classes, ["set_id"], "left")
    members = written(spark, members.select("doc_id", "n", "set_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id")), "members")
    others = written(spark, members.filter("id <> doc_id").select("doc_id", "set_id").distinct(), "others")
    firsts = matched(sketches.filter("n > 0 and doc_id is not null"), others, ["doc_id", "set_id"], "left_anti")
    repeated = written(spark, members.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    n_repeated = repeated.count()

    # every document against its groups' centres
    mask = F.element_at(F.array(*map(F.lit, MASKS)), F.expr(f"cast(key & {len(MASKS) - 1} as int) + 1"))
    bands = banded(firsts)
    groups = bands.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("c"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = written(spark, groups.select("key", "low", F.col("c").bitwiseXOR(mask).alias("centre")), "groups")
    held = written(spark, matched(bands, groups, ["key"], "inner").select("low", "centre", "id").distinct(), "groups")
    ids = written(spark, held.select(F.col("id").alias("doc_id")).distinct(), "ids")
    n_ids = ids.count()
    texts = matched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, ["doc_id"], "left_semi", n_ids)
    sets = written(spark, full_sets(texts.dropDuplicates(["doc_id", "text"]) if n_repeated else texts, width), "sets")
    pairs = held.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = links_of(pairs, sets, percent)
    if n_repeated:  # rows that share a doc_id
        links = links.union(matched(members.filter("n > 0"), repeated, ["doc_id"], "left_semi", n_repeated).filter("id <> doc_id").select("doc_id", "id"))
    first = components(links)

    # then the rest: across components within one group
    labelled = matched(held.select("low", "id").distinct(), first.withColumnRenamed("node", "id"), ["id"], "left").select("low", "id", F.coalesce("component", "id").alias("of"))
    labelled = written(spark, labelled, "labelled")
    several = written(spark, labelled.groupBy("low").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y and size > 2").select("low"), "several")
    rest = matched(labelled, several, ["low"], "left_semi")
    more = written(spark, block_links(rest, sets, percent), "links")
    if more.isEmpty():
        found = first
    else:
        found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # sets that are equal share a component through their class
    out = matched(members, found.withColumnRenamed("node", "id"), ["id"], "left", None)
    component = F.coalesce("component", "id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns. A null doc_id stays."""
    key = free_name(docs, "_gone")
    gone = written(docs.sparkSession, linked(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "gone")
    return matched(docs.withColumn(key, F.col("doc_id").cast("bigint")), gone, [key], "left_anti").drop(key)
