"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed trigram model of words. As an automaton, a state is the longest history of up to two tokens that
training has seen; an arc for each n-gram seen in training carries the log-probability of its word after the
state's history, and a failure arc leads to the state of the history without its first word, with
the weight that the words not seen there share. The root has an arc for each training word and one for any other. A
text is read once from left to right, from the start state: each token moves along an arc, through failure arcs
where there is none, and the weights add up to the text's log-probability.

    root:          P(w) = (c(w) + 1) / (N + V + 1), for an unseen word with c(w) = 0
    arc h -> w:    P(w|h) = (1 - b(h)) c(h,w) / c(h) + b(h) P(w|h')
    failure arc:   b(h), from h to h', the history without its first word

The weights out of each state sum to one. The failure weight b(h) depends on the history's length and on how often
it was seen: among the training tokens after histories seen as often (in classes of counts), it is the share whose n-gram was seen
there only, so the share that would fail if its own occurrence were left out. Counts are over all training documents; nothing is pruned.

The automaton grows with the corpus, so no machine holds it. Documents stand in blocks of
neighbouring rows, of about BLOCK_BYTES; texts over SEGMENT_BYTES are split between words beforehand, and a segment
carries the state it begins in, its two tokens before. A block asks for the counts of its distinct words (63-bit hashes), bigrams and
trigrams (hashes of so many bits more than the corpus has n-grams that, at any size, one n-gram in about 10,000 shares its count with another): sorted, as differences,
dealt to buckets by their high bits, so a frequent word costs one hash for each block and no
bucket is hot. A bucket sums what the blocks bring and sends each block the totals in the order asked.
The texts are then dealt once by block; each block finds the counts along its texts' ways through the automaton, which are
written. What these say about failure weights is summed, and one pass over the written counts adds up the weights.

Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, then one end. A null text counts as
empty: its end alone. A null doc_id is not held out. An empty table gives no rows; if all documents are held out, N and V are 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyvox.llm.minhash import kept_hashes, mixed
from tallyvox.llm.tables import let_go, new_path, written

U = np.uint64
BLOCK_BYTES, SEGMENT_BYTES = 2 << 20, 32 << 10
BUCKET_BYTES = 6 << 20  # of text behind one bucket
END, START = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
LEFT, RIGHT, FAR = U(0xFF51AFD7ED558CCD), U(0x9DDFEA08EB382D69), U(0xD6E8FEB86659FD93)
KNOWN_WORDS = 250_000
CLASSES = 96  # of counts of histories
WORD_BITS, LEAST_BITS, SPARE_BITS = 63, 40, 12  # of hashes
WAYS = "doc_id bigint, held_out boolean, file bigint, at bigint, whole boolean, tokens bigint, counts binary, stats binary"
SCORES = "doc_id bigint, held_out boolean, file bigint, at bigint, whole boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def tokens(text: str | None, hashes: dict) -> np.ndarray:
    """The hashes of a text's words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if len(hashes) > KNOWN_WORDS:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


class Grams:
    """The tokens of several texts in a row: hashes of words, bigrams and trigrams at each, and where texts begin.

    texts: (words, words before that a segment begins after, whether the text's end follows).
    """

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray, bool]], bits: int):
        end = np.array([END], dtype=np.uint64)
        parts = [x for words, before, last in texts for x in ((before, words, end) if last else (before, words))]
        t = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        sizes = np.array([len(w) + len(b) + last for w, b, last in texts], dtype=np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.context = np.array([len(b) for _, b, _ in texts], dtype=np.int64)
        self.ends = self.begins + sizes
        filled = self.begins[sizes > 0]
        one, two = np.roll(t, 1), np.roll(t, 2)
        one[filled], two[filled] = START, U(0)
        two[(filled + 1)[filled + 1 < self.ends[sizes > 0]]] = START
        self.own = np.ones(len(t), dtype=bool)  # not only context
        for b, n in zip(self.begins[self.context > 0], self.context[self.context > 0]):
            self.own[b : b + n] = False
        self.at_start = np.zeros(len(t), dtype=bool)
        self.at_start[filled] = True
        self.words = mixed(t * LEFT) >> U(1)
        pair = one * LEFT + t * RIGHT
        self.bigrams, self.trigrams = (mixed(x) >> U(64 - bits) for x in (pair + U(1), mixed(pair + U(3)) + two * FAR))

    def codes(self, kind: int) -> np.ndarray:
        return self.words if kind == 1 else np.concatenate([self.bigrams, self.trigrams])


def asked(code: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes, and how often each stands in what teaches."""
    if not len(code):
        return code, np.zeros(0, dtype=np.int64)
    marked = code << U(1) | taught.astype(np.uint64)
    marked.sort()
    code = marked >> U(1)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat((marked & U(1)).astype(np.int64), first)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of little-endian 64-bit numbers, all first bytes first; high bytes that are mostly zero cost little then."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    if len(out):
        out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


def width_of(most: int) -> int:
    return max(1, (int(most).bit_length() + 7) // 8)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers of up to 64 bits in as many bytes as the largest needs; the first byte says how many."""
    width = width_of(x.max()) if len(x) else 1
    return bytes([width]) + planes(x, width)


def spread_out(data: bytes) -> np.ndarray:
    return from_planes(data[1:], data[0])


def packed_codes(code: np.ndarray) -> bytes:
    """Sorted numbers as differences, of a width that nearly all fit; the few larger ones are listed with their places."""
    if not len(code):
        return b""
    step = np.diff(code, prepend=U(0))
    bits = np.frexp(step.astype(np.float64))[1]
    width = min(range(1, 9), key=lambda w: len(step) * w + 12 * int((bits > 8 * w).sum()))
    large = np.flatnonzero(bits > 8 * width)
    low = step.copy()
    low[large] = 0
    return bytes([width]) + np.array([len(large)], dtype="<u4").tobytes() + large.astype("<u4").tobytes() + step[large].astype("<u8").tobytes() + planes(low, width)


def unpacked_codes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    n = int(np.frombuffer(data, dtype="<u4", count=1, offset=1)[0])
    step = from_planes(data[5 + 12 * n :], data[0])
    step[np.frombuffer(data, dtype="<u4", count=n, offset=5)] = np.frombuffer(data, dtype="<u8", count=n, offset=5 + 4 * n)
    return np.cumsum(step, dtype=np.uint64)


def class_of(counts: np.ndarray) -> np.ndarray:
    """The class of a history's count: up to 8 each its own, then two for each doubling."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(c <= 8, c, 9 + np.floor(2 * np.log2(c / 8))).astype(np.int64).clip(0, CLASSES - 1)


class Automaton:
    """Weights of ways through the model, from the counts along them."""

    def __init__(self, tokens_n: int, types_n: int, starts: int, fail: np.ndarray):
        self.tokens_n, self.types_n, self.starts, self.fail = tokens_n, types_n, starts, fail  # fail: length of history x class

    def walk(self, counts: np.ndarray, begins: bool, context: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the root's weight and of the weight taken at each token after the context; counts: 3 x tokens, of words, bigrams and trigrams.

        The state before a token is the longest seen history; a token that has no arc there goes through failure arcs,
        so its weight is the failure weights' product with the arc's where it first has one.
        """
        c, histories = counts.astype(np.float64), histories_of(counts, self.starts, begins)
        root = (c[0] + 1) / (self.tokens_n + self.types_n + 1)
        weight = root
        for length in (1, 2):
            seen = histories[length - 1].astype(np.float64)
            fail = self.fail[length - 1][class_of(seen)]
            weight = np.where(seen > 0, (1 - fail) * c[length] / np.maximum(seen, 1) + fail * weight, weight)
        return np.log10(root[context:]), np.log10(weight[context:])


def histories_of(counts: np.ndarray, starts: int, begins: bool) -> np.ndarray:
    """How often the histories of one and two tokens before each token were seen; the start has none of two."""
    out = np.zeros((2, counts.shape[1]), dtype=np.int64)
    out[0, 1:], out[1, 1:] = counts[0, :-1], counts[1, :-1]
    if begins and counts.shape[1]:
        out[0, 0] = starts
    return out


def fail_weights(seen: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Failure weights by length of history and class: the share of training tokens whose n-gram was seen once only; a class without any fails half the time."""
    return (once + 1.0) / (seen + 2.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def split(text: bytes, size: int) -> list[bytes]:
    """A text, cut before white space into parts of at least `size` bytes but the last; a longer word stays whole."""
    space, parts, at = re.compile(rb"[\x20\x09-\x0d]"), [], 0
    while at < len(text):
        found = space.search(text, min(at + size, len(text)))
        end = found.start() if found else len(text)
        parts.append(text[at:end])
        at = end
    return parts


def in_blocks(docs: DataFrame, segment: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Row]:
    """doc_id, text, held_out, file, at (the row's place in its file), before, last, block, place, whole; and counts of bytes, rows, long texts and starts.

    Files and places of rows stay the same however the files are split into tasks. Documents
    that don't come straight from files are written first, as the segments of long ones are; a segment's file and place are its document's.
    """
    spark = docs.sparkSession

    def located(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))

    try:
        rows = located(docs)
        rows.schema  # where a session analyses late, it fails here
    except AnalysisException:
        rows = located(written(spark, docs.select("doc_id", "text"), "documents"))
    rows = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("path").alias("file"), "at")
    is_long = F.coalesce(F.octet_length("text") > segment, F.lit(False))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count_if(is_long).alias("long"), F.count_if(~F.col("held_out")).alias("starts")).first()
    per_block = max(64, min(4096, block_bytes * max(size["rows"], 1) // max(size["bytes"] or 0, 1)))
    block = lambda rows_: F.xxhash64("file", F.floor(F.col("at") / rows_))
    # a long text leaves an empty place, so that the rows of a block stay neighbours
    short = rows.select("doc_id", F.when(~is_long, F.col("text")).alias("text"), "held_out", "file", "at", F.lit(None).cast("string").alias("before"), (~is_long).alias("last"), block(per_block).alias("block"), F.col("at").alias("place"), F.lit(True).alias("whole"))
    if not size["long"]:
        return short, size

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, text, out, file, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                parts, before = split(text.encode("utf-8", "replace"), segment), b""
                for i in range(0, len(parts), 16):
                    some, heads = parts[i : i + 16], []
                    for part in some:
                        heads.append(before)
                        before = b" ".join((before + b" " + part).split()[-2:])
                    n = len(some)
                    text_of = lambda xs: pa.array([x.decode("utf-8", "replace") for x in xs], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), text_of(some), pa.array([out] * n), pa.array([file] * n, pa.int64()), pa.array([at] * n, pa.int64()), text_of(heads), pa.array([i + j == len(parts) - 1 for j in range(n)])], names=["doc_id", "text", "held_out", "file", "at", "before", "last"])

    path = new_path(spark, "segments")
    rows.filter(is_long).mapInArrow(cut, "doc_id bigint, text string, held_out boolean, file bigint, at bigint, before string, last boolean").write.parquet(path)
    long = spark.read.parquet(path).select("*", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / (block_bytes // segment)), F.lit("long")).alias("block"), F.col("_metadata.row_index").alias("place"), F.lit(False).alias("whole"))
    return short.unionByName(long), size


ASKED = "block bigint, first bigint, last bigint, kind int, bucket int, codes binary, counts binary"
TOLD = "block bigint, first bigint, last bigint, kind int, bucket int, totals binary, tokens bigint, types bigint"


def bits_for(size: int) -> int:
    """How many bits the hashes of bigrams and trigrams have in a corpus of so many bytes."""
    return min(WORD_BITS, max(LEAST_BITS, size.bit_length() + SPARE_BITS))


def edges_of(buckets: int, bits: int) -> np.ndarray:
    """Where the buckets after the first begin."""
    return (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64)


def grams_of(texts: list, befores: list, lasts: list, bits: int) -> Grams:
    hashes = kept_hashes()
    return Grams([(tokens(t, hashes), tokens(b, hashes), last) for t, b, last in zip(texts, befores, lasts)], bits)


def requests(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """What each run of a block's rows within one task asks for; kind 1: words, kind 2: bigrams and trigrams."""

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        edges = {kind: edges_of(buckets, b) for kind, b in ((1, WORD_BITS), (2, bits))}

        def told(block: int, rows: list) -> pa.RecordBatch:
            _, places, texts, befores, lasts, out = zip(*rows)
            grams, first, last, pieces = grams_of(texts, befores, lasts, bits), places[0], places[-1], []
            taught = grams.own & ~np.repeat(np.array(out), grams.ends - grams.begins)
            for kind in (1, 2):
                code, count = asked(grams.codes(kind), taught if kind == 1 else np.tile(taught, 2))
                at = np.concatenate([[0], np.searchsorted(code, edges[kind]), [len(code)]])
                for b in range(buckets):
                    if at[b + 1] > at[b]:
                        base = edges[kind][b - 1] if b else U(0)
                        pieces.append((block, first, last, kind, b, packed_codes(code[at[b] : at[b + 1]] - base), squeezed(count[at[b] : at[b + 1]])))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2
            columns = zip(*pieces) if pieces else [()] * len(kinds)  # a run of white space asks for nothing
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in ASKED.split(", ")])

        rows: list = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if rows and (row[0] != rows[-1][0] or row[1] != rows[-1][1] + 1):
                    yield told(rows[0][0], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield told(rows[0][0], rows)

    return blocks.select("block", "place", "text", "before", "last", "held_out").mapInArrow(ask, ASKED)


def answers(wanted: DataFrame) -> DataFrame:
    """The totals of a bucket, for each row in its own order; and a row with the bucket's token and type counts (block null)."""
    names = [x.split()[0] for x in TOLD.split(", ")]

    def total(table):
        import pyarrow as pa
        import pyarrow.compute

        schema = pa.schema([(n, pa.int32() if n in ("kind", "bucket") else pa.binary() if n == "totals" else pa.int64()) for n in names])
        out = []
        for kind in (1, 2):
            own = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not own.num_rows:
                continue
            codes = [unpacked_codes(c) for c in own.column("codes").to_pylist()]
            ends = np.cumsum([len(c) for c in codes])
            code, place = np.unique(np.concatenate(codes), return_inverse=True)
            del codes
            counts = np.concatenate([spread_out(c) for c in own.column("counts").to_pylist()])
            totals = np.bincount(place, weights=counts, minlength=len(code)).astype(np.uint64)
            told = totals[place]
            parts = [squeezed(x) for x in np.split(told, ends[:-1])]
            none = pa.nulls(own.num_rows, pa.int64())
            out.append(pa.table([own.column(i) for i in range(5)] + [pa.array(parts, pa.binary()), none, none], names=names))
            if kind == 1:
                sums = [None, None, None, 0, own.column("bucket")[0].as_py(), None, int(totals.sum()), int((totals > 0).sum())]
                out.append(pa.table([pa.array([v], f.type) for v, f in zip(sums, schema)], names=names))
        return pa.concat_tables([t.cast(schema) for t in out])

    return wanted.groupBy("bucket").applyInArrow(total, TOLD)


def ways(blocks: DataFrame, told: DataFrame, starts: int, bits: int) -> DataFrame:
    """The counts along each text's way (see WAYS), and rows with what a block's training tokens say about failure weights (doc_id and counts null)."""
    names = [x.split()[0] for x in WAYS.split(", ")]

    def find(texts, counts):
        import pyarrow as pa

        texts, counts = texts.sort_by("place"), counts.sort_by("bucket")
        places = texts.column("place").to_numpy()
        run = list(zip(counts.column("first").to_pylist(), counts.column("last").to_pylist(), counts.column("kind").to_pylist()))
        blobs = counts.column("totals").to_pylist()
        of: dict = {}
        for r, blob in zip(run, blobs):
            of.setdefault(r, []).append(blob)
        columns: list[list] = [[] for _ in names]
        stats = np.zeros((2, 2, CLASSES), dtype=np.int64)  # length of history, seen and once, class
        for start, stop in sorted({(f, t) for f, t, _ in run}):
            a, b = int(np.searchsorted(places, start)), int(np.searchsorted(places, stop, "right"))
            part = texts.slice(a, b - a)
            grams = grams_of(*(part.column(c).to_pylist() for c in ("text", "before", "last")), bits)
            n = len(grams.words)
            along = np.empty((3, n), dtype=np.int64)
            for kind in (1, 2):
                _, place = np.unique(grams.codes(kind), return_inverse=True)
                total = np.concatenate([spread_out(x) for x in of[start, stop, kind]]).astype(np.int64)
                along[0 if kind == 1 else slice(1, 3)] = total[place].reshape(-1, n)
            along[2, grams.at_start] = 0  # the start has no history of two
            rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "held_out", "file", "at", "whole", "last")))
            taught = grams.own & ~np.repeat(part.column("held_out").to_numpy(), grams.ends - grams.begins)
            seen = histories_of(along, starts, False)
            seen[0, grams.at_start], seen[1, grams.at_start] = starts, 0
            for length in (1, 2):
                use = taught & (seen[length - 1] > 0)
                classes = class_of(seen[length - 1][use])
                stats[length - 1, 0] += np.bincount(classes, minlength=CLASSES)
                stats[length - 1, 1] += np.bincount(classes[along[length][use] == 1], minlength=CLASSES)
            for (doc, out, file, at, whole, last), x, y, k in zip(rows, grams.begins.tolist(), grams.ends.tolist(), grams.context.tolist()):
                if whole and not last:
                    continue  # the place of a long text
                blob = bytes([k]) + squeezed(along[:, x:y].ravel())
                for column, value in zip(columns, (doc, out, file, at, whole, y - x - k, blob, None)):
                    column.append(value)
        for column, value in zip(columns, (None, None, None, None, None, None, None, stats.tobytes())):
            column.append(value)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    have = told.filter("block is not null").select("block", "first", "last", "kind", "bucket", "totals")
    rows = blocks.select("block", "place", "text", "before", "last", "held_out", "doc_id", "file", "at", "whole")
    return rows.groupBy("block").cogroup(have.groupBy("block")).applyInArrow(find, WAYS)


def learned_weights(found: DataFrame) -> np.ndarray:
    """The failure weights from what all blocks say."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(4 * CLASSES, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                sums += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.int64())], names=["place", "n"])

    sums = np.zeros(4 * CLASSES)
    for r in found.filter("stats is not null").select("stats").mapInArrow(add, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():  # 4 x CLASSES rows
        sums[r["place"]] = r["n"]
    seen, once = sums.reshape(2, 2, CLASSES).transpose(1, 0, 2)
    return fail_weights(seen, once)


def scored(docs: DataFrame, segment: int = SEGMENT_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs."""
    spark = docs.sparkSession
    blocks, size = in_blocks(docs, segment, block_bytes)
    volume, starts = (size["bytes"] or 0) + 16 * size["rows"], int(size["starts"])
    buckets, bits = max(4, volume // BUCKET_BYTES), bits_for(volume)
    counts_path = new_path(spark, "counts")
    answers(requests(blocks, buckets, bits)).write.parquet(counts_path)
    told = spark.read.parquet(counts_path)
    let_go(spark)
    sums = told.filter("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_tokens, n_types = int(sums[0]), int(sums[1])
    found = written(spark, ways(blocks, told, starts, bits), "ways")
    let_go(spark, counts_path)
    fail = learned_weights(found)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = Automaton(n_tokens, n_types, starts, fail)
        for batch in batches:
            known, base, taken = [], [], []
            for blob in batch.column(6).to_pylist():
                context = blob[0]
                counts = spread_out(blob[1:]).astype(np.int64).reshape(3, -1)
                known.append(int((counts[0, context:] > 0).sum()))
                one, all_ = machine.walk(counts, context == 0, context)
                base.append(float(one.sum()))
                taken.append(float(all_.sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(taken, pa.float64())], names=[x.split()[0] for x in SCORES.split(", ")])

    scores = found.filter("counts is not null").mapInArrow(score, SCORES)
    whole = scores.filter("whole").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    parts = scores.filter("not whole").groupBy("file", "at").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    out = whole.unionByName(parts.select(whole.columns))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
