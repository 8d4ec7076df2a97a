"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample again and again at the median along the difference of two
random members, to leaves of about LEAF rows. Every row is then put into one leaf of each
tree. A query walks all trees at once through one priority queue and opens the best leaves: PROBES, or as many more as it takes until
TRIALS of the queries meet the share RECALL of their true neighbours, which are found by scoring all
rows. The queue is ordered by how unlikely it is that a near vector lies in a node: at each cut on the way the logistic function of
the query's distance to it, by the spread of the trials' neighbours. Where a leaf's rows and its queries meet, all of them are scored exactly, in double
precision, and each query keeps its best there; the best of all leaves are its answer.

Nearness is the inner product. For the trees, a vector gets one more component
that brings all to the same length, so near means a large inner product for
vectors of any length.

Sample and forest are bounded in rows and bytes. A leaf's rows are dealt to blocks of BLOCK rows and BLOCK_BYTES at most, by counts
over all rows; queries stream past a block, so no task holds more than one block, however large a leaf is.

Equal vectors are one entry that carries its K + 1 smallest ids; no answer can hold more of them,
so a group of equal vectors of any size stays exact and small. Ties go to the smaller id.

Vectors that are null, zero, hold null or non-finite components, or have another length
than most (the smaller of equally frequent lengths counts) take no part, and neither do null ids. Rows that repeat an id and a
vector count once; an id with two vectors takes part with both. An empty table has no answers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvox.llm.tables import written
from tallyvox.shipping import Sent

K, TREES, LEAF, PROBES = 20, 16, 256, 160
SAMPLE = 65_536  # rows that trees are grown on, at most about so many
LEAST_IN_LEAF = 16  # of the sample
TRIALS, RECALL = 200, 0.93
SAMPLE_BYTES, FOREST_BYTES, TRIAL_BYTES = 64 << 20, 64 << 20, 32 << 20
BLOCK, BLOCK_BYTES, ASKED = 4096, 8 << 20, 8192
SALTS = 64


@dataclass
class Forest:
    depth: int
    planes: np.ndarray  # trees x inner nodes x (components + 1), in heap order
    cuts: np.ndarray  # trees x inner nodes
    reach: float  # the length that all vectors are brought to
    spread: float = 1.0  # of the distances between a query and its neighbours along a plane's normal

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors with their additional component; queries are scaled, which doesn't change their order of answers."""
        if query:
            return np.hstack([x * (self.reach / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.reach**2 - (x * x).sum(axis=1, keepdims=True), 0))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        x, out = self.lifted(x, False), np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("nd,nd->n", x, planes[node]) >= cuts[node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, queries: np.ndarray, most: int) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) of its best leaves, through one queue of all trees."""
        inner, out = (1 << self.depth) - 1, []
        queries = self.lifted(queries, True)
        for q in queries:
            side = self.planes @ q - self.cuts
            low, high = (x.tolist() for x in self.costs(side))
            queue, found = [(0.0, t, 0) for t in range(len(low))], []
            while queue and len(found) < most:
                cost, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append((t, node - inner))
                    continue
                heapq.heappush(queue, (cost + low[t][node], t, 2 * node + 1))
                heapq.heappush(queue, (cost + high[t][node], t, 2 * node + 2))
            out.append(found)
        return out

    def costs(self, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What it costs to go to the low and to the high side of a cut at that distance."""
        z = 1.7 * side / self.spread
        return np.logaddexp(0, z), np.logaddexp(0, -z)

    def margins(self, query: np.ndarray) -> np.ndarray:
        """The cost of the way to each leaf, tree after tree, for one lifted query."""
        low, high = self.costs(self.planes @ query - self.cuts)
        out = np.zeros((len(self.planes), 1))
        for level in range(self.depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            out = np.stack([out + low[:, at], out + high[:, at]], axis=2).reshape(len(low), -1)
        return out.ravel()

    def spread_of(self, queries: np.ndarray, near: list[np.ndarray]) -> float:
        """The root mean square distance between queries and their neighbours along the normals of the trees' first planes."""
        normals = self.planes[:, : min(self.planes.shape[1], 15)].reshape(-1, self.planes.shape[2])
        apart = [((self.lifted(y, False) - q) @ normals.T).ravel() for q, y in zip(self.lifted(queries, True), near)]
        return max(float(np.sqrt(np.mean(np.concatenate(apart) ** 2))), 1e-9) if len(normals) else 1.0

    def needed(self, queries: np.ndarray, near: list[np.ndarray], share: float) -> int:
        """How many leaves each query has to open for that share of all vectors near to the queries to be met."""
        first, trees = [], np.arange(len(self.planes))
        for q, y in zip(self.lifted(queries, True), near):
            order = np.argsort(self.margins(q), kind="stable")  # as in probes()
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            first.append(place[(trees << self.depth) + self.leaves(y)].min(axis=1))
        first = np.sort(np.concatenate(first))
        return int(first[int(np.ceil(share * len(first))) - 1]) + 1


def grown(sample: np.ndarray, depth: int, reach: float, trees: int, seed: int = 17) -> Forest:
    draw, d, inner = np.random.default_rng(seed), sample.shape[1] + 1, (1 << depth) - 1
    forest = Forest(depth, np.zeros((trees, inner, d)), np.zeros((trees, inner)), reach)
    x = forest.lifted(sample, False)
    for t in range(trees):
        rows = [np.arange(len(x))]
        for node in range(inner):
            own = rows[node]
            if len(own) > 1:
                i, j = draw.choice(own, 2, replace=False)
                w = x[i] - x[j]
                forest.planes[t, node] = w / max(np.linalg.norm(w), 1e-12)
            along = x[own] @ forest.planes[t, node]
            forest.cuts[t, node] = np.median(along) if len(own) else 0.0
            high = along >= forest.cuts[t, node]
            rows += [own[~high], own[high]]
    return forest


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array) of the rows that take part."""
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & fine)
    return rows


def entries(rows: DataFrame, dtype: str, k: int) -> DataFrame:
    """v (binary), ids (the k + 1 smallest of its rows, ascending), one row for each distinct vector."""

    def least(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(np.array(v, dtype=dtype).tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array([sorted(set(x))[: k + 1] for x in seen.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    def merged(*keys):
        return lambda df: df.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))

    parts = rows.mapInArrow(least, "v binary, ids array<bigint>")
    return merged("v")(merged("v", "salt")(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))))


def vectors(column, dtype: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, d)


def best_of(q: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row and score of the m best rows of y for each of q; of equal scores the first. A fast product selects, with room for its rounding; the scores are made anew."""
    rough = q @ y.T
    if rough.shape[1] > m:
        room = 8 * q.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(y, axis=1).max()
        at, row = np.nonzero(rough >= (np.partition(rough, -m, axis=1)[:, -m] - room)[:, None])
    else:
        at, row = (x.ravel() for x in np.indices(rough.shape))
    score = np.einsum("nd,nd->n", q[at], y[row])
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < m], row[place < m], score[place < m]


def met(spark, table: DataFrame, distinct: DataFrame, model: Forest, dtype: str, most: int, k: int, block: int) -> DataFrame:
    """query, entry, score: for each leaf that a query opens its k + 1 best rows of each block. table: entry, v, id; distinct: query, v.

    Rows and queries of a cell (tree, leaf, block, part) are brought into one partition, the rows first and in order of id;
    queries then stream past the block.
    """
    trees, depth, d, forest = len(model.planes), model.depth, model.planes.shape[2] - 1, Sent(spark, model)
    n, asked = table.count(), distinct.count()
    parts = max(1, -(-asked * most // (trees << depth) // ASKED))
    blocks = np.ones(trees << depth, dtype=np.int64)

    def leaves_of(batch, column: int) -> np.ndarray:
        return np.arange(trees)[None] << depth | forest.value.leaves(vectors(batch.column(column), dtype, d).astype(np.float64))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(trees << depth, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                sums += np.bincount(leaves_of(batch.slice(at, 2048), 0).ravel(), minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["leaf", "n"])

    if n > block:
        for r in table.select("v").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # a row for each leaf of the forest
            blocks[r["leaf"]] = -(-r["n"] // block)
    first = np.concatenate([[0], np.cumsum(blocks)]) * parts  # the first cell of each leaf
    schema = "cell bigint, side int, no bigint, id bigint, v binary"

    def batch_of(cell, side, no, ids, v):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.full(len(cell), side), pa.int32()), no, ids, v], names=["cell", "side", "no", "id", "v"])

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                leaf = np.repeat(leaves_of(part, 1).ravel(), parts)
                entry = np.repeat(part.column(0).to_numpy(), trees * parts)
                row = pa.array(np.repeat(np.arange(part.num_rows), trees * parts))
                cell = first[leaf] + (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks[leaf] * parts + np.tile(np.arange(parts), part.num_rows * trees)
                yield batch_of(cell, 0, part.column(0).take(row), part.column(2).take(row), part.column(1).take(row))

    def walked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [np.array([t << depth | leaf for t, leaf in f]) for f in forest.value.probes(vectors(part.column(1), dtype, d).astype(np.float64), most)]
                for i, leaf in enumerate(found):
                    no = part.column(0)[i].as_py()
                    cell = np.concatenate([first[x] + np.arange(blocks[x]) * parts for x in leaf]) + no % parts
                    row = pa.array(np.full(len(cell), i))
                    yield batch_of(cell, 1, part.column(0).take(row), pa.nulls(len(cell), pa.int64()), part.column(1).take(row))

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, ids, rows, y = None, [], [], None
        for batch in batches:
            cell, side, no = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])) if len(cell) else []
            for a, b in zip(starts, [*starts[1:], len(cell)]):
                if cell[a] != held:
                    held, ids, rows, y = cell[a], [], [], None
                if side[a] == 0:
                    ids.append(no[a:b])
                    rows.append(vectors(batch.column(4).slice(a, b - a), dtype, d).astype(np.float64))
                elif rows:
                    if y is None:
                        y, entry = np.concatenate(rows), np.concatenate(ids)
                    for at in range(a, b, 256):
                        to = min(b, at + 256)
                        q, row, score = best_of(vectors(batch.column(4).slice(at, to - at), dtype, d).astype(np.float64), y, k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(no[at:to][q]), pa.array(entry[row]), pa.array(score)], names=["query", "entry", "score"])

    sides = table.select("entry", "v", "id").mapInArrow(placed, schema).unionByName(distinct.select("query", "v").mapInArrow(walked, schema))
    return sides.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(meet, "query bigint, entry bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of vectors for each row of queries, without its own id; probes is the least number of opened leaves."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    dtype = "<f4" if kind == "float" else "<f8"
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = usable(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not width:
        return empty
    d = width[0]["d"]
    # an id may stand with several vectors, so an entry has a number of its own
    table = entries(rows.filter(F.size("v") == d), dtype, k)
    table = written(spark, table.select(F.monotonically_increasing_id().alias("entry"), "v", "ids", F.col("ids")[0].alias("id")), "entries")
    n = table.count()
    share = min(1.0, min(sample, SAMPLE_BYTES // (8 * d + 8)) / n)
    chosen = table.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").orderBy("v").toPandas()["v"]
    x = np.array([np.frombuffer(v, dtype=dtype) for v in chosen], dtype=np.float64).reshape(-1, d)

    def lengths(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                y = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype).reshape(-1, d).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((y * y).sum(axis=1)).max())])], names=["length"])

    reach = table.select("v").mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    depth = max(0, min(int(np.ceil(np.log2(max(n / leaf, 1)))), int(np.log2(max(len(x) / LEAST_IN_LEAF, 1))), int(np.log2(max(FOREST_BYTES / (trees * (8 * d + 8)), 1)))))
    model = grown(x, depth, reach, trees)
    block = max(1, min(block, BLOCK_BYTES // (8 * d)))

    asked_rows = usable(queries, id_col, vector_col).filter(F.size("v") == d)

    def flat(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, dtype=dtype).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], names=["query_id", "v"])

    asked = written(spark, asked_rows.mapInArrow(flat, "query_id bigint, v binary").distinct(), "queries")
    distinct = written(spark, asked.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"), "queries")

    def true(batches: Iterator) -> Iterator:
        import pyarrow as pa

        q = np.frombuffer(b"".join(trials), dtype=dtype).reshape(-1, d).astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                v = batch.column(0).slice(at, 4096).to_pylist()
                score = q @ np.frombuffer(b"".join(v), dtype=dtype).reshape(-1, d).astype(np.float64).T
                at_vector = {x: i for i, x in enumerate(v)}
                for i, x in enumerate(trials):
                    if x in at_vector:
                        score[i, at_vector[x]] = -np.inf  # met in any case
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                some = pa.array(np.repeat(np.arange(len(q)), best.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([some, pa.array(v, pa.binary()).take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel())], names=["trial", "v", "score"])

    most = probes
    if probes < trees << depth:
        trials = list(distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(int(min(TRIALS, max(20, TRIAL_BYTES // (8 * d * k))))).toPandas()["v"])
        true_rows = table.select("v").mapInArrow(true, "trial int, v binary, score double").filter(F.col("score") > float("-inf"))
        near = true_rows.withColumn("place", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "v"))).filter(F.col("place") <= k).select("trial", "v").toPandas()
        if len(near):
            of = {t: np.array([np.frombuffer(x, dtype=dtype) for x in g["v"]], dtype=np.float64) for t, g in near.groupby("trial")}
            asked_by = np.array([np.frombuffer(trials[t], dtype=dtype) for t in of], dtype=np.float64)
            model.spread = model.spread_of(asked_by, list(of.values()))
            most = max(probes, model.needed(asked_by, list(of.values()), RECALL))
    scored = met(spark, table, distinct, model, dtype, most, k, block)
    scored = scored.groupBy("query", "entry").agg(F.max("score").alias("score")).join(table.select("entry", "ids"), "entry")
    # per query at most K + 1 rows of each opened block are left
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("place") <= k + 1)
    hits = best.select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id").agg(F.max("score").alias("score"))
    answers = hits.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "id"))), 1, k + 1).alias("best"))
    answers = answers.join(distinct, "query").select("v", "best")
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.join(answers, "v").select("query_id", F.posexplode(own).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.away")).alias("score"))
