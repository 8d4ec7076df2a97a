"""Exact deduplication as a stateful stream.

Documents land as slim rows (digest, identifier, locator). A structured stream reads
them; its keyed state lives on disk (RocksDB), never expires, and holds for each digest
the smallest identifier with the locator of that row's content, and the number of rows.
Every digest that was hit more than once is then checked on full bytes: the
contents of its rows are compared as keys of a grouping that combines equal ones before it
shuffles, so a group of any size costs a row for each task. If one digest had two
contents, its rows would be grouped by content.

decided() takes one table. delivered() takes deliveries one after another: the stream goes on from its checkpoint, so a
row meets the state of all deliveries before its own, and the bytes of a hit are read through the locator.

Texts are equal when identical after each run of ASCII white space becomes one space.
A null text counts as empty. The row with the smallest identifier stays; of rows
that repeat an identifier and a text, the first of the landed order; a null identifier comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm.tables import exists, free_name, matched, new_path, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside for each
}
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def digest(text: Column) -> Column:
    return digest_of(content(text))


def landed(docs: DataFrame) -> DataFrame:
    """The slim rows of docs, written once: doc_id, text_sha256 and the locator of the content."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(F.col("text")).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row_no"),
        F.input_file_name().alias("file"),
    )
    return written(docs.sparkSession, rows, "landed")


def keepers(stream: DataFrame) -> DataFrame:
    """The stream's state by digest; the stream has the columns of landed(), or of a delivery."""
    last = F.col("doc_id").isNull().alias("last")
    place = ["delivery", last, "doc_id", "row_no"] if "delivery" in stream.columns else [last, "doc_id", "row_no", "file"]
    first = F.min(F.struct(*place)).alias("keeper")
    return stream.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, files_per_batch: int | None = None) -> list[int]:
    """Run the stream over all that has landed since its checkpoint. Each batch writes the state after it of the digests that it hit; their numbers."""
    batches: list[int] = []
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same again after a failure
            batches.append(number)

        query = keepers(source.parquet(landing)).writeStream.outputMode("update").foreachBatch(save)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return batches


def streamed_state(spark: SparkSession, landing: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The final state of a stream over all that has landed: text_sha256, keeper, group_size."""
    out = new_path(spark, "state")
    batches = run_stream(spark, landing, schema, out, new_path(spark, "stream"), files_per_batch)
    kind = "text_sha256 string, keeper struct<last: boolean, doc_id: bigint, row_no: bigint, file: string>, group_size bigint"
    if not batches:  # nothing has landed
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).parquet(f"{out}/batch=*")
    if len(set(batches)) > 1:
        rows = written(spark, rows.groupBy("text_sha256").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size")), "state")
    return rows


def decided(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = landed(docs)
    state = streamed_state(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema, files_per_batch) if rows.inputFiles() else None
    if state is None:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = written(spark, state.filter("group_size > 1"), "hits")
    n_hits = hits.count()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content(F.col("text")).alias("content")).withColumn("text_sha256", digest_of(F.col("content")))
    again = matched(texts, hits.select("text_sha256"), ["text_sha256"], "left_semi", n_hits)
    contents = again.groupBy("text_sha256", "content").agg(F.count(F.lit(1)).alias("n"))
    clashes = written(spark, contents.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"), "clashes")
    out = matched(rows, hits, ["text_sha256"], "left", n_hits).select(
        "doc_id",
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keeper.row_no") == F.col("row_no"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    n_clashes = clashes.count()
    if n_clashes:  # one digest of different bytes: by content then
        apart = written(spark, matched(texts, clashes, ["text_sha256"], "left_semi", n_clashes).withColumn("row_no", F.monotonically_increasing_id()), "apart")
        first = apart.groupBy("text_sha256", "content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        split = apart.join(first, ["text_sha256", "content"]).select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("keeper.row_no") == F.col("row_no")).alias("kept"), "text_sha256")
        out = matched(out, clashes, ["text_sha256"], "left_anti", n_clashes).unionByName(split)
    return out.select(*COLUMNS)


SLIM = "delivery bigint, doc_id bigint, row_no bigint, text_sha256 string"


def delivered(docs: DataFrame, store: str, delivery: int, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of a delivery, decided after all deliveries before it: the columns of decided().

    store is a folder that executors share. It holds the landed rows with their contents, the stream's checkpoint and the
    states it wrote. Numbers of deliveries rise. Of equal texts the row of the first delivery stays, there that with the smallest
    doc_id (a null one comes last); keep_id names it and group_size counts the rows of all deliveries so far.
    A delivery that has landed whole isn't landed again, so a call that was lost can be repeated. An empty delivery has no rows.
    """
    spark, landing = docs.sparkSession, f"{store.rstrip('/')}/landing"
    here, full, state = f"{landing}/d{int(delivery)}", f"{SLIM}, content string", f"{store.rstrip('/')}/state"
    if not exists(spark, f"{here}/_SUCCESS"):
        rows = docs.select(F.lit(int(delivery)).cast("bigint").alias("delivery"), F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), content(F.col("text")).alias("content"))
        rows.withColumn("text_sha256", digest_of(F.col("content"))).write.mode("overwrite").parquet(here)
    run_stream(spark, f"{landing}/*", SLIM, state, f"{store.rstrip('/')}/stream", files_per_batch)
    mine = spark.read.schema(full).parquet(here)
    if not exists(spark, state):
        return mine.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    kind = "text_sha256 string, keeper struct<delivery: bigint, last: boolean, doc_id: bigint, row_no: bigint>, group_size bigint"
    own = mine.select("text_sha256").distinct()
    states = spark.read.schema(kind).parquet(f"{state}/batch=*").join(own, "text_sha256", "left_semi")
    hits = written(spark, states.groupBy("text_sha256").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size")).filter("group_size > 1"), "hits")
    n_hits = hits.count()
    place = ["text_sha256", "delivery", "row_no"]
    located = written(spark, hits.select("text_sha256", "keeper.delivery", "keeper.row_no"), "located")
    numbers = [r.delivery for r in located.select("delivery").distinct().collect()]  # deliveries, not rows
    contents = mine.limit(0) if not numbers else spark.read.schema(full).parquet(*(f"{landing}/d{n}" for n in numbers))
    firsts = matched(contents, located, place, "left_semi", n_hits).select("text_sha256", "content")
    again = matched(mine.select("text_sha256", "content"), hits.select("text_sha256"), ["text_sha256"], "left_semi", n_hits)
    different = again.unionByName(firsts).groupBy("text_sha256", "content").agg(F.count(F.lit(1)).alias("n"))
    clashes = written(spark, different.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("text_sha256"), "clashes")
    n_clashes = clashes.count()

    def answered(rows: DataFrame) -> DataFrame:
        stays = (F.col("keeper.delivery") == F.col("delivery")) & (F.col("keeper.row_no") == F.col("row_no"))
        keep = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
        return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(stays, F.lit(True)).alias("kept"), "text_sha256")

    slim = mine.select("delivery", "doc_id", "row_no", "text_sha256")
    out = answered(matched(slim, hits, ["text_sha256"], "left", n_hits))
    if n_clashes:  # one digest of different bytes: by content then, over all deliveries
        apart = matched(spark.read.schema(full).parquet(f"{landing}/*"), clashes, ["text_sha256"], "left_semi", n_clashes)
        first = F.min(F.struct("delivery", F.col("doc_id").isNull().alias("last"), "doc_id", "row_no")).alias("keeper")
        by_content = apart.groupBy("text_sha256", "content").agg(first, F.count(F.lit(1)).alias("group_size"))
        split = matched(mine, clashes, ["text_sha256"], "left_semi", n_clashes).join(by_content, ["text_sha256", "content"])
        out = matched(out, clashes, ["text_sha256"], "left_anti", n_clashes).unionByName(answered(split))
    return out.select(*COLUMNS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    spark = docs.sparkSession
    dropped = written(spark, decided(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"), F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_digest")), "dropped")
    others = dropped.filter(~F.col("_dropped").eqNullSafe(F.col("_keep"))).select("_dropped", "_digest").distinct()
    repeats = dropped.filter(F.col("_dropped").eqNullSafe(F.col("_keep"))).select("_dropped", "_digest").distinct()
    n = dropped.count()
    # a null identifier is dropped only after another, and joins on null match nothing: a stand-in takes its place
    key_of = lambda doc, text: F.struct(doc.isNull().alias("n"), F.coalesce(doc, F.lit(0)).alias("i"), text.alias("d"))
    name = free_name(docs, "_key")
    named = lambda df: df.select(key_of(F.col("_dropped"), F.col("_digest")).alias(name))
    kept = matched(docs.withColumn(name, key_of(F.col("doc_id").cast("bigint"), digest(F.col("text")))), named(others), [name], "left_anti", n)
    if not repeats.isEmpty():
        again = named(repeats)
        once = matched(kept, again, [name], "left_semi", n).dropDuplicates([name])
        kept = matched(kept, again, [name], "left_anti", n).unionByName(once)
    return kept.drop(name)
