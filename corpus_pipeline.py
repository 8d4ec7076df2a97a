"""A corpus pipeline: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import exact_dedup, langid, minhash, packing
from tallyvox.llm.queries import packing_digest
from tallyvox.llm.tables import free_name, written

#: A document goes only if its language can't be told at all, or is ambiguous with less than this score.
LEAST_SCORE = 0.4
#: Rows of one Arrow batch on the way to a Python worker and back; Spark's own 10,000 whole texts take tens of megabytes on both sides.
BATCH_KEY, BATCH_ROWS, SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000, 10_000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless it has a number of its own."""
    if int(spark.conf.get(BATCH_KEY)) == SPARKS_OWN:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; those without a letter, in no learned language or ambiguous with a low score go."""
    bounded_batches(spark)
    of = free_name(docs, "_language")
    found = langid.identified(docs, to=of)
    sure = (F.col(f"{of}.lang_pred") != langid.UNDETERMINED) & ~(F.col(f"{of}.ambiguous") & (F.col(f"{of}.score") < LEAST_SCORE))
    return found.filter(sure).drop(of)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    bounded_batches(spark)
    return minhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece."""
    bounded_batches(spark)
    return packing_digest(packing.packed(docs))


STAGES = [("language", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", pack)]

#: Language codes, near copies and packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
