"""Written tables in the cluster's shared folder, free column names, and joins whose broadcast is behind a size check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many rows and bytes; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("tallyvox.own.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyvox-")
        spark.conf.set("tallyvox.own.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read from there.

    This cuts the lineage and survives the loss of any executor.
    """
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_slim(small: DataFrame, rows: int | None = None) -> bool:
    """Whether a written table is proven to be within BROADCAST_ROWS and BROADCAST_BYTES; bytes are counted where a column has no fixed width."""
    rows = small.count() if rows is None else rows
    loose = [f.name for f in small.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    if rows > BROADCAST_ROWS or not loose:
        return rows <= BROADCAST_ROWS
    return (small.agg(F.sum(F.octet_length(F.to_json(F.struct(*loose))))).first()[0] or 0) <= BROADCAST_BYTES


def matched(left: DataFrame, small: DataFrame, on: Sequence[str], how: str, rows: int | None = None) -> DataFrame:
    """left joined with small (a written table) in the given way: small is broadcast only if it is proven slim, else both sides are shuffled by the keys."""
    return left.join(F.broadcast(small) if is_slim(small, rows) else small, list(on), how)
