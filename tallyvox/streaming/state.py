"""What the keyed state of this package's streams needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

#: Typed state with timers stands in RocksDB; changes alone are written at each checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside for each
}


def on_disk(spark: SparkSession) -> None:
    """Set STATE in the session, from which a query takes it when it is started."""
    for key, value in STATE.items():
        spark.conf.set(key, value)


def mode_of(idle_ms: int | None, clock: str | None) -> str:
    """The time mode of a stream whose timers end what has been idle for idle_ms."""
    return "None" if idle_ms is None else "ProcessingTime" if clock is None else "EventTime"


def clocked(rows: DataFrame, columns: Sequence[str], clock: str | None) -> DataFrame:
    """The columns, the milliseconds of a timestamp column as `clock` (0 where there is none) and, for the watermark, that column itself."""
    at = F.coalesce(F.unix_millis(F.col(clock)), F.lit(0)) if clock else F.lit(0)
    return rows.select(*columns, at.cast("bigint").alias("clock"), *([F.col(clock).alias("event_time")] if clock else []))


def watch(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The group's only timer from now on; None: it has none."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    if at is not None:
        handle.registerTimer(at)
