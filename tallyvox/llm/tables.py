"""What the operators share: written tables and checked broadcasts of the core, and what a Python worker keeps."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyvox.tables import BROADCAST_BYTES, BROADCAST_ROWS, exists, free_name, is_slim, matched, new_path, shared_dir, written

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "exists", "free_name", "is_slim", "kept", "let_go", "matched", "new_path", "shared_dir", "written"]


def let_go(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more, and have Spark delete the shuffle files of what is finished.

    Spark does so when the driver collects garbage, which a driver with little to do may put off until the disks are full.
    """
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What a reused Python worker keeps from task to task: one thing at a time, made anew for another kind or key."""
    slot = sys.modules.setdefault("_tallyvox_kept", types.ModuleType("_tallyvox_kept"))
    if getattr(slot, "kind", None) != (kind, key):
        slot.kind, slot.value = None, None  # the old one goes before the new one is made
        slot.value = make()
        slot.kind = (kind, key)
    return slot.value
