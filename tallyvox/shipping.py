"""Objects sent to Python workers whole, with the code of their classes, so executors need no copy of this package."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Sent:
    """A broadcast of a pickled object; a worker process unpickles it once and keeps the last one."""

    def __init__(self, spark: SparkSession, obj: object):
        # a plain broadcast would pickle classes by their module's name
        self.held, self.key = spark.sparkContext.broadcast(cloudpickle.dumps(obj)), uuid.uuid4().hex

    @property
    def value(self) -> object:
        slot = sys.modules.setdefault("_tallyvox_sent", types.ModuleType("_tallyvox_sent"))
        if getattr(slot, "key", None) != self.key:
            slot.key, slot.value = None, None  # the old one goes before the new one is made
            slot.value = cloudpickle.loads(self.held.value)
            slot.key = self.key
        return slot.value
