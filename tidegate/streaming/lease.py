"""Leasing by load: commands are taken from an inbox, a message at a time, while the queue has room for them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import queue
from .runner import VersionedTable


def room(commands: DataFrame | None, now: Column, capacity: int) -> int:
    """How many more commands may be leased: the capacity less what is ready and not yet claimed."""
    return capacity if commands is None else capacity - queue.ready_count(commands, now, now).first().ready


def lease_stream(
    spark: SparkSession, inbox: str, schema: T.StructType, table: VersionedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame], now: Column, capacity: int, checkpoint: str, poll_seconds: float = 1.0, wait: Callable[[float], None] = time.sleep, may_lease: Callable[[], bool] = lambda: True
):
    """Start taking messages (files of the inbox) into the table, one in a micro-batch, first in first out.

    A micro-batch is not begun while the queue is full or leasing is gated: the stream itself holds back, nothing is taken
    that nobody has room for, and what was not taken stays in the inbox. Versions of the table are batch ids, so that a
    message that comes again after a stop is not taken twice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= table.version():
            return
        while not may_lease() or room(table.read(), now, capacity) <= 0:
            wait(poll_seconds)
        table.publish(merge(table.read(), batch), batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(inbox)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
