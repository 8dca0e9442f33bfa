"""Keyed state of streams: a clock for each entity, and the head of each ordering key. State lives in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """State of any size on the executors' disks, its changes in the checkpoint."""
    ship(spark).conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Clock(StatefulProcessor):
    """Times that rise by one at least from run to run of an entity, and never lie before the run's own version.

    A run that comes again, or after a later one, is past and changes nothing: what was given out once stands.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run_id long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, at = self.last.get() if self.last.exists() else (None, None)
        given = pd.concat(list(rows)).sort_values(["run_id", "version"], kind="stable").drop_duplicates("run_id")
        out = []
        for run, version in zip(given["run_id"].tolist(), given["version"].tolist(), strict=True):
            if seen is not None and run <= seen:
                continue
            at = version if at is None else max(at + 1, version)
            seen = run
            out.append((run, key[0], version, at))
        if out:
            self.last.update((seen, at))
            yield pd.DataFrame(out, columns=["run_id", "entity_name", "version", "snapshot_at"])

    def close(self) -> None:
        pass


def snapshot_clock(runs: DataFrame) -> DataFrame:
    """run_id, entity_name, version, snapshot_at of a stream of runs (run_id, entity_name, version)."""
    use_rocksdb(runs.sparkSession)
    return runs.select("run_id", "entity_name", "version").groupBy("entity_name").transformWithStateInPandas(Clock(), "run_id long, entity_name string, version long, snapshot_at long", "Append", "None")


CLOSED = ("completed", "cancelled", "expired", "dead_letter")


class Heads(StatefulProcessor):
    """The first open command of an ordering key, whenever it is another than before.

    Open commands of the key are a map, so that a change of one of them reads and writes that one; only when the head
    itself closes are the key's open commands looked through for the next.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "command_id long", "received_at timestamp, queue_sequence long")
        self.head = handle.getValueState("head", "command_id long, received_at timestamp, queue_sequence long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = tuple(self.head.get()) if self.head.exists() else None
        before = head
        for row in pd.concat(list(rows)).sort_values("change_no", kind="stable").itertuples(index=False):
            place = (row.received_at, row.queue_sequence)
            if row.status in CLOSED:
                self.open.removeKey((row.command_id,))
                if head and head[0] == row.command_id:
                    head = min(((k[0], *v) for k, v in self.open.iterator()), key=lambda x: (x[1], x[2], x[0]), default=None)
            else:
                self.open.updateValue((row.command_id,), place)
                if head is None or (*place, row.command_id) < (*head[1:], head[0]):
                    head = (row.command_id, *place)
        if head != before:
            if head:
                self.head.update(head)
            else:
                self.head.clear()
            yield pd.DataFrame([(key[0], head[0] if head else None)], columns=["ordering_key", "command_id"]).astype({"command_id": "Int64"})

    def close(self) -> None:
        pass


def key_heads(changes: DataFrame) -> DataFrame:
    """ordering_key, command_id (null: none is open) whenever a key's head changes.

    changes: ordering_key, command_id, received_at, queue_sequence, status, change_no (the order of changes within a key).
    """
    use_rocksdb(changes.sparkSession)
    kind = dict(changes.dtypes)["ordering_key"]
    return changes.filter("ordering_key is not null").groupBy("ordering_key").transformWithStateInPandas(Heads(), f"ordering_key {kind}, command_id long", "Update", "None")
