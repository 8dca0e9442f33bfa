"""Streaming: new files of an entity are taken in, deduplicated by key, and merged into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that of the largest order; a re-read overlap thus changes nothing. Combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("_row")).select(*keys, "_row.*").select(df.columns)


def merge(current: DataFrame | None, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    return newest(fresh if current is None else current.unionByName(fresh), keys, order)


class VersionedTable:
    """A directory of versions, each with a pointer of its own that is renamed into place last.

    Nothing is ever overwritten or deleted before its successor is there: the version is the largest that has a pointer, so
    readers see whole versions only, and a batch that comes again after a crash finds the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        at = self.fs_path(f"{self.path}/_pointers")
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return max((int(x.getPath().getName()) for x in found if x.getPath().getName().isdigit()), default=-1)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v < 0 else self.spark.read.parquet(f"{self.path}/v={v}")

    def publish(self, df: DataFrame, version: int) -> None:
        if version <= self.version():
            return
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")  # no pointer names it yet
        self.point(version)

    def point(self, version: int) -> None:
        folder = f"{self.path}/_pointers"
        self.fs.mkdirs(self.fs_path(folder))
        new = self.fs_path(f"{folder}/_new-{version}")
        self.fs.create(new, True).close()
        self.fs.rename(new, self.fs_path(f"{folder}/{version}"))


def upsert_stream(spark: SparkSession, source: str, schema: T.StructType, table: VersionedTable, keys: list[str], order: str, checkpoint: str, files_per_trigger: int = 16):
    """Take in all files that are there, in micro-batches, and stop. Batch ids are the versions: exactly once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id > table.version():
            table.publish(merge(table.read(), batch, keys, order), batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()


def late_counts(events: DataFrame, time: str, by: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by window under a watermark; of a batch table, plain windowed counts."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")
