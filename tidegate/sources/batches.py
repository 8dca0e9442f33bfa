"""Batch files: envelopes as gzipped NDJSON, one manifest row for each file, checksums that can be taken again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(envelopes: DataFrame, path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Write a directory of NDJSON files, null fields included; an empty table gives one empty file. Returns manifest().

    Spark's committer renames whole attempts into place: a reader never sees half a file.
    """
    envelopes.write.option("compression", "gzip").option("ignoreNullFields", "false").option("maxRecordsPerFile", rows_per_file).json(path)
    return manifest(envelopes.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, compressed_size, sha256 (base64, of the compressed file). Files are bounded by the writer's rows_per_file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("compressed_size"), F.base64(F.unhex(F.sha2("content", 256))).alias("sha256"))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, row_count, uncompressed_size of what the files hold."""
    text = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file"), "value")
    return text.groupBy("file").agg(F.count("*").alias("row_count"), F.sum(F.octet_length("value") + 1).alias("uncompressed_size"))


def mismatches(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose stored checksum is not the one taken now, or that are gone."""
    return stored.join(now.select("file", F.col("sha256").alias("now")), "file", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("file", "sha256", "now")


def admit(free_bytes: int, projected_bytes: int, reserve_bytes: int) -> bool:
    """Whether a write may begin: what is left must stay above the reserve."""
    return free_bytes - projected_bytes > reserve_bytes


def read(spark: SparkSession, path: str, data_schema: str) -> DataFrame:
    return spark.read.schema(f"sourceId string, sourceUpdatedAt string, deleted boolean, data struct<{data_schema}>").json(path)
