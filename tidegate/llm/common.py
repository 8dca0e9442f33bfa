"""Shared parts of the training-data operators: words, storage of intermediates, unions of links."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space; Python's bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new local one if Spark itself is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidegate-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    What no drop() deletes, since a lazy result still reads it, goes when the driver's JVM ends, or with its scratch().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    for held in _scratch:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path), path


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is materialized within: for a result that has been written elsewhere by the end."""
    held: list[str] = []
    _scratch.append(held)
    try:
        yield
    finally:
        _scratch.remove(held)
        drop(spark, *held)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow, after which the worker gives its memory back: workers outlive tasks, and their parts of an executor add up."""

    def tidy(batches):
        yield from run(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates that no later step reads."""
    for path in paths:
        where, fs = _path(spark, path)
        fs.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(col: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo modulus; null ids count as the text ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


class Vocabulary(dict):
    """Local number of each distinct word seen so far; self.words lists them in that order."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def pack(x: np.ndarray) -> bytes:
    """An array as bytes: length, then its bytes by significance, compressed. Small numbers of a wide type cost little."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each start s and length n."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def components(links: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b: long): root is the smallest node reachable.

    Alternating large-star and small-star steps over edge tables; each round is written to the shared folder,
    so that neither the driver nor one task ever holds a component. A node's neighbours are reduced by min() with
    map-side combination, so a hub costs no task more than its share.
    """
    spark = links.sparkSession
    edges, path = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{label}-edges")
    for _ in range(rounds):
        # large star: every larger neighbour of a node moves to the least of the node's neighbourhood
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, moves to the least of them
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        after, new_path = materialize(small, f"{label}-edges")
        # a star forest: no node that is a parent has a parent
        settled = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty()
        drop(spark, path)
        edges, path = after, new_path
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
