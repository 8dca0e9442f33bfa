"""Batches by size as a parallel scan: rows fill a batch in order until it reaches a target, then the next one begins.

Where a batch ends depends on where the one before it ended, so that plain prefix sums do not do. A block of rows is
therefore summed up as what it does to any fill that it may be entered with: the rows that could end the batch that is
open on entry (those within a target's size of the block's start), and for each of them how many batches end in the block
and how full the last one is then. Such transitions compose, GROUP of them at a time and over as many levels as there
have to be; on the way down each block learns its own entry, and all blocks cut their rows at once. A group that holds all
rows is as many tasks as it has blocks; a task holds the sizes of a block, or the transitions of GROUP blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import stored
from ..shipping import ship

BLOCK, GROUP = 1 << 16, 32


@dataclass
class Transition:
    """What a run of rows does to a fill below the target that it is entered with."""

    ends: np.ndarray  # sizes up to each row that may end the first batch, in order
    closed: np.ndarray  # batches that end in the run if that row ends the first
    left: np.ndarray  # and the fill behind the run
    total: int  # size of the run

    def __call__(self, fill: int, target: int) -> tuple[int, int]:
        j = int(np.searchsorted(self.ends, target - fill, "left"))
        return (0, fill + self.total) if j == len(self.ends) else (int(self.closed[j]), int(self.left[j]))

    def then(self, after: Transition, target: int) -> Transition:
        on = [after(int(x), target) for x in self.left]
        closed, left = self.closed + np.array([c for c, _ in on], np.int64), np.array([f for _, f in on], np.int64)
        if self.total >= target:
            return Transition(self.ends, closed, left, self.total + after.total)
        return Transition(np.concatenate([self.ends, after.ends + self.total]), np.concatenate([closed, after.closed]), np.concatenate([left, after.left]), self.total + after.total).cut(target)

    def cut(self, target: int) -> Transition:
        """Without the rows beyond the first that ends even an empty batch."""
        n = int(np.searchsorted(self.ends, target, "left")) + 1
        return Transition(self.ends[:n], self.closed[:n], self.left[:n], self.total)


def transition(sizes: np.ndarray, target: int) -> Transition:
    sums = np.cumsum(sizes)
    n = len(sums)
    follows = np.searchsorted(sums, sums + target, "left")  # the row that ends the batch that begins behind each row
    follows = np.maximum(follows, np.arange(n) + 1)
    closed, left = [0] * (n + 1), [0] * (n + 1)
    total = int(sums[-1]) if n else 0
    for j in range(n - 1, -1, -1):
        k = int(follows[j])
        closed[j], left[j] = (1 + closed[k], left[k]) if k < n else (1, total - int(sums[j]))
    return Transition(sums, np.array(closed[:n], np.int64), np.array(left[:n], np.int64), total).cut(target)


_COLUMNS = "ends array<long>, closed array<long>, left array<long>, total long"


def _rows(found: list[Transition]) -> list[pa.Array]:
    lists = [pa.array([getattr(t, name) for t in found], pa.list_(pa.int64())) for name in ("ends", "closed", "left")]
    return [*lists, pa.array([t.total for t in found], pa.int64())]


def _read(t: pa.Table, order: str) -> list[tuple[int, Transition]]:
    read = lambda name: [np.array(x, np.int64) for x in t.column(name).to_pylist()]
    each = zip(t.column(order).to_pylist(), read("ends"), read("closed"), read("left"), t.column("total").to_pylist(), strict=True)
    return sorted(((i, Transition(*x)) for i, *x in each), key=lambda p: p[0])


def _summed(target: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        sizes = t.column("size").to_numpy()[np.argsort(at)]
        return pa.table([t.column("part").slice(0, 1).combine_chunks(), t.column("block").slice(0, 1).combine_chunks(), t.column("range").slice(0, 1).combine_chunks(), *_rows([transition(sizes, target)])], names=["part", "block", "range", "ends", "closed", "left", "total"])

    return run


def _composed(target: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        parts = [x for _, x in _read(t, "i")]
        whole = parts[0]
        for x in parts[1:]:
            whole = whole.then(x, target)
        return pa.table([t.column("part").slice(0, 1).combine_chunks(), t.column("up").slice(0, 1).combine_chunks(), *_rows([whole])], names=["part", "i", "ends", "closed", "left", "total"])

    return run


def _entered(target: int) -> Callable[[pa.Table], pa.Table]:
    """Entries of the blocks of one group, from that of the group."""

    def run(t: pa.Table) -> pa.Table:
        closed, fill = t.column("before")[0].as_py(), t.column("fill")[0].as_py()
        rows = []
        for i, x in _read(t, "i"):
            rows.append((i, closed, fill))
            ended, fill = x(fill, target)
            closed += ended
        at, before, fills = zip(*rows, strict=True)
        return pa.table([pa.array(t.column("part").slice(0, 1).to_pylist() * len(rows), t.column("part").type), pa.array(at, pa.int64()), pa.array(before, pa.int64()), pa.array(fills, pa.int64())], names=["part", "i", "before", "fill"])

    return run


def _cut(target: int, names: list[str]):
    """Numbers of batches for rows in the order of their blocks, each of which brings its entry along."""

    def run(batches):
        last, number, fill = None, 0, 0
        for b in batches:
            out = []
            for part, block, size, before, entry in zip(*[b.column(c).to_pylist() for c in ("part", "block", "size", "before", "fill")], strict=True):
                if (part, block) != last:
                    last, number, fill = (part, block), before + 1, entry
                out.append(number)
                fill += size
                if fill >= target:
                    number, fill = number + 1, 0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, pa.int64())], [*names, "batch"])

    return run


def fill(df: DataFrame, size: Column, order: list[str], by: Column, target: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """df and batch (long, from 1 within each value of by). Sizes are whole and not negative; null counts as 0."""
    ship(df.sparkSession)
    names = df.columns
    part = F.coalesce(F.concat(F.lit("+"), by.cast("string")), F.lit(""))  # of one type, and null is a value like others
    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], part.alias("part"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.struct(*order).alias("key"), F.monotonically_increasing_id().alias("tie"))
    sort = ["part", "key", "tie"]
    laid = stored(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("key", "tie").withColumn("at", F.monotonically_increasing_id()), "filling")
    laid = laid.withColumn("range", F.shiftrightunsigned("at", 33)).withColumn("block", F.floor(F.col("at") / block).cast("long"))
    kind = f"part string, block long, range long, {_COLUMNS}"
    summed = stored(laid.select("part", "block", "range", "at", "size").groupBy("part", "block").applyInArrow(_summed(target), kind), "filling-blocks")
    places = W.partitionBy("part").orderBy("block")
    levels = [stored(summed.select("part", "block", (F.row_number().over(places) - 1).cast("long").alias("i"), "ends", "closed", "left", "total"), "filling-level")]
    most = levels[0].agg(F.max("i")).first()[0]
    while most:
        up = levels[-1].withColumn("up", F.floor(F.col("i") / group).cast("long"))
        levels.append(stored(up.select("part", "i", "up", "ends", "closed", "left", "total").groupBy("part", "up").applyInArrow(_composed(target), f"part string, i long, {_COLUMNS}"), "filling-level"))
        most //= group
    entries = levels[-1].select("part", "i", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("fill"))
    for level in reversed(levels[:-1]):
        up = level.select("part", "i", "ends", "closed", "left", "total", F.floor(F.col("i") / group).cast("long").alias("up"))
        over = entries.select("part", F.col("i").alias("up"), "before", "fill")
        entries = up.join(over, ["part", "up"]).groupBy("part", "up").applyInArrow(_entered(target), "part string, i long, before long, fill long")
    blocks = entries.join(levels[0].select("part", "i", "block"), ["part", "i"]).drop("i")
    ready = laid.join(blocks, ["part", "block"]).sortWithinPartitions("part", "at")
    held = [f"_{i}" for i in range(len(names))]
    schema = df.select(*[F.col(c).alias(h) for c, h in zip(names, held, strict=True)], F.lit(1).cast("long").alias("batch")).schema
    return ready.mapInArrow(_cut(target, held), schema).toDF(*names, "batch")


def stream(df: DataFrame, size: str, order: list[str], by: str, target: int) -> DataFrame:
    """The same, a group at a time: cut as sorted partitions stream by, none of them held in memory."""
    spark = ship(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = df.select("*", F.lit(1).cast("long").alias("batch")).schema
    names = df.columns

    def run(batches):
        group, number, filled, fresh = object(), 0, 0, True
        for b in batches:
            out = []
            for g, s in zip(b.column(by).to_pylist(), b.column(size).to_pylist(), strict=True):
                if g != group:
                    group, number, filled, fresh = g, 0, 0, True
                if fresh:
                    number, filled, fresh = number + 1, 0, False
                filled += s or 0
                fresh = filled >= target
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*names, "batch"])

    return df.repartition(n, by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def admitted(files: DataFrame, size: str, order: list[str], by: str, free: int, reserve: int) -> DataFrame:
    """files and whether each may be written, in order, while more than the reserve stays free; the first refusal ends it.

    Sizes up to a row are those of its range and the ranges before: a small table of totals, no window over all rows.
    """
    ranges = stored(files.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(by, *order, "_tie").sortWithinPartitions(by, *order, "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "admission")
    ranges = ranges.withColumn("_range", F.shiftrightunsigned("_at", 33))
    totals = ranges.groupBy(by, "_range").agg(F.sum(size).alias("_sum"))
    before = totals.select(by, "_range", F.coalesce(F.sum("_sum").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(size).over(W.partitionBy(by, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = ranges.withColumn("_inside", inside).alias("r").join(before.alias("b"), F.col(f"r.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("r._range") == F.col("b._range")))
    return whole.select(*[F.col(f"r.{c}").alias(c) for c in files.columns], (F.lit(free) - F.col("_before") - F.col("_inside") > reserve).alias("admitted"))
