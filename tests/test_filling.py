import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import extraction as ex
from tidegate.operators import filling


def slow(rows, target):
    """rows (group, order, id, size) to {id: batch}."""
    out, group, number, filled = {}, object(), 0, 0
    for g, _, i, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if g != group:
            group, number, filled = g, 1, 0
        out[i] = number
        filled += s or 0
        if filled >= target:
            number, filled = number + 1, 0
    return out


def cases():
    rng = random.Random(2)
    rows = [("hot", rng.randrange(900), i, rng.choice([0, 1, 5, 50, None])) for i in range(4000)]
    rows += [(rng.choice(["a", None, "é"]), rng.randrange(50), 4000 + i, rng.choice([3, 400, 99, 100, 101])) for i in range(300)]
    return rows + [("one", 1, 5000, 7), ("big", 1, 5001, 10**12), ("big", 2, 5002, 1)]


@pytest.mark.parametrize(("block", "group", "target"), [(64, 3, 100), (7, 2, 1), (1000, 32, 100), (1 << 16, 32, 5000), (16, 4, 10**6)])
def test_blocks_give_the_batches_of_a_fold(spark, block, group, target):
    rows = cases()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, o long, i long, s long, part string, block long")
    out = filling.fill(df, F.col("s"), ["o", "i"], F.col("g"), target, block, group)
    assert out.columns == [*df.columns, "batch"]
    assert {r.i: r.batch for r in out.collect()} == slow(rows, target)
    assert filling.fill(df.limit(0), F.col("s"), ["o"], F.col("g"), target, block, group).count() == 0


def test_one_hot_group_is_many_tasks(spark):
    """A group that holds all rows, and more tasks than groups with rows to cut."""
    df = spark.range(20_000).select(F.lit("all").alias("g"), "id", F.lit(10).alias("s")).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = filling.fill(df, F.col("s"), ["id"], F.col("g"), 95, 500, 4)
        assert out.filter("batch > 0").groupBy(F.spark_partition_id()).count().count() > 1
        assert out.filter("batch <> floor(id / 10) + 1").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_both_plans_agree(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "g string, o long, i long, s long")
    few, many = (ex.greedy_batches(df, "s", ["o", "i"], "g", 100, n) for n in (10**9, 100))
    assert {r.i: r.batch for r in few.collect()} == {r.i: r.batch for r in many.collect()} == slow(rows, 100)


def test_transitions_compose():
    rng = np.random.default_rng(1)
    for _ in range(200):
        target = int(rng.integers(1, 30))
        sizes = rng.integers(0, 20, int(rng.integers(1, 40)))
        cut = int(rng.integers(0, len(sizes)))
        whole = filling.transition(sizes, target)
        parts = filling.transition(sizes[:cut], target).then(filling.transition(sizes[cut:], target), target) if cut else whole
        for fill in range(target):
            closed, now = 0, fill
            for s in sizes:
                now += int(s)
                if now >= target:
                    closed, now = closed + 1, 0
            assert whole(fill, target) == parts(fill, target) == (closed, now)


def test_admission_ends_at_the_first_refusal(spark):
    rows = [("a", i, s) for i, s in enumerate([30, 30, 30, 1])] + [("b", 0, 89), ("b", 1, 1), (None, 0, 90), (None, 1, 0)]
    df = spark.createDataFrame(rows, "d string, o int, s long")
    got = filling.admitted(df, "s", ["o"], "d", 100, 10).collect()
    assert {(r.d, r.o) for r in got if r.admitted} == {("a", 0), ("a", 1), ("b", 0)} and len(got) == len(rows)
