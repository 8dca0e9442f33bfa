"""Streams with state against the batch operators on the same rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidegate.operators import queue as q
from tidegate.operators import runs as r
from tidegate.streaming import lease, runner, state

T0 = dt.datetime(2024, 1, 1)


def drain(df, path, out, mode):
    """All that a stream gives out until its input ends, kept as Parquet."""

    def each(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_clock_of_a_stream_is_the_batch_clock(spark, tmp_path):
    rng = random.Random(3)
    kind = "run_id long, entity_name string, version long"
    rows = [(i, rng.choice("abc"), rng.randrange(60)) for i in range(120)]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(0, 120, 40):  # runs arrive in order, files out of order within; the last file repeats an earlier one
        spark.createDataFrame(rng.sample(rows[k : k + 40], 40), kind).coalesce(1).write.mode("append").parquet(src)
        stream = state.snapshot_clock(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src))
        drain(stream, cp, out, "append")
    want = {(x.run_id, x.entity_name): x.snapshot_at for x in r.snapshot_clock(configs=spark.createDataFrame(rows, kind)).collect()}
    got = [((x.run_id, x.entity_name), x.snapshot_at) for x in spark.read.parquet(out).collect()]
    assert len(got) == len(rows) and dict(got) == want
    spark.createDataFrame(rows[40:60], kind).coalesce(1).write.mode("append").parquet(src)  # comes again
    drain(state.snapshot_clock(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)), cp, out, "append")
    assert spark.read.parquet(out).count() == len(rows)


def test_heads_of_a_stream_are_the_batch_heads(spark, tmp_path):
    rng = random.Random(8)
    kind = "ordering_key string, command_id long, received_at timestamp, queue_sequence long, status string, change_no long"
    commands = [(rng.choice(["a", "b", "c", None]), i, T0 + dt.timedelta(minutes=rng.randrange(30)), i) for i in range(40)]
    changes, status = [], {}
    for n in range(160):
        c = rng.choice(commands)
        status[c[1]] = rng.choice(["queued", "executing", "completed", "completed", "dead_letter"])
        changes.append((*c, status[c[1]], n))
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(0, 160, 40):
        spark.createDataFrame(changes[k : k + 40], kind).coalesce(1).write.mode("append").parquet(src)
        drain(state.key_heads(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)), cp, out, "update")
        now = {i: s for _, i, _, _, s, _ in changes[: k + 40]}
        rows = [(o, i, t, n, now[i]) for o, i, t, n in commands if i in now]
        heads = q.heads(spark.createDataFrame(rows, "ordering_key string, command_id long, received_at timestamp, queue_sequence long, status string"))
        want = {x.ordering_key: x.head.queue_sequence for x in heads.collect()}
        last = spark.read.parquet(out).groupBy("ordering_key").agg(F.max_by(F.struct("command_id"), "batch_id").alias("x"))
        assert {x.ordering_key: x.x.command_id for x in last.collect() if x.x.command_id is not None} == want


COMMAND = "command_id long, ordering_key string, received_at timestamp_ntz, queue_sequence long, status string, attempt_count int, post_attempt_count int, first_sent_at timestamp_ntz, not_before timestamp_ntz, next_attempt_at timestamp_ntz, exec_claim_owner_id string, exec_claim_acquired_at timestamp_ntz"


def command(i, status="queued"):
    return (i, None, T0 + dt.timedelta(minutes=i), i, status, 0, 0, None, None, None, None, None)


def test_a_slow_consumer_holds_leasing_back(spark, tmp_path):
    """Ten messages, room for three: no more are ever ready, none is lost or taken twice, and while leasing is gated none is taken."""
    src = str(tmp_path / "in")
    for i in range(10):
        spark.createDataFrame([command(i)], COMMAND).coalesce(1).write.mode("append").parquet(src)
    table = runner.VersionedTable(spark, str(tmp_path / "table"))
    schema = spark.createDataFrame([command(0)], COMMAND).schema
    now = F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz")
    done, waits, most, gated = set(), [], [], [True, True]

    def as_consumed(df):
        return df.withColumn("status", F.when(F.col("command_id").isin(*done), "completed").otherwise(F.col("status"))) if done else df

    class Consumed(runner.VersionedTable):
        def read(self):
            df = super().read()
            return None if df is None else as_consumed(df)

    table = Consumed(spark, str(tmp_path / "table"))

    def consume(seconds):
        """While the stream waits, the consumer finishes the oldest ready command."""
        waits.append(seconds)
        if gated:
            gated.pop()
            return
        most.append(q.ready_count(table.read(), now, now).first().ready)
        done.add(min(x.command_id for x in q.ready(table.read(), now, now).collect()))

    def may_lease():
        return not gated

    def merge(current, fresh):
        return fresh if current is None else current.unionByName(fresh)

    query = lease.lease_stream(spark, src, schema, table, merge, now, 3, str(tmp_path / "cp"), 0.5, consume, may_lease)
    query.awaitTermination()
    assert sorted(x.command_id for x in table.read().collect()) == list(range(10))
    assert max(most) == 3 and len(most) == 7 and waits.count(0.5) == 9
    assert lease.room(table.read(), now, 3) == 0 and lease.room(None, now, 3) == 3
    again = lease.lease_stream(spark, src, schema, table, merge, now, 3, str(tmp_path / "cp"), 0.5, consume, may_lease)
    again.awaitTermination()
    assert table.read().count() == 10
