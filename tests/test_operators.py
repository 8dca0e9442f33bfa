import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidegate.operators import extraction as ex
from tidegate.operators import queue as q
from tidegate.operators import runs
from tidegate.operators import verification as v


def digest(keys):
    total = sum(int.from_bytes(hashlib.sha256("".join(k + "\x1f" for k in row).encode()).digest()[:16], "big") for row in keys)
    return f"{total % 2**128:032X}"


def test_key_digest(spark):
    rng = random.Random(1)
    rows = [(str(rng.randrange(50)), str(rng.randrange(9))) for _ in range(500)]
    of = lambda r: v.key_digest(spark.createDataFrame(r, "a string, b string"), [F.col("a"), F.col("b")]).first()
    got = of(rows)
    assert (got.digest, got.n) == (digest(rows), 500)
    assert of(rows[::-1]).digest == got.digest
    assert of(rows[1:]).digest != got.digest and of([*rows, rows[0]]).digest != got.digest
    assert of([("1", "2")]).digest != of([("12", "")]).digest
    empty = v.key_digest(spark.createDataFrame([], "a string"), [F.col("a")]).first()
    assert (empty.digest, empty.n) == ("0" * 32, 0)


def test_verdict_order(spark):
    rows = [
        (None, None, 3, 3, 3, 3, "A", "A", "verified"),
        ("KEY_MISSING", "KEY_PASS_FAILED", 3, 4, 3, 3, "A", "B", "KEY_MISSING"),
        (None, "KEY_PASS_FAILED", 3, 4, 3, 3, "A", "B", "KEY_PASS_FAILED"),
        (None, None, 3, None, 3, 3, "A", "A", "COUNT_FAILED"),
        (None, None, 3, 4, 9, 9, "A", "B", "COUNT_CHANGED"),
        (None, None, 3, 3, 9, 9, "A", "B", "ROWS_NOT_EQUAL_COUNT"),
        (None, None, 3, 3, 3, 9, "A", "B", "KEY_PASS_COUNT_MISMATCH"),
        (None, None, 3, 3, 3, 3, "A", "B", "KEY_SET_MISMATCH"),
    ]
    df = spark.createDataFrame(rows, "f string, kf string, cb long, ca long, r long, k long, rd string, kd string, want string")
    got = df.select("want", v.verdict(*map(F.col, ("f", "kf", "cb", "ca", "r", "k", "rd", "kd"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_source_ids_and_envelope(spark):
    df = spark.createDataFrame([("R\"1", 1, "D", True, None), ("é", 2, "E", None, dt.datetime(2026, 1, 1))], "a string, b long, c string, gone boolean, ts timestamp_ntz")
    assert [r[0] for r in df.select(ex.source_id(df, ("a", "b", "c"))).collect()] == ['["R\\"1",1,"D"]', '["é",2,"E"]']
    assert [r[0] for r in df.select(ex.source_id(df, ("b",))).collect()] == ["1", "2"]
    e = ex.Entity("e", "e", ("b",), ("a",), updated_at="ts", deleted="gone")
    assert [(r.deleted, r.sourceUpdatedAt) for r in ex.envelope(df, e).collect()] == [(True, None), (False, dt.datetime(2026, 1, 1))]
    assert e.columns() == ["a", "b", "gone", "ts"]
    with pytest.raises(Exception, match="missing"):
        nulls = spark.createDataFrame([(None,)], "a string")
        nulls.select(ex.source_id(nulls, ("a",))).collect()


@pytest.mark.parametrize("change", [{"path": "a/b"}, {"keys": ()}, {"page_size": 0}, {"filter": " "}, {"filter": "x" * 513}, {"filter": "a\nb"}, {"select": ("a b",)}])
def test_entities_are_validated(change):
    ok = {"code": "e", "path": "Set/Balance(Dimensions='a,b')", "keys": ("k",), "select": ("a",)}
    assert not ex.Entity(**ok).problems()
    assert ex.Entity(**ok | change).problems()


def test_static_filter_cannot_open_the_window(spark):
    df = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 3)), (3, dt.datetime(2026, 1, 5))], "k long, ts timestamp_ntz")
    e = ex.Entity("e", "e", ("k",), ("k",), updated_at="ts", filter="k = 1 or k = 2", overlap_minutes=0)
    assert [r.k for r in ex.scan(df, e, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 4)).collect()] == [2]


def test_greedy_batches(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(1, 50)) for g in "abc" for i in range(rng.choice([1, 30, 200]))]
    want = {}
    for g in "abc":
        n, filled = 1, 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if filled >= 100:
                n, filled = n + 1, 0
            filled += s
            want[g, i] = n
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, size long")
    assert {(r.g, r.i): r.batch for r in ex.greedy_batches(df, "size", ["i"], "g", 100).collect()} == want


def test_ready_against_brute_force(spark):
    rng = random.Random(3)
    now = dt.datetime(2026, 1, 10)
    rows = []
    for i in range(400):
        rows.append((i, rng.choice([None, *range(12)]), now - dt.timedelta(hours=rng.randint(0, 40)), i, rng.randint(0, 3), rng.choice(["queued", "completed", "completed", "completed", "cancelled", "executing", "retry_waiting", "unknown_result"]), rng.choice([None, now + dt.timedelta(1)]), rng.choice([None, now + dt.timedelta(1), now]), None, rng.choice([0, 1]), 0, rng.choice([None, "w"])))
    columns = "command_id long, ordering_key long, received_at timestamp_ntz, queue_sequence long, priority int, status string, not_before timestamp_ntz, next_attempt_at timestamp_ntz, first_sent_at timestamp_ntz, attempt_count int, post_attempt_count int, exec_claim_owner_id string"
    df = spark.createDataFrame(rows, columns)

    def is_ready(r):
        due = r[5] in q.RUNNABLE and (r[6] is None or r[6] <= now or r[5] == "unknown_result" or r[9] > 0) and (r[7] is None or r[7] <= now)
        return due and (r[1] is None or not any(p[1] == r[1] and (p[2], p[3]) < (r[2], r[3]) and p[5] not in q.CLOSED for p in rows))

    at = F.lit(now).cast("timestamp_ntz")
    want = [r for r in rows if is_ready(r)]
    assert sorted(r.command_id for r in q.ready(df, at, at).collect()) == [r[0] for r in want]
    top = sorted(want, key=lambda r: (-r[4], r[2], r[3]))[:7]
    assert [r.command_id for r in q.take_ready(df, at, at, 7).collect()] == [r[0] for r in top]
    assert q.ready_count(df, at, at).first()[0] == sum(r[11] is None for r in want)


def test_overlapping_runs(spark):
    rows = [(1, 1, ["a", "b"]), (2, 2, ["b", "c"]), (3, 3, ["c"]), (4, 4, ["d"]), (5, 4, ["d"]), (6, 9, ["e", "f"])]
    got = runs.overlapping(spark.createDataFrame(rows, "run_id long, created_at long, entities array<string>"))
    assert sorted(r[0] for r in got.collect()) == [1, 4, 6]


def test_cursors_commit_all_or_none(spark):
    current = spark.createDataFrame([("a", 10, 1), ("b", None, 4)], "entity_name string, cursor_at long, generation long")
    schema = "entity_name string, base_at long, base_generation long, next_at long"
    good = [("a", 10, 1, 11), ("b", None, 4, 12), ("c", None, None, 13)]
    out = {r.entity_name: (r.outcome, r.generation, r.cursor_at) for r in runs.publish_cursors(current, spark.createDataFrame(good, schema)).collect()}
    assert out == {"a": ("committed", 2, 11), "b": ("committed", 5, 12), "c": ("committed", 1, 13)}
    out = {r.entity_name: r.outcome for r in runs.publish_cursors(current, spark.createDataFrame([("a", 9, 1, 11), good[1]], schema)).collect()}
    assert out == {"a": "conflict", "b": "held"}
