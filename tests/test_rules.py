"""Edges of the rules, by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tidegate.functions import payload
from tidegate.operators import extraction as ex
from tidegate.operators import queue as q
from tidegate.operators import runs as r


def test_certificate_edges(spark):
    now = dt.datetime(2024, 1, 1)
    ends = [dt.timedelta(0), dt.timedelta(microseconds=1), dt.timedelta(days=1), dt.timedelta(days=1, microseconds=1), dt.timedelta(days=30), dt.timedelta(days=30, seconds=1), dt.timedelta(days=-3)]
    df = spark.createDataFrame([(i, now + e) for i, e in enumerate(ends)], "i int, e timestamp_ntz")
    got = df.select("i", r.certificate_warning(F.col("e"), F.lit(now).cast("timestamp_ntz")).alias("w")).orderBy("i").collect()
    assert [x.w for x in got] == [0, 1, 1, 3, 30, None, 0]


def test_outcomes(spark):
    rows = [(401, "succeeded"), (403, None), (422, "processing"), (202, "failed"), (200, " Completed "), (201, "created"), (200, None), (200, "odd"), (500, "succeeded"), (404, "succeeded"), (409, None), (200, "not_found")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, http int, body string")
    got = [x.o for x in df.select("i", ex.outcome_class(F.col("http"), F.col("body")).alias("o")).orderBy("i").collect()]
    assert got == ["business_error", "business_error", "business_error", "processing", "succeeded", "succeeded", "technical", "technical", "technical", "not_found", "conflict", "not_found"]


def test_drain_stops_leases_only(spark):
    df = spark.createDataFrame([("drain",), ("pause_etl",), ("pause_commands",)], "mode string").select("mode", *[F.lit(x).alias(n) for n, x in (("ready", True), ("local_paused", False), ("handshake_maintenance", False), ("rejected", False))])
    got = {x.mode: (x.may_lease, x.may_execute, x.may_extract, x.may_deliver) for x in ex.mode_gate(df).collect()}
    assert got == {"drain": (False, True, True, True), "pause_etl": (True, True, False, True), "pause_commands": (False, False, True, True)}


def test_error_codes_of_one_level():
    assert payload.error_code('{"x":{"code":"A"},"code":"B"}') == "B"
    assert payload.error_code('{"error":{"x":{"code":"A"},"code":"B"},"code":"C"}') == "B"
    assert payload.error_code('{"error":{},"code":"C"}') == "C"
    assert payload.error_code('{"code":1,"error":{"code":"A"}}') is None
    assert payload.error_code('{"pad":"' + "é" * 2040 + '","code":"LATE_CODE"}') is None
    assert payload.error_code('{"pad":"' + "e" * 4000 + '","code":"IN_TIME"}') == "IN_TIME"
    assert payload.error_code('{"a":[1,{"code":"A"}], "code" : "B"') == "B"


def test_stale_claims_are_taken_and_heads_hold(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [  # id, key, hour, status, owner, claimed
        (1, "a", 1, "executing", None, None),
        (2, "a", 2, "queued", None, None),
        (3, "b", 1, "queued", "x", t(1)),
        (4, "b", 2, "queued", None, None),
        (5, None, 1, "queued", "x", t(9)),
        (6, None, 1, "unknown_result", "x", None),
        (7, "c", 1, "completed", None, None),
        (8, "c", 2, "retry_waiting", None, None),
    ]
    df = spark.createDataFrame([(i, k, t(h), i, s, 0, 0, None, None, None, o, c) for i, k, h, s, o, c in rows], "command_id long, ordering_key string, received_at timestamp_ntz, queue_sequence long, status string, attempt_count int, post_attempt_count int, first_sent_at timestamp_ntz, not_before timestamp_ntz, next_attempt_at timestamp_ntz, exec_claim_owner_id string, exec_claim_acquired_at timestamp_ntz")
    at = lambda h: F.lit(t(h)).cast("timestamp_ntz")
    got = q.claim(df, "me", at(12), at(12), at(5)).collect()
    assert sorted(x.command_id for x in got) == [3, 6, 8] and {x.exec_claim_owner_id for x in got} == {"me"}


def test_numbers_run_through_the_whole_table(spark):
    df = spark.range(500).select("id", ((F.col("id") * 7919) % 501).alias("x"))
    got = [x.id for x in q.numbered(df, ["x", "id"], F.floor(F.col("x") / 37)).orderBy("_n").collect()]
    assert got == [x.id for x in df.orderBy("x", "id").collect()]
    assert q.numbered(df.limit(0), ["x"], F.col("x")).count() == 0
