"""Names, addresses, stored cursors, seals, dispatch and verdicts: edges by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tidegate.functions import identity
from tidegate.operators import ledger as lg
from tidegate.operators import verification as v

A, B = "0000000a-000b-000c-000d-00000000000e", "0000000a-000b-000c-000d-00000000000F"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_endpoints_have_one_form(spark):
    given = {
        "HTTP://Host:80/A/": "http://host/A", "https://h:443": "https://h", "https://h:8443/": "https://h:8443", "http://h:443/x": "http://h:443/x", " https://h/a/b ": "https://h/a/b", "http://h:080/": "http://h",
        "ftp://h/x": None, "https://u@h/x": None, "https://u:p@h/x": None, "https://h/x?a": None, "https://h/x#a": None, "h/x": None, "https://h/x\n": "https://h/x", "https://h/\nx": None, "": None, "https://": None,
    }
    assert column(spark, list(given), identity.endpoint) == list(given.values())
    assert column(spark, [None], identity.endpoint) == [None]


def test_publications(spark):
    same = lambda a, b: spark.range(1).select(identity.same_publication(F.lit(a), F.lit(b)).alias("x")).first().x
    assert same("https://h/base/odata/standard.odata", "https://H:443/base/hs/agent/")
    assert same("https://h/base/odata", "https://h/base/hs") and same("https://h/anything", "https://h/other/hs/agent")
    assert not same("https://h/base/odata/x", "https://h/Base/hs/agent") and not same("https://h/b/odata/x", "http://h/b/hs/a") and not same("https://h/b/odata/x", "nowhere")


def test_namespaces_are_parsed_strictly(spark):
    good = f"1c-identity:v1:{A}:{A}:test"
    bad = [good + " ", good + "\n", good.replace(A, B, 1), good.replace("test", "Test"), good.replace(A, identity.NO_ID, 1), good + ":x", "1c-identity:v2:" + good[15:], "", None]
    got = column(spark, [good, *bad], identity.parse_namespace)
    assert tuple(got[0]) == (A, A, "test") and got[1:] == [None] * len(bad)
    assert column(spark, ["RunModeMismatch", "A", "claimLost", "aBC", ""], identity.upper_snake) == ["RUN_MODE_MISMATCH", "A", "CLAIM_LOST", "A_B_C", ""]
    assert column(spark, ["x", "", "a b", "x" * 128, "x" * 129, "é", "a\n", None], identity.token_valid) == [True, False, False, True, False, False, False, False]


def test_stored_cursors(spark):
    rows = [
        ('{"updatedAtUtc":"2024-01-02T03:04:05Z"}', True, True), ('{"SOURCEID":"1","UpdatedAtUtc":null}', True, True), ("{}", False, True), ("{}", True, False), ('{"sourceId":null}', True, False),
        ('{"sourceId":"1","SourceId":"2"}', False, False), ('{"sourceId":"1","sourceId":"1"}', False, False), ('{"sourceId":1}', False, False), ('{"sourceId":"  "}', False, False), ('{"x":"1"}', False, False),
        ('{"updatedAtUtc":"soon"}', False, False), ("[]", False, False), ("null", False, False), ("", False, False), (None, False, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, f boolean, w boolean")
    got = df.select("w", identity.cursor_valid(F.col("x"), F.col("f")).alias("y"), "x").collect()
    assert [(r.x, r.y) for r in got] == [(r.x, r.w) for r in got]


def test_verdicts_in_their_order(spark):
    kind = "scope string, verify boolean, count_failure string, key_failure string, count_after_failure string, count_before long, count_after long, rows long, keys long, row_digest string, key_digest string"
    base = ("full", True, None, None, None, 5, 5, 5, 5, "d", "d")
    cases = [
        (base, ("verified", None)),
        (("delta", *base[1:]), (None, None)),
        (("full", False, "COUNT_FAILED", *base[3:]), ("not_checked", None)),
        ((*base[:2], "COUNT_UNSUPPORTED", "KEY_PASS_FAILED", "COUNT_FAILED", 5, 6, 7, 8, "d", "e"), ("unverified", "COUNT_UNSUPPORTED")),
        ((*base[:3], "KEY_PASS_UNSUPPORTED", "COUNT_FAILED", 5, 6, 7, 8, "d", "e"), ("unverified", "KEY_PASS_UNSUPPORTED")),
        ((*base[:4], "COUNT_FAILED", 5, None, 7, 8, "d", "e"), ("unverified", "COUNT_FAILED")),
        ((*base[:5], 5, 6, 7, 8, "d", "e"), ("unverified", "COUNT_CHANGED")),
        ((*base[:7], 6, 8, "d", "e"), ("unverified", "ROWS_NOT_EQUAL_COUNT")),
        ((*base[:8], 8, "d", "e"), ("unverified", "KEY_PASS_COUNT_MISMATCH")),
        ((*base[:10], "e"), ("unverified", "KEY_SET_MISMATCH")),
        (("full", True, None, None, None, None, None, 0, 0, "d", "d"), ("unverified", "COUNT_FAILED")),
    ]
    got = v.read_completeness(spark.createDataFrame([c for c, _ in cases], kind).coalesce(1)).collect()
    assert [(r.status, r.reason) for r in got] == [w for _, w in cases]


def test_seals(spark):
    e = [(1, "A", 2, 5, None), (1, "B", 1, 1, None), (2, "A", 1, 1, None), (3, "A", 2, 1, None), (4, "A", 1, 9, None), (5, "A", 0, 0, "X"), (6, "A", 1, 1, None), (7, "A", 1, 1, None), (8, "A", 1, 1, None), (9, "A", 0, 0, None), (11, "A", 1, 1, None), (11, "B", 0, 0, "X")]
    entities = spark.createDataFrame(e, "run_id long, entity_name string, expected_batches long, expected_rows long, failure_code string")
    batches = spark.createDataFrame([(1, "A", 2), (1, "A", 3), (1, "B", 1), (2, "A", 1), (3, "A", 1), (4, "A", 1), (6, "A", 1), (6, "Z", 1), (7, "A", 1), (8, "A", 1), (11, "A", 1)], "run_id long, entity_name string, row_count long")
    requested = spark.createDataFrame([(r, n) for r, n, *_ in e] + [(2, "B"), (10, "A")], "run_id long, entity_name string")
    runs = spark.createDataFrame([(1, "running", 3, 6), (2, "running", 1, 1), (3, "running", 1, 1), (4, "running", 1, 1), (5, "running", 0, 0), (6, "running", 1, 1), (7, "running", 1, 2), (8, "uploading", 1, 1), (9, "running", 0, 0), (10, "running", 0, 0), (11, "running", 1, 1)], "run_id long, status string, batches_created long, rows_read long")
    got = {r.run_id: (r.outcome, r.entity) for r in v.seal_runs(runs=runs, requested=requested, entities=entities, batches=batches).collect()}
    assert got == {
        1: ("sealed", None), 2: ("ENTITY_SET_MISMATCH", None), 3: ("BATCH_COUNT", "A"), 4: ("ROW_COUNT", "A"), 5: ("ALL_ENTITIES_FAILED", None), 6: ("EXPECTED_BATCH_COUNT", None), 7: ("EXPECTED_BATCH_COUNT", None),
        8: ("NOT_RUNNING", None), 9: ("BATCHES_MISSING", "A"), 10: ("ENTITY_SET_MISMATCH", None), 11: ("sealed", None),
    }


def test_dispatch_outcomes(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    now = F.lit(t(20)).cast("timestamp_ntz")
    run = "run_id long, status string, created_at timestamp_ntz, mode string, version int, schedule_key string, manifest_valid boolean, inert boolean"
    ok = lambda i, d, status="pending", key=None, valid=True, inert=True, mode="m": (i, status, t(d), mode, 1, key, valid, inert)
    runs = [ok(1, 1), ok(2, 2), ok(3, 3), ok(4, 4, "running"), ok(5, 5, key="k"), ok(6, 6, mode="n"), ok(7, 7), ok(8, 8, valid=False), ok(9, 9), ok(10, 10, valid=False, inert=False), ok(11, 11), ok(12, 12, "succeeded")]
    jobs = [(100 + i, i, "pending", None, "m", 1) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 99)] + [(202, 2, "deferred", t(20), "m", 1), (203, 2, "deferred", t(21), "m", 1), (204, 2, "running", None, "m", 1), (205, 1, "pending", None, "m", None)]
    manifests = [(1, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d"), (5, "e"), (6, "f"), (7, "g"), (8, "h"), (9, "i"), (9, "i2"), (11, "j")]
    frozen = [(r, e) for r, e in manifests if e != "i2"]
    owners = [("b", 2, None), ("g", 55, None), ("c", 55, 1)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = lg.dispatch_outcomes(
        frame(jobs, "job_id long, run_id long, status string, available_at timestamp_ntz, mode string, version int"), frame(runs, run), frame(manifests, "run_id long, entity_name string"), frame(frozen, "run_id long, entity_name string"),
        frame(owners, "entity_name string, owner_run_id long, released_at int"), now,
    )
    bad = "JOB_MANIFEST_INCONSISTENT"
    assert {r.job_id: r.outcome for r in out.collect()} == {
        101: "claimable", 102: "claimable", 202: "claimable", 103: "queued_overlap", 104: bad, 105: bad, 106: bad, 107: "busy_entity", 108: bad, 109: bad, 111: "elder_manifest_invalid", 199: bad, 205: bad,
    }


def test_missing_files_block_their_runs(spark):
    batches = spark.createDataFrame([("a", 1, "ready"), ("b", 1, "creating"), ("c", 1, "acknowledged"), ("d", 2, "retry_waiting"), ("e", 3, "uploading"), ("f", 4, "ready")], "batch_id string, run_id long, status string")
    files = spark.createDataFrame([("d",)], "batch_id string")
    runs = spark.createDataFrame([(1, "uploading"), (2, "uploading"), (3, "uploading"), (4, "failed")], "run_id long, status string")
    jobs = spark.createDataFrame([(10, 1, "running"), (11, 4, "blocked")], "job_id long, run_id long, status string")
    got = sorted(((r.kind, r.id, r.to_status, r.code) for r in lg.missing_file_blocks(batches=batches, files=files, runs=runs, jobs=jobs).collect()), key=str)
    assert got == [("batch", "a", "dead_letter", "SPOOL_FILE_MISSING"), ("batch", "b", "dead_letter", "RUN_BLOCKED"), ("batch", "f", "dead_letter", "SPOOL_FILE_MISSING"), ("job", "10", "blocked", None), ("run", "1", "blocked", "SPOOL_FILE_MISSING")]
