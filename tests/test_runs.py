from tidegate.operators import runs as r
from tidegate.operators import verification as v


def test_dispatch_decides_before_the_limit(spark):
    """200 jobs behind the head of a hot entity and 200 of an owned one hide neither of the eligible ones."""
    rows = [(i, ["x", "hot"], 1) for i in range(200)] + [(i, ["owned", f"e{i}"], 1) for i in range(200, 400)]
    rows += [(401, ["a", "k"], 1), (402, ["b"], 1), (403, ["c"], 1), (404, ["d"], None), (405, ["e"], 1), (406, ["f"], 1), (407, [], 1), (408, ["k", "z"], 1)]
    runs = spark.createDataFrame([(i, "pending", i, "m", v) for i, _, v in rows] + [(400, "succeeded", 0, "m", 1)], "run_id long, status string, created_at long, mode string, version int")
    jobs = spark.createDataFrame([(1000 + i, i, "finished" if i == 406 else "waiting", "n" if i == 403 else "m", 2 if i == 405 else v) for i, _, v in rows], "job_id long, run_id long, status string, mode string, version int")
    owners = spark.createDataFrame([("owned", None), ("a", 1)], "entity_name string, released_at int")
    kind = "run_id long, entity_name string"
    manifests = spark.createDataFrame([(i, e) for i, es, _ in rows for e in es] + [(400, "a")], kind)
    own = spark.createDataFrame([(i, "other" if i == 402 else e) for i, es, _ in rows for e in es], kind)
    assert [tuple(x) for x in r.dispatch(jobs, runs, owners, manifests, own).collect()] == [(1000, 0), (1401, 401)]


def test_due_uploads_needs_owner_and_clean_attempts(spark):
    batches = spark.createDataFrame([(f"b{i}", i, "x", "ready", i) for i in range(7)] + [("c", 0, "y", "ready", 0), ("d", 0, "x", "acknowledged", 0)], "batch_id string, run_id long, entity_name string, status string, created_at long")
    runs = spark.createDataFrame([(i, "blocked" if i == 6 else "pending") for i in range(7)], "run_id long, status string")
    owners = spark.createDataFrame([(i, "x", 1 if i == 3 else None) for i in range(7) if i != 2], "owner_run_id long, entity_name string, released_at int")
    attempts = spark.createDataFrame([("b1", "precheck"), ("b4", "precheck"), ("b4", "unknown"), ("b5", "refused")], "batch_id string, outcome string")
    assert [x.batch_id for x in r.due_uploads(batches=batches, runs=runs, owners=owners, attempts=attempts).collect()] == ["b0", "b1"]


def test_readiness(spark):
    runs = spark.createDataFrame([(i,) for i in range(13)], "run_id long")
    state = {3: "dead_letter", 4: "ready"}
    batches = spark.createDataFrame([(i, "a", 5, state.get(i, "acknowledged")) for i in range(1, 13)] + [(11, "b", 5, "acknowledged")], "run_id long, entity_name string, row_count long, status string")
    entities = spark.createDataFrame([(i, "a", 2 if i == 5 else 1, 6 if i == 2 else 5, "X" if i == 10 else None) for i in range(1, 13)], "run_id long, entity_name string, expected_batches long, expected_rows long, failure_code string")
    bindings = spark.createDataFrame([(i, "a", 0 if i == 7 else 2) for i in range(1, 13) if i != 6] + [(12, "b", 2)], "run_id long, entity_name string, expected_epoch long")
    owners = spark.createDataFrame([("a", i, 0 if i == 7 else 3 if i == 8 else 2, 1 if i == 9 else None) for i in range(1, 13)], "entity_name string, owner_run_id long, epoch long, released_at int")
    got = {x.run_id: x.readiness for x in v.readiness(runs=runs, entities=entities, batches=batches, owners=owners, bindings=bindings).collect()}
    want = "legacy ready violated violated transient violated ownership ownership ownership ownership violated violated ownership"
    assert [got[i] for i in range(13)] == want.split()
