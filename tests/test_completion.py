import json

from tidegate.operators import completion

RUN = {"run_id": 1, "mode": "incremental", "rows_read": 7, "batches_created": 2, "batches_acknowledged": 2, "database_id": "d", "export_epoch": "e", "environment": "p", "generation": "g"}
GOOD = {
    "runId": "1", "status": "partial_success", "mode": "incremental", "rowsRead": 7, "batchesCreated": 2, "batchesAcknowledged": 2, "completedAtUtc": "2024-01-02T03:04:05Z", "entitiesFailed": 1,
    "sourceIdentity": {"databaseId": "d", "exportEpoch": "e", "environment": "p"}, "sourceGeneration": "g",
    "entities": [
        {"entity": "A", "status": "done", "readScope": "delta", "rowsRead": 7, "batchesCreated": 2, "errorCode": None, "errorMessage": None, "completeness": "verified", "completenessReason": None},
        {"entity": "B", "status": "failed", "readScope": "full", "rowsRead": 0, "batchesCreated": 0, "errorCode": "X", "errorMessage": "why", "snapshotAtUtc": "s"},
    ],
}


def test_bodies(spark):
    good = json.dumps(GOOD)
    swap = lambda a, b: good.replace(a, b, 1)
    bodies = {
        "good": good,
        "other order of names": json.dumps(dict(reversed(GOOD.items()))),
        "spaces": json.dumps(GOOD, indent=2),
        "cut": good[:-1],
        "twice": swap('"mode"', '"mode": "incremental", "mode"'),
        "by case": swap('"mode"', '"Mode": 1, "mode"'),
        "nested by case": swap('"readScope"', '"ReadScope": 1, "readScope"'),
        "nested twice": swap('"readScope": "delta"', '"readScope": "delta", "readScope": "delta"'),
        "number as text": swap('"rowsRead": 7', '"rowsRead": "7"'),
        "number with a point": swap('"rowsRead": 7', '"rowsRead": 7.0'),
        "other number": swap('"batchesCreated": 2', '"batchesCreated": 3'),
        "text as number": swap('"runId": "1"', '"runId": 1'),
        "no date": swap("2024-01-02T03:04:05Z", "2024-01-32T03:04:05Z"),
        "date as number": swap('"2024-01-02T03:04:05Z"', "20240102"),
        "null": swap('"g"', "null"),
        "code where none is": swap('"errorCode": null', '"errorCode": ""'),
        "entities swapped": json.dumps(GOOD | {"entities": GOOD["entities"][::-1]}),
        "one entity": json.dumps(GOOD | {"entities": GOOD["entities"][:1]}),
        "entities as object": json.dumps(GOOD | {"entities": {}}),
        "entity as text": json.dumps(GOOD | {"entities": ["A", "B"]}),
        "identity more": swap('"environment"', '"x": 1, "environment"'),
        "identity as text": json.dumps(GOOD | {"sourceIdentity": "d"}),
        "array": "[]",
        "no JSON": "x",
        "none": None,
    }
    names = list(bodies)
    runs = spark.createDataFrame([(i, *list(RUN.values())[1:]) for i in range(len(names))] + [(99, *list(RUN.values())[1:])], "run_id long, mode string, rows_read long, batches_created long, batches_acknowledged long, database_id string, export_epoch string, environment string, generation string")
    kind = "run_id long, entity_name string, row_total long, batches long, failure_code string, failure_message string, read_scope string, completeness string, completeness_reason string, snapshot_at string"
    entities = spark.createDataFrame([x for i in range(len(names)) for x in ((i, "B", 0, 0, "X", "why", "full", None, None, "s"), (i, "A", 7, 2, None, None, "delta", "verified", None, None))], kind)
    rows = [(i, b and b.replace('"runId": "1"', f'"runId": "{i}"')) for i, b in enumerate(bodies.values())]
    got = {names[r.run_id]: r.valid for r in completion.stored_valid(spark.createDataFrame(rows, "run_id long, body string"), runs, entities).collect()}
    assert {n for n, v in got.items() if v} == {"good", "other order of names", "spaces"} and len(got) == len(names)


def test_a_run_without_identity_or_entities(spark):
    body = json.dumps({"runId": "1", "status": "succeeded", "mode": "entity_reload", "rowsRead": 0, "batchesCreated": 0, "batchesAcknowledged": 0, "completedAtUtc": "2024-01-02T03:04:05+02:00", "entitiesFailed": 0, "entities": []})
    runs = spark.createDataFrame([(1, "entity_reload"), (2, "other")], "run_id long, mode string").selectExpr("*", "0L as rows_read", "0L as batches_created", "0L as batches_acknowledged", *[f"cast(null as string) as {c}" for c in ("database_id", "export_epoch", "environment", "generation")])
    entities = spark.createDataFrame([], "run_id long, entity_name string, row_total long, batches long, failure_code string, failure_message string, read_scope string, completeness string, completeness_reason string, snapshot_at string")
    bodies = spark.createDataFrame([(1, body), (2, body.replace('"1"', '"2"').replace("entity_reload", "other"))], "run_id long, body string")
    assert {r.run_id: r.valid for r in completion.stored_valid(bodies, runs, entities).collect()} == {1: True, 2: False}


def test_a_body_is_read_once(spark):
    """Values are taken in one typed read, kinds by schema: no reads name by name, for each of which a body is searched again."""
    runs = spark.createDataFrame([(1, "incremental")], "run_id long, mode string").selectExpr("*", "0L as rows_read", "0L as batches_created", "0L as batches_acknowledged", *[f"cast(null as string) as {c}" for c in ("database_id", "export_epoch", "environment", "generation")])
    entities = spark.createDataFrame([], "run_id long, entity_name string, row_total long, batches long, failure_code string, failure_message string, read_scope string, completeness string, completeness_reason string, snapshot_at string")
    plan = completion.stored_valid(spark.createDataFrame([(1, "{}")], "run_id long, body string"), runs, entities)._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get") <= 4 and plan.count("json_object_keys") == 0
