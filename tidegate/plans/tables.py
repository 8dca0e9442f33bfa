"""Queue, run and cursor tables derived from the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (source, filter or None, {column: expression})
DERIVED: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "commands": ("events", None, {
        "command_id": "event_id",
        "ordering_key": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END",
        "received_at": "ts",
        "queue_sequence": "event_id",
        "priority": "CAST(event_id % 5 AS INT)",
        "status": "CASE WHEN event_type = 'view' THEN 'completed' WHEN event_type = 'click' AND event_id % 29 = 0 THEN 'queued' WHEN event_type = 'click' THEN 'completed' "
        "WHEN event_type = 'purchase' AND event_id % 37 = 0 THEN 'retry_waiting' WHEN event_type = 'purchase' THEN 'cancelled' WHEN event_type = 'signup' AND event_id % 101 = 0 THEN 'result_pending' "
        "WHEN event_type = 'signup' THEN 'expired' WHEN event_id % 53 = 0 THEN 'unknown_result' WHEN event_id % 59 = 0 THEN 'executing' ELSE 'dead_letter' END",
        "not_before": "CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL '20' DAY END",
        "next_attempt_at": "CASE WHEN event_id % 13 = 0 THEN ts + INTERVAL '5' DAY END",
        "expires_at": "CASE WHEN event_id % 19 = 0 THEN ts - INTERVAL '1' DAY WHEN event_id % 19 = 1 THEN ts + INTERVAL '2' DAY END",
        "first_sent_at": "CASE WHEN event_id % 23 = 0 THEN ts + INTERVAL '1' HOUR END",
        "attempt_count": "CAST(event_id % 3 AS INT)",
        "post_attempt_count": "CAST(event_id % 2 AS INT)",
        "exec_claim_owner_id": "CASE WHEN event_id % 34 = 0 THEN 'w1' WHEN event_id % 17 = 0 THEN 'w2' END",
        "exec_claim_acquired_at": "CASE WHEN event_id % 51 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ts + INTERVAL '1' HOUR END",
        "old_sequence": "CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END",
        "acknowledged_at": "CASE WHEN event_type = 'view' THEN ts + INTERVAL '1' DAY END",
        "result_status": "CASE WHEN event_id % 9 = 0 THEN 'dead_letter' WHEN event_id % 9 = 1 THEN NULL ELSE 'success' END",
        "payload": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE props END",
        "payload_hash": "props",
        "result_json": "CASE WHEN event_id % 97 = 1 THEN NULL ELSE props END",
        "command_type": "event_type",
        "started_at": "CASE WHEN event_id % 6 <> 0 THEN ts + INTERVAL '2' HOUR END",
    }),
    "incoming": ("events", None, {"command_id": "CASE WHEN event_id % 8 = 0 THEN event_id ELSE event_id + 10000000 END", "payload": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE props END", "payload_hash": "CASE WHEN event_id % 16 = 0 THEN props ELSE 'other' END", "received_at": "ts"}),
    "envelopes": ("events", None, {
        "command_id": "CASE event_id % 23 WHEN 0 THEN NULL WHEN 1 THEN '00000000-0000-0000-0000-000000000000' WHEN 2 THEN ' ' ELSE CAST(event_id AS STRING) END",
        "command_type": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END",
        "payload_version": "CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 31 = 1 THEN 2 ELSE 1 END",
        "payload": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END",
        "payload_hash": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN 'other' ELSE props END",
        "refused": "CASE WHEN event_id % 13 = 0 THEN 'PAYLOAD_DEPTH' END",
        "computed_hash": "props",
    }),
    "states": ("events", None, {
        "event_id": "event_id",
        "ready": "event_id % 11 <> 0",
        "local_paused": "event_id % 7 = 0",
        "mode": "CASE event_id % 6 WHEN 0 THEN 'normal' WHEN 1 THEN 'pause_etl' WHEN 2 THEN 'pause_commands' WHEN 3 THEN 'drain' WHEN 4 THEN 'maintenance' ELSE 'disabled' END",
        "handshake_maintenance": "event_id % 13 = 0",
        "rejected": "event_id % 17 = 0",
    }),
    "vitals": ("events", None, {
        "event_id": "event_id",
        "rejected": "event_id % 17 = 0",
        "mode": "CASE WHEN event_id % 13 = 0 THEN 'maintenance' WHEN event_id % 13 = 1 THEN 'disabled' WHEN event_id % 13 = 2 THEN 'drain' ELSE 'normal' END",
        "state_bytes": "event_id % 100",
        "spool_bytes": "user_id % 100",
        "disk_free": "(event_id + user_id) % 100",
        "command_api": "event_id % 5 <> 0",
        "data_api": "event_id % 4 <> 0",
        "drift_ms": "event_id % 41 - 20",
        "runs_unresolved": "CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END",
        "entities_failing": "CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END",
        "lag_seconds": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 90 END",
    }),
    "acks": ("lineitem", "l_linestatus = 'F'", {
        "batch_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
        "ack_status": "CASE WHEN l_partkey % 40 = 0 THEN NULL WHEN l_partkey % 40 = 1 THEN 'duplicate' ELSE 'acknowledged' END",
        "ack_batch_id": "CASE WHEN l_suppkey % 30 = 0 THEN 'other' WHEN l_suppkey % 30 = 1 THEN NULL ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) END",
        "checksum_valid": "CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_orderkey % 20 <> 1 END",
        "rows_accepted": "CASE WHEN l_partkey % 30 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END",
    }),
    "requests": ("orders", None, {"run_id": "o_orderkey", "requested": "CASE o_orderkey % 11 WHEN 0 THEN 'none' WHEN 1 THEN '[]' WHEN 2 THEN '[\"' || o_orderpriority || '\",1]' WHEN 3 THEN '[\"' || o_orderpriority || '\",\" \"]' WHEN 4 THEN '[\"' || o_orderpriority || '\",\"' || o_orderpriority || '\"]' WHEN 5 THEN '{\"a\":1}' WHEN 6 THEN '[\"' || o_orderpriority || '\",\"more\"]' WHEN 7 THEN NULL ELSE '[\"' || o_orderpriority || '\"]' END"}),
    "job_payloads": ("events", None, {"event_id": "event_id", "payload": "CASE event_id % 12 WHEN 0 THEN '{}' WHEN 1 THEN '{\"entities\":null}' WHEN 2 THEN '{\"entities\":[]}' WHEN 3 THEN '{\"entities\":[\"A\",\"B\"]}' WHEN 4 THEN '{\"entities\":[\"B\",\"A\",\"A\"]}' WHEN 5 THEN '{\"entities\":[\"A\"]}' WHEN 6 THEN '{\"entities\":[\"A\",\"B\",\"C\"]}' WHEN 7 THEN '{\"entities\":[\"A\",1]}' WHEN 8 THEN '{\"entities\":\"A\"}' WHEN 9 THEN '[]' WHEN 10 THEN '{\"entities\":[\"A\",\"\"]}' ELSE 'broken' END"}),
    "conflicts": ("events", None, {"command_id": "user_id", "payload_hash": "event_type", "first_seen": "ts", "last_seen": "ts", "occurrences": "CAST(1 AS BIGINT)"}),
    "stored_conflicts": ("events", "event_type <> 'signup'", {"command_id": "user_id + 1", "payload_hash": "event_type", "first_seen": "ts - INTERVAL '1' DAY", "last_seen": "ts - INTERVAL '2' HOUR", "occurrences": "CAST(event_id % 3 + 1 AS BIGINT)"}),
    "resolutions": ("orders", None, {"run_id": "CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey ELSE -o_orderkey END"}),
    "results": ("events", "event_type IN ('view', 'signup')", {"result_id": "event_id", "command_id": "event_id", "status": "CASE event_id % 16 WHEN 0 THEN 'pending' WHEN 8 THEN 'sending' WHEN 3 THEN 'dead_letter' WHEN 5 THEN 'retry_waiting' ELSE 'acknowledged' END", "created_at": "ts", "next_attempt_at": "CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '9' DAY END", "attempt_count": "CAST(event_id % 4 AS INT)"}),
    "command_jobs": ("events", None, {"job_id": "event_id", "command_id": "CASE WHEN event_id % 7 = 0 THEN event_id ELSE -event_id END", "status": "CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'finished' ELSE 'cancelled' END"}),
    "command_attempts": ("events", "event_id % 3 = 0", {"command_id": "event_id % 5000", "attempt_no": "event_id", "started_at": "ts", "outcome": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END"}),
    "failures": ("events", None, {
        "event_id": "event_id",
        "cause": "CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http' WHEN 2 THEN 'transport' WHEN 3 THEN 'io' WHEN 4 THEN 'limit' WHEN 5 THEN 'json' ELSE 'other' END",
        "http": "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 202 WHEN 2 THEN 404 WHEN 3 THEN 409 WHEN 4 THEN 422 WHEN 5 THEN 500 WHEN 6 THEN 503 WHEN 7 THEN 429 ELSE 401 END",
        "body": "CASE event_id % 14 WHEN 0 THEN 'processing' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' WHEN 4 THEN ' Created ' WHEN 5 THEN 'executing' WHEN 6 THEN 'pending' WHEN 7 THEN 'not_found' WHEN 8 THEN 'business_failed' WHEN 9 THEN 'REJECTED' WHEN 10 THEN 'validation_error' WHEN 11 THEN 'odd' WHEN 12 THEN '' END",
        "now": "ts",
        "expiry": "CASE event_id % 4 WHEN 0 THEN ts + INTERVAL '12' HOUR WHEN 1 THEN ts + INTERVAL '7' DAY WHEN 2 THEN ts - INTERVAL '1' DAY * (event_id % 3) ELSE ts + INTERVAL '1' DAY * (event_id % 45) END",
    }),
    "stamps": ("events", None, {"event_id": "event_id", "stamp": "CASE WHEN event_id % 10 = 0 THEN 'no date' ELSE CAST(ts AS STRING) END"}),
    "probes": ("events", None, {
        "event_id": "event_id",
        "bound": "CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 31 = 1 THEN '' ELSE 'db' END",
        "endpoint": "CASE WHEN event_id % 13 = 0 THEN 'https://h/a' ELSE 'https://h/o' END",
        "bound_endpoint": "'https://h/o'",
        "fetched": "CASE WHEN event_id % 10 = 0 THEN 'unavailable' WHEN event_id % 10 = 1 THEN 'not_ready' WHEN event_id % 10 = 2 THEN 'malformed' ELSE 'ok' END",
        "scope": "CASE WHEN event_id % 9 = 0 THEN 'area' ELSE 'whole-infobase' END",
        "database_id": "CASE WHEN event_id % 8 = 0 THEN 'other' ELSE 'db' END",
        "epoch": "CASE WHEN event_id % 7 = 0 THEN 2 ELSE 3 END",
        "environment": "CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'prod' END",
        "sent_ms": "CAST(1000000 + user_id AS DOUBLE)",
        "received_ms": "CAST(1000000 + user_id + event_id % 400 AS DOUBLE)",
        "remote_ms": "CAST(1000000 + event_id * 7 AS DOUBLE)",
        "expires_ms": "CAST(1000000 + event_id * 6 + 500 AS DOUBLE)",
        "not_before_ms": "CAST(1000000 + event_id * 8 - 500 AS DOUBLE)",
        "stamp": "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'never' ELSE '2024-01-05 06:07:08' END",
        "cursor_id": "CASE WHEN event_id % 8 = 4 THEN NULL WHEN event_id % 9 = 1 THEN ' ' ELSE CAST(event_id AS STRING) END",
    }),
    "quarantined": ("events", None, {
        "name": "CASE WHEN event_id % 5 = 0 THEN 'other.bin' ELSE event_type || '-x-0000000a-000b-000c-000d-00000000000e-0000000a-000b-000c-000d-00000000000f.ndjson.gz' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.tmp.' || CAST(1700000000000 + event_id AS STRING) WHEN 2 THEN '.orphan' ELSE '.tmp.orphan.' || CAST(event_id AS STRING) END END",
        "written_ms": "event_id * 1000",
    }),
    "error_bodies": ("events", None, {"event_id": "event_id", "body": "CASE event_id % 7 WHEN 4 THEN '{\"x\":{\"code\":\"INNER\"},\"code\":\"OUTER\"}' WHEN 5 THEN '{\"error\":{\"a\":1},\"code\":\"LATER\"}' WHEN 6 THEN '[{\"code\":\"LIST\"}]' WHEN 0 THEN '{\"code\":\"ITEM_' || CAST(event_id AS STRING) || '\",\"x' WHEN 1 THEN '{\"error\":{\"code\": \"LOCKED\"}}' WHEN 2 THEN '{\"code\":\"lower\"}' ELSE 'gone' END"}),
    "runs": ("orders", None, {
        "run_id": "o_orderkey",
        "entity_name": "o_orderpriority",
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'pending' END",
        "created_at": "o_orderdate",
        "started_at": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR END",
        "finished_at": "CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate + INTERVAL '1' DAY END",
        "failure_code": "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN 'READ_FAILED' END",
        "owner": "o_custkey % 4",
        "chain": "o_custkey % 5",
        "mode": "CASE WHEN o_orderkey % 7 = 0 THEN 'bootstrap_full' ELSE 'incremental' END",
        "version": "o_custkey % 6",
    }),
    "jobs": ("orders", None, {"job_id": "o_orderkey + 1000000", "run_id": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END", "status": "CASE WHEN o_custkey % 3 = 0 THEN 'waiting' ELSE 'finished' END", "mode": "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 38 <> 0 THEN 'bootstrap_full' ELSE 'incremental' END", "version": "CASE WHEN o_orderkey % 58 = 0 THEN NULL WHEN o_orderkey % 62 = 0 THEN o_custkey % 6 + 1 ELSE o_custkey % 6 END"}),
    "bindings": ("orders", None, {"run_id": "CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey ELSE -o_orderkey END", "entity_name": "o_orderpriority", "expected_epoch": "o_custkey % 3"}),
    "owners": ("nation", "n_nationkey < 4", {"entity_name": "CASE n_nationkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '9-OTHER' END", "owner_run_id": "CAST(n_nationkey * 4 AS BIGINT)", "epoch": "CAST(n_nationkey % 3 AS BIGINT)", "released_at": "CASE WHEN n_nationkey = 1 THEN 1 END"}),
    "owned": ("orders", None, {"entity_name": "o_orderpriority", "owner_run_id": "CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey ELSE -o_orderkey END", "epoch": "o_custkey % 2", "released_at": "CASE WHEN o_orderkey % 100 = 1 THEN 1 END"}),
    "manifests": ("lineitem", None, {"run_id": "l_orderkey", "entity_name": "CAST(l_partkey AS STRING)"}),
    "job_manifests": ("lineitem", None, {"run_id": "l_orderkey", "entity_name": "CASE WHEN l_orderkey % 46 = 0 AND l_linenumber = 1 THEN 'other' ELSE CAST(l_partkey AS STRING) END"}),
    "manifest_owners": ("part", None, {"entity_name": "CAST(p_partkey AS STRING)", "owner_run_id": "p_partkey", "released_at": "CASE WHEN p_partkey % 12 <> 0 THEN 1 END"}),
    "batch_owners": ("lineitem", None, {"entity_name": "l_returnflag", "owner_run_id": "l_orderkey", "epoch": "l_orderkey % 3 + 1", "released_at": "CASE WHEN l_orderkey % 20 = 1 THEN 1 END"}),
    "batch_bindings": ("lineitem", None, {"run_id": "l_orderkey", "entity_name": "CASE WHEN l_orderkey % 34 = 0 THEN 'X' ELSE l_returnflag END", "expected_epoch": "CASE WHEN l_orderkey % 26 = 0 THEN 0 WHEN l_orderkey % 22 = 0 THEN l_orderkey % 3 + 2 ELSE l_orderkey % 3 + 1 END"}),
    "batches": ("lineitem", None, {
        "batch_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
        "run_id": "l_orderkey",
        "entity_name": "l_returnflag",
        "row_count": "CAST(l_quantity AS BIGINT)",
        "status": "CASE WHEN l_linestatus = 'F' THEN 'acknowledged' WHEN l_linenumber % 2 = 0 THEN 'ready' ELSE 'dead_letter' END",
        "created_at": "l_shipdate",
        "acknowledged_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '1' DAY END",
    }),
    "batch_attempts": ("lineitem", "l_linenumber <> 3", {
        "batch_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
        "attempt_no": "CAST(l_quantity AS BIGINT)",
        "outcome": "CASE WHEN l_linestatus = 'F' THEN 'acknowledged' WHEN l_partkey % 4 = 0 THEN 'unknown' WHEN l_partkey % 4 = 1 THEN 'refused' WHEN l_partkey % 4 = 2 THEN 'unsent' ELSE 'precheck' END",
        "hash": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_returnflag || CAST(l_suppkey AS STRING) END",
        "rows_accepted": "CASE WHEN l_partkey % 30 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END",
    }),
    "files": ("lineitem", None, {
        "batch_id": "CASE WHEN l_partkey % 33 = 0 THEN 'lost-' || CAST(l_orderkey AS STRING) WHEN l_partkey % 10 = 0 THEN 'gone-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) END",
        "bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
        "quarantined": "l_linenumber = 7",
    }),
    "configs": ("orders", None, {"run_id": "o_orderkey", "entity_name": "o_orderpriority", "version": "o_custkey * 20000 + o_orderkey % 20000", "status": "CASE WHEN o_orderkey % 8 = 0 THEN 'rejected' WHEN o_orderkey % 8 = 1 THEN 'active' ELSE 'superseded' END"}),
    "cursors": ("customer", None, {"entity_name": "CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'old ' || c_name END", "cursor_at": "c_custkey * 10", "generation": "c_custkey % 4", "fingerprint": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END", "last_run_id": "c_custkey"}),
    "captured": ("customer", None, {"entity_name": "c_name", "base_at": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 100 = 1 THEN c_custkey ELSE c_custkey * 10 END", "base_generation": "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END", "next_at": "c_custkey * 10 + 7"}),
    "captured_clean": ("customer", None, {"entity_name": "c_name", "base_at": "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 10 END", "base_generation": "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END", "next_at": "c_custkey * 10 + 7"}),
    "fresh": ("customer", None, {"entity_name": "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new ' || c_name END", "cursor_at": "c_custkey * 10 + 5"}),
    "definitions": ("customer", None, {"entity_name": "CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE 'new ' || c_name END", "enabled": "c_nationkey <> 3", "sync_mode": "CASE WHEN c_nationkey = 5 THEN 'Manual_Only' ELSE 'incremental' END", "mode": "CASE WHEN c_custkey % 2 = 0 THEN 'incremental' ELSE 'bootstrap_full' END", "fingerprint": "CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_mktsegment END", "generation": "c_custkey % 8"}),
    "flags": ("region", None, {"entity_name": "CASE r_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' || CAST(r_regionkey AS STRING) END"}),
    "priorities": ("region", None, {"entity_name": "CASE r_regionkey WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '5-LOW' ELSE '7-NEW' END"}),
    "before": ("supplier", None, {"entity_name": "s_name", "base_id": "CAST(s_nationkey AS BIGINT)", "version": "s_suppkey"}),
    "after": ("supplier", None, {"entity_name": "CASE WHEN s_suppkey % 9 <> 0 THEN s_name ELSE 'new ' || s_name END", "base_id": "CASE WHEN s_suppkey % 10 = 0 THEN CAST(99 AS BIGINT) ELSE CAST(s_nationkey AS BIGINT) END", "version": "CASE WHEN s_suppkey % 14 = 0 THEN s_suppkey + 1 ELSE s_suppkey END"}),
}

# Planned entities of a run: what its batches come to, bent for some runs so that checks have something to find.
ENTITIES = """SELECT run_id, entity_name, CASE WHEN run_id % 50 = 0 THEN n + 1 ELSE n END AS expected_batches, CASE WHEN run_id % 70 = 0 THEN t + 5 ELSE t END AS expected_rows,
 CASE WHEN run_id % 12 = 0 AND entity_name <> 'N' THEN 'READ_FAILED' END AS failure_code, CASE WHEN run_id % 2 = 0 THEN 'incremental' WHEN run_id % 3 = 0 THEN 'entity_reload' ELSE 'bootstrap_full' END AS mode,
 CASE WHEN run_id % 12 = 0 AND entity_name <> 'N' THEN 'failed' WHEN run_id % 4 = 1 THEN 'extracting' ELSE 'completed' END AS status, entity_name = 'R' AS sensitive FROM (SELECT l_orderkey AS run_id, l_returnflag AS entity_name, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS t FROM {lineitem} GROUP BY l_orderkey, l_returnflag) x WHERE run_id % 90 <> 0"""

# Derived tables that take more than a projection: name -> (SQL, the tables in its braces).
VIEWS: dict[str, tuple[str, str]] = {"entities": (ENTITIES, "lineitem")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        sql, names = VIEWS[name]
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names.split()})
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, where, columns = DERIVED[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return (df.filter(where) if where else df).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def cte(name: str) -> str:
    """The same table as SQL, or nothing for a table of the driver's own."""
    if name in VIEWS:
        sql, names = VIEWS[name]
        return f"{name} AS ({sql.format(**{n: n for n in names.split()})})"
    if name not in DERIVED:
        return ""
    source, where, columns = DERIVED[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}{f' WHERE {where}' if where else ''})"


def with_tables(sql: str, *names: str) -> str:
    parts = [c for c in map(cte, names) if c]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
