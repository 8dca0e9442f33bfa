"""Queries over the ledger of runs, batches and sends, and over what is reported of commands; SQL written apart from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import completion, filling
from ..operators import ledger as lg
from ..operators import queue as q
from ..operators import runs as r
from ..operators import verification as v
from .catalogue import query, relational
from .tables import DERIVED, VIEWS, table

BATCH_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
RUN_STATUS = """CASE o_custkey % 20 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' WHEN 3 THEN 'running' WHEN 4 THEN 'paused' WHEN 5 THEN 'uploading' WHEN 6 THEN 'uploading' WHEN 7 THEN 'completing'
 WHEN 8 THEN 'completing' WHEN 9 THEN 'completing' WHEN 10 THEN 'succeeded' WHEN 11 THEN 'succeeded' WHEN 12 THEN 'succeeded' WHEN 13 THEN 'failed' WHEN 14 THEN 'failed' WHEN 19 THEN 'cancelled' ELSE 'blocked' END"""
DERIVED |= {
    "ledger_runs": ("orders", None, {
        "run_id": "o_orderkey",
        "status": RUN_STATUS,
        "created_at": "o_orderdate",
        "started_at": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' HOUR END",
        "conflict_code": "CASE WHEN o_custkey % 20 BETWEEN 15 AND 18 THEN CASE o_orderkey % 3 WHEN 0 THEN 'UPLOAD_OUTCOME_UNKNOWN' WHEN 1 THEN 'DOMAIN_CHANGED' ELSE 'INTERRUPTED_NO_CHECKPOINT' END END",
        "resolved_at": "CASE WHEN o_custkey % 20 BETWEEN 13 AND 18 AND o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL '2' DAY END",
        "extraction_claim": "CASE WHEN (o_custkey % 20 BETWEEN 2 AND 3 AND o_orderkey % 4 <> 0) OR o_orderkey % 23 = 0 THEN 'x1' END",
        "completion_claim": "CASE WHEN o_custkey % 20 BETWEEN 7 AND 9 THEN CASE o_orderkey % 3 WHEN 0 THEN 'c1' WHEN 1 THEN 'c2' END WHEN o_orderkey % 29 = 0 THEN 'c1' END",
        "next_completion_at": "CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL '3' DAY WHEN 1 THEN o_orderdate + INTERVAL '900' DAY END",
        "completion_attempts": "CAST(o_orderkey % 25 AS INT)",
        "completion_bound": "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(5 + o_orderkey % 10 AS INT) END",
        "schedule_key": "CASE WHEN o_orderkey % 3 <> 0 THEN 'key-' || CAST(o_custkey AS STRING) END",
    }),
    "trace_runs": ("orders", None, {"run_id": "o_orderkey", "status": "CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'succeeded' END", "started_at": "CASE WHEN o_orderkey % 31 = 0 THEN 1 END", "extraction_claim": "CASE WHEN o_orderkey % 37 = 0 THEN 1 END", "completion_claim": "CASE WHEN o_orderkey % 41 = 0 THEN 1 END", "completion_bound": "CASE WHEN o_orderkey % 43 = 0 THEN 1 END", "next_completion_at": "CASE WHEN o_orderkey % 47 = 0 THEN 1 END", "completion_acknowledged_at": "CASE WHEN o_orderkey % 53 = 0 THEN 1 END", "sealed_at": "CASE WHEN o_orderkey % 59 = 0 THEN 1 END", "sealed_entities": "CASE WHEN o_orderkey % 61 = 0 THEN 1 END", "sealed_batches": "CASE WHEN o_orderkey % 67 = 0 THEN 1 END", "complete_payload": "CASE WHEN o_orderkey % 71 = 0 THEN 1 END", "finished_at": "CASE WHEN o_orderkey % 73 = 0 THEN 1 END", "resolved_at": "CASE WHEN o_orderkey % 79 = 0 THEN 1 END", "last_error": "CASE WHEN o_orderkey % 83 = 0 THEN 1 END", "conflict_code": "CASE WHEN o_orderkey % 89 = 0 THEN 1 END", "completion_attempts": "CASE WHEN o_orderkey % 31 = 1 THEN 1 ELSE 0 END", "error_count": "CASE WHEN o_orderkey % 37 = 1 THEN 1 ELSE 0 END", "rows_read": "CASE WHEN o_orderkey % 41 = 1 THEN 1 ELSE 0 END", "batches_created": "CASE WHEN o_orderkey % 43 = 1 THEN 1 ELSE 0 END", "batches_acknowledged": "CASE WHEN o_orderkey % 47 = 1 THEN 1 ELSE 0 END"}),
    "trace_jobs": ("orders", "o_orderkey % 3 <> 0", {"run_id": "o_orderkey", "status": "CASE WHEN o_orderkey % 13 = 0 THEN 'deferred' ELSE 'pending' END", "claim_attempts": "CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END", "dispatch_owner": "CASE WHEN o_orderkey % 31 = 2 THEN 1 END", "dispatch_claimed_at": "CASE WHEN o_orderkey % 37 = 2 THEN 1 END", "deferral_code": "CASE WHEN o_orderkey % 41 = 2 THEN 1 END", "deferral_message": "CASE WHEN o_orderkey % 43 = 2 THEN 1 END", "available_at": "CASE WHEN o_orderkey % 47 = 2 THEN 1 END"}),
    "trace_batches": ("lineitem", "l_orderkey % 7 = 0", {"run_id": "l_orderkey"}),
    "trace_entities": ("lineitem", "l_orderkey % 11 = 0", {"run_id": "l_orderkey"}),
    "trace_bindings": ("lineitem", "l_orderkey % 17 = 0", {"run_id": "l_orderkey"}),
    "trace_owners": ("lineitem", "l_orderkey % 19 = 0", {"owner_run_id": "l_orderkey"}),
    "known_versions": ("customer", None, {"agent": "c_custkey", "entity_name": "CASE c_custkey % 7 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN 'other' ELSE '5-LOW' END", "version": "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 20000 + c_custkey END"}),
    "spool_files": ("lineitem", None, {"path": "CASE l_partkey % 9 WHEN 0 THEN 'Spool/' ELSE 'spool/' END || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || CASE l_partkey % 23 WHEN 0 THEN '.tmp' WHEN 1 THEN '.orphan' WHEN 2 THEN '.ndjson.gz.old' ELSE '.ndjson.gz' END"}),
    "spool_batches": ("lineitem", "l_suppkey % 13 <> 0", {"file_path": "'spool/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '.NDJSON.gz'", "status": "CASE WHEN l_partkey % 10 = 0 THEN 'deleted' ELSE 'acknowledged' END"}),
    "dispatch_runs": ("orders", None, {
        "run_id": "o_orderkey",
        "status": "CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'running' END",
        "created_at": "o_orderdate",
        "mode": "CASE WHEN o_orderkey % 7 = 0 THEN 'bootstrap_full' ELSE 'entity_reload' END",
        "version": "o_custkey % 6",
        "schedule_key": "CASE WHEN o_orderkey % 43 = 0 THEN 'key' END",
        "manifest_valid": "o_orderkey % 211 <> 5",
        "inert": "o_orderkey % 1055 <> 5 OR o_orderdate < TIMESTAMP '1998-05-01'",
    }),
    "dispatch_jobs": ("orders", "o_orderkey % 5 <> 0", {
        "job_id": "o_orderkey + 1000000",
        "run_id": "CASE WHEN o_orderkey % 89 = 0 THEN -o_orderkey ELSE o_orderkey END",
        "status": "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'deferred' WHEN 2 THEN 'running' ELSE 'pending' END",
        "available_at": "CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '900' DAY WHEN 1 THEN o_orderdate END",
        "mode": "CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 37 <> 0 THEN 'bootstrap_full' ELSE 'entity_reload' END",
        "version": "CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN o_custkey % 6 + 1 ELSE o_custkey % 6 END",
    }),
    "dispatch_owners": ("part", None, {"entity_name": "CAST(p_partkey AS STRING)", "owner_run_id": "p_partkey", "released_at": "CASE WHEN p_partkey % 12 <> 0 THEN 1 END"}),
    "keys": ("customer", None, {"schedule_key": "'key-' || CAST(c_custkey AS STRING)"}),
    "ledger_batches": ("lineitem", None, {
        "batch_id": BATCH_ID,
        "run_id": "l_orderkey",
        "entity_name": "l_returnflag",
        "status": "CASE l_partkey % 12 WHEN 6 THEN 'ready' WHEN 7 THEN 'retry_waiting' WHEN 8 THEN 'creating' WHEN 9 THEN 'dead_letter' WHEN 10 THEN 'deleted' WHEN 11 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'uploading' ELSE 'ready' END ELSE 'acknowledged' END",
    }),
    "ledger_sends": ("lineitem", "l_linenumber <> 3", {
        "batch_id": BATCH_ID,
        "attempt_no": "1",
        "outcome": "CASE WHEN l_partkey % 12 < 6 THEN 'acknowledged' ELSE CASE l_suppkey % 31 WHEN 0 THEN 'admitted' WHEN 1 THEN 'unknown' WHEN 2 THEN 'rejected_ack' ELSE 'precheck_failed' END END",
    }),
    "ledger_jobs": ("orders", "o_orderkey % 2 = 0", {
        "job_id": "o_orderkey + 1000000",
        "command_id": "o_orderkey",
        "run_id": "o_orderkey",
        "status": "CASE o_orderkey % 7 WHEN 1 THEN 'running' WHEN 2 THEN 'finished' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'pending' WHEN 5 THEN 'deferred' ELSE 'blocked' END",
        "recovery_of": "CASE WHEN o_orderkey % 96 >= 16 THEN o_orderkey - 16 END",
    }),
    "ledger_resolutions": ("orders", None, {"run_id": "CASE WHEN o_orderkey % 11 = 2 THEN o_orderkey ELSE -o_orderkey END"}),
    "ledger_notices": ("orders", None, {
        "run_id": "o_orderkey",
        "status": "CASE o_orderkey % 4 WHEN 1 THEN 'sent' WHEN 2 THEN 'refused' ELSE 'pending' END",
        "attempt_count": "CAST(o_orderkey % 5 AS INT)",
        "next_attempt_at": "CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '3' DAY WHEN 1 THEN o_orderdate + INTERVAL '900' DAY END",
        "created_at": "o_orderdate",
    }),
    "commit_runs": ("customer", "c_custkey % 4 = 0", {"run_id": "c_custkey", "sealed": "CASE WHEN c_custkey % 52 = 0 THEN CAST(5 AS BIGINT) ELSE CAST(4 AS BIGINT) END"}),
    "commit_captured": ("customer", None, {
        "run_id": "c_custkey - c_custkey % 4",
        "entity_name": "c_name",
        "base_present": "(c_custkey % 3 <> 0) <> (c_custkey % 50 = 0)",
        "base_at": "CASE WHEN c_custkey % 31 = 0 THEN c_custkey * 10 + 1 ELSE c_custkey * 10 END",
        "base_generation": "CASE WHEN c_custkey % 37 = 0 THEN c_custkey % 4 + 1 ELSE c_custkey % 4 END",
        "base_fingerprint": "CASE WHEN c_custkey % 41 = 0 THEN 'X' WHEN c_custkey % 5 <> 0 THEN c_mktsegment END",
        "failure_code": "CASE WHEN c_custkey % 9 = 0 THEN 'READ_FAILED' END",
    }),
    "commit_bindings": ("customer", None, {"run_id": "c_custkey - c_custkey % 4", "entity_name": "c_name", "expected_epoch": "c_custkey % 3 + 1"}),
    "commit_owners": ("customer", None, {"owner_run_id": "c_custkey - c_custkey % 4", "entity_name": "c_name", "epoch": "CASE WHEN c_custkey % 47 = 0 THEN c_custkey % 3 + 2 ELSE c_custkey % 3 + 1 END", "released_at": "CASE WHEN c_custkey % 43 = 0 THEN 1 END"}),
    "older_batches": ("lineitem", None, {
        "run_id": "l_orderkey",
        "entity_name": "l_returnflag",
        "status": "CASE WHEN l_partkey % 60 = 0 THEN 'ready' ELSE 'acknowledged' END",
        "created_at": "l_shipdate",
        "cursor_to": "CASE WHEN l_partkey % 70 <> 0 THEN CAST(l_partkey AS STRING) END",
    }),
    "older_requested": ("lineitem", "l_orderkey % 17 <> 0 OR l_returnflag <> 'N'", {"run_id": "l_orderkey", "entity_name": "CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1 THEN 'Z' ELSE l_returnflag END"}),
    "endings": ("events", None, {
        "command_id": "event_id",
        "local_status": "CASE event_id % 5 WHEN 0 THEN 'succeeded_local' WHEN 1 THEN 'business_failed_local' WHEN 2 THEN 'expired' WHEN 3 THEN 'cancelled' ELSE 'dead_letter' END",
        "owner": "CASE WHEN event_id % 34 = 0 THEN 'w1' WHEN event_id % 6 = 1 THEN 'w2' END",
    }),
    "reports": ("events", None, {
        "command_id": "event_id",
        "to_status": "CASE WHEN event_id % 3 = 0 THEN 'unknown_result' ELSE 'retry_waiting' END",
        "owner": "CASE WHEN event_id % 34 = 0 THEN 'w1' WHEN event_id % 6 = 1 THEN 'w2' END",
        "retry_at": "CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL '3' HOUR END",
    }),
    "full_reads": ("events", None, {
        "event_id": "event_id",
        "scope": "CASE WHEN event_id % 7 = 0 THEN 'delta' ELSE 'full' END",
        "verify": "event_id % 11 <> 0",
        "count_failure": "CASE event_id % 31 WHEN 0 THEN 'COUNT_UNSUPPORTED' WHEN 1 THEN 'COUNT_FAILED' END",
        "key_failure": "CASE event_id % 29 WHEN 0 THEN 'KEY_PASS_UNSUPPORTED' WHEN 1 THEN 'KEY_PASS_FAILED' END",
        "count_after_failure": "CASE event_id % 23 WHEN 0 THEN 'COUNT_FAILED' END",
        "count_before": "user_id",
        "count_after": "CASE event_id % 19 WHEN 0 THEN user_id + 1 WHEN 1 THEN NULL ELSE user_id END",
        "rows": "CASE WHEN event_id % 17 = 0 THEN user_id - 1 ELSE user_id END",
        "keys": "CASE WHEN event_id % 13 = 0 THEN user_id + 2 ELSE user_id END",
        "row_digest": "event_type",
        "key_digest": "CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END",
    }),
    "answers": ("events", None, {"command_id": "event_id", "answer": "CASE event_id % 3 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'retry' ELSE 'conflict' END"}),
}
VIEWS |= {
    "ledger_bindings": ("SELECT DISTINCT l_orderkey AS run_id, l_returnflag AS entity_name, CAST(l_orderkey % 3 + 1 AS BIGINT) AS expected_epoch FROM {lineitem} WHERE l_orderkey % 6 <> 1", "lineitem"),
    "ledger_owners": ("SELECT DISTINCT l_returnflag AS entity_name, l_orderkey AS owner_run_id, CAST(CASE WHEN l_orderkey % 26 = 0 THEN l_orderkey % 3 + 2 ELSE l_orderkey % 3 + 1 END AS BIGINT) AS epoch, CASE WHEN l_orderkey % 20 = 3 THEN 1 END AS released_at FROM {lineitem}", "lineitem"),
    "frozen": ("SELECT DISTINCT l_orderkey AS run_id, l_returnflag AS entity_name FROM {lineitem} UNION ALL SELECT DISTINCT l_orderkey, 'Z' FROM {lineitem} WHERE l_orderkey % 9 = 0", "lineitem"),
    "older_runs": ("SELECT l_orderkey AS run_id, CASE WHEN l_orderkey % 13 = 0 THEN 'running' ELSE 'uploading' END AS status, count(*) + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS batches_created, count(*) + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END AS batches_acknowledged FROM {lineitem} GROUP BY l_orderkey", "lineitem"),
    "seal_counters": ("SELECT l_orderkey AS run_id, CASE WHEN l_orderkey % 13 = 0 THEN 'uploading' ELSE 'running' END AS status, count(*) + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS batches_created, sum(CAST(l_quantity AS BIGINT)) + CASE WHEN l_orderkey % 27 = 0 THEN 1 ELSE 0 END AS rows_read FROM {lineitem} GROUP BY l_orderkey", "lineitem"),
    # Six moments of each batch: claims, and what the receiver, the network, the worker or an older writer says in between.
    "send_events": (f"""SELECT run_id, batch_id, CAST(slot AS STRING) || '-' || batch_id AS place, kind, CAST(attempt AS INT) AS attempt, CASE WHEN kind = 'ack' THEN CASE WHEN (x + slot) % 5 = 0 THEN 'h2' ELSE 'h1' END END AS hash, kind = 'ack' AND x % 97 <> 3 AS valid FROM (
      SELECT run_id, batch_id, x, slot, attempt, CASE slot WHEN 1 THEN 'claim' WHEN 3 THEN CASE WHEN x % 3 = 0 THEN 'ack' ELSE 'claim' END WHEN 5 THEN CASE WHEN x % 29 = 4 THEN 'unsent' ELSE 'claim' END
         WHEN 2 THEN CASE WHEN x % 101 = 7 THEN 'fail' WHEN x % 103 = 8 THEN 'refuse' WHEN x % 89 = 9 THEN 'reset' WHEN x % 5 < 2 THEN 'unsent' ELSE 'ack' END
         WHEN 4 THEN CASE WHEN x % 83 = 1 THEN 'fail' WHEN x % 79 = 2 THEN 'reset' WHEN x % 7 = 3 THEN 'unsent' ELSE 'ack' END ELSE CASE WHEN x % 71 = 5 THEN 'refuse' ELSE 'ack' END END AS kind
      FROM (SELECT l_orderkey AS run_id, {BATCH_ID} AS batch_id, l_partkey * 7 + l_suppkey AS x, slot,
              CASE slot WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN (l_partkey + l_suppkey) % 37 = 0 THEN 2 ELSE 1 END WHEN 3 THEN CASE WHEN (l_partkey * 7 + l_suppkey) % 3 = 0 THEN 1 ELSE 2 END WHEN 4 THEN CASE WHEN (l_partkey * 7 + l_suppkey) % 3 = 0 OR (l_partkey + l_suppkey) % 41 = 0 THEN 1 ELSE 2 END WHEN 5 THEN 3 ELSE CASE WHEN (l_partkey + l_suppkey) % 43 = 0 THEN 2 ELSE 3 END END AS attempt
            FROM {{lineitem}} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS s(slot)) a) b""", "lineitem"),
}

# Stored bodies of completed runs, put together as text; one in three has a defect of one kind or another.
_ITEM = """CASE WHEN max(CASE WHEN entity_name = '{0}' THEN 1 ELSE 0 END) = 1 THEN '{{"entity":"{0}","status":"' || max(CASE WHEN entity_name = '{0}' THEN CASE WHEN failure_code IS NULL THEN 'done' ELSE 'failed' END END) || '","readScope":"' || max(CASE WHEN entity_name = '{0}' THEN read_scope END)
 || '","rowsRead":' || max(CASE WHEN entity_name = '{0}' THEN CAST(row_total AS STRING) || CASE WHEN run_id % 40 = 11 THEN '.0' ELSE '' END END) || ',"batchesCreated":' || max(CASE WHEN entity_name = '{0}' THEN CAST(batches AS STRING) END)
 || max(CASE WHEN entity_name = '{0}' AND run_id % 40 <> 9 THEN ',"errorCode":' || coalesce('"' || failure_code || '"', 'null') ELSE '' END) || ',"errorMessage":' || coalesce(max(CASE WHEN entity_name = '{0}' THEN '"' || failure_message || '"' END), 'null')
 || max(CASE WHEN entity_name = '{0}' AND completeness IS NOT NULL THEN ',"completeness":"' || completeness || '","completenessReason":' || coalesce('"' || completeness_reason || '"', 'null') ELSE '' END)
 || max(CASE WHEN entity_name = '{0}' AND snapshot_at IS NOT NULL THEN ',"snapshotAtUtc":"' || snapshot_at || '"' ELSE '' END) || '}}' END"""
_RUN = """SELECT l_orderkey AS run_id, CASE WHEN l_orderkey % 2 = 0 THEN 'incremental' WHEN l_orderkey % 61 = 0 THEN 'other' ELSE 'bootstrap_full' END AS mode, sum(CAST(l_quantity AS BIGINT)) AS rows_read, count(*) AS batches_created, count(*) AS batches_acknowledged,
 CASE WHEN l_orderkey % 3 <> 0 THEN 'db-7' END AS database_id, CASE WHEN l_orderkey % 3 <> 0 THEN 'epoch-2' END AS export_epoch, CASE WHEN l_orderkey % 3 <> 0 THEN 'prod' END AS environment, CASE WHEN l_orderkey % 5 <> 0 THEN 'g1' END AS generation FROM {lineitem} GROUP BY l_orderkey"""
_ENTITY = """SELECT l_orderkey AS run_id, l_returnflag AS entity_name, sum(CAST(l_quantity AS BIGINT)) AS row_total, count(*) AS batches, CASE WHEN l_orderkey % 12 = 0 AND l_returnflag <> 'N' THEN 'READ_FAILED' END AS failure_code, CASE WHEN l_orderkey % 12 = 0 AND l_returnflag <> 'N' THEN 'could not read' END AS failure_message,
 CASE WHEN l_orderkey % 2 = 0 THEN 'delta' ELSE 'full' END AS read_scope, CASE WHEN l_orderkey % 4 = 1 THEN 'verified' WHEN l_orderkey % 4 = 3 THEN 'unverified' END AS completeness, CASE WHEN l_orderkey % 4 = 3 THEN 'COUNT_CHANGED' END AS completeness_reason, CASE WHEN l_orderkey % 5 = 0 THEN '2024-01-05T00:00:00Z' END AS snapshot_at
 FROM {lineitem} GROUP BY l_orderkey, l_returnflag"""
VIEWS |= {
    "stored_runs": (_RUN, "lineitem"),
    "stored_entities": (_ENTITY, "lineitem"),
    "stored_bodies": (f"""SELECT r.run_id, CASE WHEN r.run_id % 40 = 16 THEN '[]' ELSE '{{{{"runId":"' || CASE WHEN r.run_id % 40 = 1 THEN 'x' ELSE '' END || CAST(r.run_id AS STRING) || '","status":"' || CASE WHEN e.failed > 0 THEN 'partial_success' ELSE 'succeeded' END || '","mode":"' || mode || '"' || CASE r.run_id % 40 WHEN 4 THEN ',"mode":"x"' WHEN 5 THEN ',"Mode":"x"' WHEN 10 THEN ',"more":1' ELSE '' END
      || ',"rowsRead":' || CASE r.run_id % 40 WHEN 2 THEN CAST(rows_read + 1 AS STRING) WHEN 3 THEN '"' || CAST(rows_read AS STRING) || '"' ELSE CAST(rows_read AS STRING) END || ',"batchesCreated":' || CAST(batches_created AS STRING) || ',"batchesAcknowledged":' || CAST(batches_acknowledged AS STRING)
      || CASE r.run_id % 40 WHEN 6 THEN '' WHEN 7 THEN ',"completedAtUtc":"soon"' ELSE ',"completedAtUtc":"2024-01-06T07:08:09Z"' END || ',"entitiesFailed":' || CAST(e.failed + CASE WHEN r.run_id % 40 = 13 THEN 1 ELSE 0 END AS STRING)
      || coalesce(',"sourceIdentity":{{{{"databaseId":"' || database_id || '","exportEpoch":"' || CASE WHEN r.run_id % 40 = 14 THEN 'epoch-3' ELSE export_epoch END || '","environment":"' || environment || '"}}}}', '') || CASE WHEN r.run_id % 40 = 15 THEN '' ELSE coalesce(',"sourceGeneration":"' || generation || '"', '') END
      || ',"entities":[' || CASE WHEN r.run_id % 40 = 8 THEN concat_ws(',', e.r, e.n, e.a) ELSE concat_ws(',', e.a, e.n, e.r) END || ']' || CASE WHEN r.run_id % 40 = 12 THEN '' ELSE '}}}}' END END AS body
      FROM ({_RUN}) r JOIN (SELECT run_id, count(failure_code) AS failed, {_ITEM.format('A').replace('{', '{{').replace('}', '}}')} AS a, {_ITEM.format('N').replace('{', '{{').replace('}', '}}')} AS n, {_ITEM.format('R').replace('{', '{{').replace('}', '}}')} AS r FROM ({_ENTITY}) x GROUP BY run_id) e ON e.run_id = r.run_id""".replace("{{{{", "{{").replace("}}}}", "}}"), "lineitem"),
}


def _tables(spark, d, *names: str):
    return [table(spark, d, n) for n in names]


# --- commands -----------------------------------------------------------------------------------------------------
@query(
    "queue_recovery",
    """SELECT unnest(CASE WHEN status = 'executing' THEN ['command'] WHEN coalesce(exec_claim_owner_id, exec_claim_acquired_at::VARCHAR) IS NOT NULL THEN ['claim'] ELSE [] END) AS kind, command_id AS id, status AS from_status,
      if(status = 'executing', 'unknown_result', status) AS to_status, if(status = 'executing', 'PROCESS_RESTART', NULL) AS code FROM commands WHERE status NOT IN ('completed', 'cancelled', 'expired', 'dead_letter', 'result_pending')
    UNION ALL SELECT 'result', command_id, 'sending', 'pending', NULL FROM results WHERE status = 'sending'""",
    "commands",
    "results",
)
def queue_recovery(spark, d):
    return q.queue_recovery(commands=table(spark, d, "commands"), results=table(spark, d, "results"))


@query(
    "reschedule",
    """SELECT c.command_id, r.to_status AS status, ifnull(r.retry_at, TIMESTAMP '2024-01-25 00:00:02') AS next_attempt_at FROM commands c, reports r
    WHERE r.command_id = c.command_id AND c.status NOT IN ('completed', 'cancelled', 'expired', 'dead_letter', 'result_pending') AND coalesce(r.owner, '-') = coalesce(c.exec_claim_owner_id, '-')""",
    "commands",
    "reports",
)
def reschedule(spark, d):
    return q.reschedule(*_tables(spark, d, "commands", "reports"), F.lit(dt.datetime(2024, 1, 25)).cast("timestamp_ntz"))


@query(
    "finish_commands",
    """, t AS (SELECT c.command_id, c.status, e.local_status, (SELECT any_value(o.status) FROM results o WHERE o.command_id = c.command_id) AS out,
        c.status IN ('queued', 'retry_waiting', 'executing', 'unknown_result') AND coalesce(e.owner, '-') = coalesce(c.exec_claim_owner_id, '-')
          AND NOT (e.local_status = 'cancelled' AND (c.status IN ('executing', 'unknown_result') OR c.attempt_count + c.post_attempt_count > 0 OR c.first_sent_at IS NOT NULL)) AS finished
        FROM commands c JOIN endings e USING (command_id))
    SELECT command_id, finished, if(finished, 'result_pending', status) AS status, if(finished, local_status, NULL) AS result_status, if(finished AND out IS DISTINCT FROM 'acknowledged', 'pending', out) AS outbox_status FROM t""",
    "commands",
    "results",
    "endings",
)
def finish_commands(spark, d):
    return q.finish(*_tables(spark, d, "commands", "results", "endings"))


@query(
    "outbox_due",
    """SELECT result_id, command_id, attempt_count, (SELECT c.command_type FROM commands c WHERE c.command_id = o.command_id) AS command_type FROM results o
    WHERE status IN ('pending', 'retry_waiting') AND coalesce(next_attempt_at, TIMESTAMP '2024-01-01') <= TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (ORDER BY created_at, result_id) <= 50""",
    "results",
    "commands",
)
def outbox_due(spark, d):
    return q.outbox_due(results=table(spark, d, "results"), commands=table(spark, d, "commands"))


@query(
    "outbox_transitions",
    """, t AS (SELECT a.command_id, a.answer, (SELECT any_value(status) FROM results o WHERE o.command_id = a.command_id) AS out, (SELECT any_value(status) FROM commands c WHERE c.command_id = a.command_id) AS cs,
        EXISTS (SELECT 1 FROM commands c WHERE c.command_id = a.command_id AND c.status IN ('result_pending', 'completed') AND c.result_status IS NOT NULL AND c.result_json IS NOT NULL) AS held FROM answers a),
    u AS (SELECT *, ifnull(out NOT IN ('acknowledged', 'dead_letter') AND (held OR answer = 'conflict'), FALSE) AS applied FROM t)
    SELECT command_id, applied, CASE WHEN NOT applied THEN out WHEN answer = 'acknowledged' THEN answer WHEN answer = 'retry' THEN 'retry_waiting' ELSE 'dead_letter' END AS outbox_status, if(applied AND answer = 'acknowledged', 'completed', cs) AS command_status FROM u""",
    "results",
    "commands",
    "answers",
)
def outbox_transitions(spark, d):
    return q.outbox_transitions(*_tables(spark, d, "results", "commands", "answers"))


# --- runs ---------------------------------------------------------------------------------------------------------
LEDGER = ("ledger_runs", "ledger_entities", "ledger_batches", "ledger_sends", "ledger_jobs")
DOWN = """, s AS (SELECT batch_id FROM ledger_batches WHERE status = 'uploading' UNION SELECT batch_id FROM ledger_batches JOIN ledger_sends x USING (batch_id) WHERE status IN ('creating', 'ready', 'retry_waiting') AND x.outcome <> 'precheck_failed'),
    hit AS (SELECT run_id FROM ledger_runs WHERE status NOT IN ('succeeded', 'failed', 'blocked', 'cancelled') AND run_id IN (SELECT run_id FROM ledger_batches WHERE batch_id IN (SELECT batch_id FROM s))),
    cut AS (SELECT run_id FROM ledger_runs WHERE status = 'running' EXCEPT SELECT run_id FROM hit),
    down AS (SELECT run_id FROM hit UNION SELECT run_id FROM cut UNION SELECT run_id FROM ledger_runs WHERE status = 'blocked' AND conflict_code <> 'DOMAIN_CHANGED')"""


@query(
    "startup_recovery",
    DOWN
    + """ SELECT 'attempt' AS kind, batch_id || '#1' AS id, 'admitted' AS from_status, 'orphaned' AS to_status, 'UPLOAD_OUTCOME_UNKNOWN' AS code FROM ledger_sends WHERE outcome = 'admitted'
    UNION ALL SELECT 'batch', batch_id, status, 'dead_letter', 'UPLOAD_OUTCOME_UNKNOWN' FROM ledger_batches WHERE batch_id IN (SELECT batch_id FROM s)
    UNION ALL SELECT 'batch', batch_id, status, 'dead_letter', 'RUN_BLOCKED' FROM ledger_batches WHERE batch_id NOT IN (SELECT batch_id FROM s) AND status IN ('creating', 'ready', 'retry_waiting', 'uploading') AND run_id IN (SELECT run_id FROM down)
    UNION ALL SELECT 'run', run_id::VARCHAR, status, 'blocked', 'UPLOAD_OUTCOME_UNKNOWN' FROM ledger_runs WHERE run_id IN (SELECT run_id FROM hit)
    UNION ALL SELECT 'run', run_id::VARCHAR, status, 'blocked', 'INTERRUPTED_NO_CHECKPOINT' FROM ledger_runs WHERE run_id IN (SELECT run_id FROM cut)
    UNION ALL SELECT 'claim', run_id::VARCHAR, 'completion', 'released', NULL FROM ledger_runs WHERE status = 'completing' AND completion_claim IS NOT NULL
    UNION ALL SELECT 'claim', run_id::VARCHAR, 'extraction', 'released', NULL FROM ledger_runs WHERE extraction_claim IS NOT NULL AND run_id IN (SELECT run_id FROM hit UNION SELECT run_id FROM cut)
    UNION ALL SELECT 'entity', run_id || '/' || entity_name, 'extracting', 'failed', 'RUN_INTERRUPTED' FROM entities WHERE status = 'extracting' AND run_id IN (SELECT run_id FROM down)
    UNION ALL SELECT 'job', job_id::VARCHAR, status, 'blocked', NULL FROM ledger_jobs WHERE status IN ('pending', 'deferred', 'running') AND run_id IN (SELECT run_id FROM down)""",
    "ledger_runs",
    "ledger_batches",
    "ledger_sends",
    "ledger_jobs",
    "entities",
)
def startup_recovery(spark, d):
    runs, batches, sends, jobs, entities = _tables(spark, d, "ledger_runs", "ledger_batches", "ledger_sends", "ledger_jobs", "entities")
    return lg.startup_recovery(runs=runs, batches=batches, sends=sends, jobs=jobs, entities=entities)


@query(
    "fence_legacy",
    """, old AS (SELECT run_id, status FROM ledger_runs WHERE status IN ('running', 'uploading', 'completing') AND run_id NOT IN (SELECT run_id FROM ledger_bindings))
    SELECT 'run' AS kind, run_id::VARCHAR AS id, status AS from_status, 'blocked' AS to_status, 'LEGACY_UNRESOLVED' AS code FROM old
    UNION ALL SELECT 'batch', batch_id, status, 'dead_letter', 'RUN_BLOCKED' FROM ledger_batches b WHERE status IN ('creating', 'ready', 'retry_waiting') AND EXISTS (SELECT 1 FROM old WHERE old.run_id = b.run_id)""",
    "ledger_runs",
    "ledger_batches",
    "ledger_bindings",
)
def fence_legacy(spark, d):
    runs, batches, bindings = _tables(spark, d, "ledger_runs", "ledger_batches", "ledger_bindings")
    return lg.fence_legacy(runs=runs, batches=batches, bindings=bindings)


@query(
    "dispatch_outcomes",
    """, p AS (SELECT * FROM dispatch_runs WHERE status = 'pending'), wanted AS (SELECT DISTINCT run_id, entity_name FROM manifests),
    hold AS (SELECT created_at, run_id FROM p WHERE NOT manifest_valid AND NOT inert ORDER BY created_at, run_id LIMIT 1),
    elder AS (SELECT DISTINCT a.run_id FROM p a JOIN wanted x ON x.run_id = a.run_id JOIN wanted y ON y.entity_name = x.entity_name JOIN p b ON b.run_id = y.run_id WHERE b.manifest_valid AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.run_id < a.run_id)))
    SELECT j.job_id, j.run_id, CASE WHEN p.run_id IS NULL OR NOT p.manifest_valid OR p.schedule_key IS NOT NULL OR j.mode <> p.mode OR j.version IS DISTINCT FROM p.version OR p.run_id NOT IN (SELECT run_id FROM wanted)
        OR EXISTS (SELECT 1 FROM wanted m WHERE m.run_id = j.run_id AND NOT EXISTS (SELECT 1 FROM job_manifests f WHERE f.run_id = m.run_id AND f.entity_name = m.entity_name)) OR EXISTS (SELECT 1 FROM job_manifests f WHERE f.run_id = j.run_id AND NOT EXISTS (SELECT 1 FROM wanted m WHERE m.run_id = f.run_id AND f.entity_name = m.entity_name)) THEN 'JOB_MANIFEST_INCONSISTENT'
      WHEN EXISTS (SELECT 1 FROM hold h WHERE h.created_at < p.created_at OR (h.created_at = p.created_at AND h.run_id < p.run_id)) THEN 'elder_manifest_invalid' WHEN p.run_id IN (SELECT run_id FROM elder) THEN 'queued_overlap'
      WHEN EXISTS (SELECT 1 FROM wanted m JOIN dispatch_owners o ON o.entity_name = m.entity_name WHERE m.run_id = p.run_id AND o.released_at IS NULL AND o.owner_run_id <> p.run_id) THEN 'busy_entity' ELSE 'claimable' END AS outcome
    FROM dispatch_jobs j LEFT JOIN p ON p.run_id = j.run_id WHERE j.status IN ('pending', 'deferred') AND coalesce(j.available_at <= TIMESTAMP '1999-01-01', TRUE)""",
    "dispatch_runs",
    "dispatch_jobs",
    "dispatch_owners",
    "manifests",
    "job_manifests",
)
def dispatch_outcomes(spark, d):
    return lg.dispatch_outcomes(*_tables(spark, d, "dispatch_jobs", "dispatch_runs", "manifests", "job_manifests", "dispatch_owners"), F.lit(dt.datetime(1999, 1, 1)).cast("timestamp_ntz"))


relational("dead_letter_files", r.dead_letter_files, batches="batches", runs="ledger_runs", entities="entities")


# The predicate, column by column.
@query(
    "inert_runs",
    f"""SELECT run_id FROM trace_runs r WHERE status = 'pending' AND coalesce({", ".join(lg.NEVER_SET)}) IS NULL AND {" + ".join(lg.NEVER_COUNTED)} = 0
      AND NOT EXISTS (SELECT 1 FROM trace_batches b WHERE b.run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM trace_entities e WHERE e.run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM trace_bindings g WHERE g.run_id = r.run_id)
      AND NOT EXISTS (SELECT 1 FROM trace_owners o WHERE o.owner_run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM trace_jobs j WHERE j.run_id = r.run_id AND NOT (j.status = 'pending' AND j.claim_attempts = 0 AND coalesce({", ".join(lg.JOB_NEVER_SET)}) IS NULL))""",
    "trace_runs",
    "trace_batches",
    "trace_entities",
    "trace_bindings",
    "trace_owners",
    "trace_jobs",
)
def inert_runs(spark, d):
    runs, *rest = _tables(spark, d, "trace_runs", "trace_batches", "trace_entities", "trace_bindings", "trace_owners", "trace_jobs")
    return lg.inert(runs.filter("status = 'pending'"), *rest)


@query(
    "config_answers",
    """, top AS (SELECT entity_name, version FROM configs WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY version DESC) = 1)
    SELECT agent, CASE WHEN entity_name NOT IN (SELECT entity_name FROM top) THEN 'absent' WHEN (entity_name, version) IN (SELECT (entity_name, version) FROM top) THEN 'unchanged' ELSE 'new' END AS answer,
      (SELECT any_value(t.version) FROM top t WHERE t.entity_name = k.entity_name AND t.version IS DISTINCT FROM k.version) AS version FROM known_versions k""",
    "known_versions",
    "configs",
)
def config_answers(spark, d):
    return lg.config_answers(known=table(spark, d, "known_versions"), configs=table(spark, d, "configs"))


@query(
    "set_aside_files",
    "SELECT path, if(right(path, 4) = '.tmp', 'temporary', 'orphan') AS kind FROM spool_files WHERE NOT contains(path, '.orphan') AND (path LIKE '%.tmp' OR lower(path) NOT IN (SELECT lower(file_path) FROM spool_batches WHERE status <> 'deleted'))",
    "spool_files",
    "spool_batches",
)
def set_aside_files(spark, d):
    return lg.set_aside(files=table(spark, d, "spool_files"), batches=table(spark, d, "spool_batches"))


REVOKED_SQL = "SELECT run_id, entity_name FROM entities WHERE sensitive AND entity_name NOT IN (SELECT entity_name FROM flags) AND run_id IN (SELECT run_id FROM ledger_runs WHERE status NOT IN ('succeeded', 'failed', 'blocked', 'cancelled'))"


@query("revoked_entities", REVOKED_SQL, "ledger_runs", "entities", "flags")
def revoked_entities(spark, d):
    return lg.revoked(runs=table(spark, d, "ledger_runs"), entities=table(spark, d, "entities"), definitions=table(spark, d, "flags"))


@query(
    "revoked_cascade",
    f""", hit AS (SELECT DISTINCT run_id FROM ({REVOKED_SQL}) x)
    SELECT 'run' AS kind, run_id::VARCHAR AS id, status AS from_status, 'blocked' AS to_status, 'ENTITY_REVOKED' AS code FROM ledger_runs WHERE run_id IN (SELECT run_id FROM hit)
    UNION ALL SELECT 'entity', run_id || '/' || entity_name, status, 'failed', 'ENTITY_REVOKED' FROM entities WHERE status = 'extracting' AND run_id IN (SELECT run_id FROM hit)
    UNION ALL SELECT 'batch', batch_id, status, 'dead_letter', 'RUN_BLOCKED' FROM ledger_batches WHERE status NOT IN ('acknowledged', 'dead_letter', 'deleted') AND run_id IN (SELECT run_id FROM hit)
    UNION ALL SELECT 'job', job_id::VARCHAR, status, 'blocked', NULL FROM ledger_jobs WHERE status IN ('pending', 'deferred', 'running') AND run_id IN (SELECT run_id FROM hit)""",
    "ledger_runs",
    "ledger_batches",
    "ledger_jobs",
    "entities",
    "flags",
)
def revoked_cascade(spark, d):
    null = F.lit(None).cast("string")
    revoking = lg.revoking(runs=table(spark, d, "ledger_runs"), entities=table(spark, d, "entities"), definitions=table(spark, d, "flags"))
    causes = revoking.select("run_id", F.lit("ENTITY_REVOKED").alias("code"), null.alias("batch_id"), null.alias("batch_code"))
    return lg.blocked(*_tables(spark, d, "ledger_runs", "entities", "ledger_batches", "ledger_jobs"), causes)


REFUSAL_SQL = """CASE WHEN r.run_id IN (SELECT run_id FROM ledger_resolutions) THEN 'AlreadyResolved' WHEN r.resolved_at IS NOT NULL OR r.status NOT IN ('failed', 'blocked') THEN 'RunNotResolvable'
      WHEN r.run_id IN (SELECT b.run_id FROM ledger_batches b JOIN ledger_sends x ON x.batch_id = b.batch_id WHERE x.outcome = 'admitted') THEN 'AdmittedSendAttempt'
      WHEN r.run_id IN (SELECT run_id FROM ledger_batches WHERE status = 'uploading') THEN 'BatchInFlight' WHEN r.extraction_claim IS NOT NULL THEN 'LiveExtractionClaim' WHEN r.completion_claim IS NOT NULL THEN 'LiveCompletionClaim'
      WHEN r.run_id IN (SELECT run_id FROM ledger_jobs WHERE status NOT IN ('blocked', 'finished', 'cancelled')) THEN 'LiveJobDispatch' END"""


@query(
    "manual_resolution",
    f""", t AS (SELECT r.run_id, {REFUSAL_SQL} AS refusal FROM ledger_runs r)
    SELECT run_id, coalesce(refusal, 'Resolved') AS outcome, CASE WHEN refusal IS NULL THEN (SELECT count(*) FROM ledger_batches b WHERE b.run_id = t.run_id AND b.status IN ('creating', 'ready', 'retry_waiting')) END AS batches_fenced,
      CASE WHEN refusal IS NULL THEN (SELECT count(*) FROM ledger_owners o WHERE o.owner_run_id = t.run_id AND o.released_at IS NULL AND EXISTS (SELECT 1 FROM ledger_bindings g WHERE g.run_id = o.owner_run_id AND g.entity_name = o.entity_name AND g.expected_epoch = o.epoch)) END AS ownership_released FROM t""",
    "ledger_runs",
    "ledger_batches",
    "ledger_sends",
    "ledger_jobs",
    "ledger_resolutions",
    "ledger_owners",
    "ledger_bindings",
)
def manual_resolution(spark, d):
    return lg.manual_resolution(*_tables(spark, d, "ledger_runs", "ledger_batches", "ledger_sends", "ledger_jobs", "ledger_resolutions", "ledger_owners", "ledger_bindings"))


@query(
    "auto_recovery",
    f"""/* the chain of each job, walked one recovery at a time */
    , chain AS (SELECT j.run_id, j.recovery_of AS up, 0 AS depth FROM ledger_jobs j UNION ALL SELECT c.run_id, (SELECT any_value(k.recovery_of) FROM ledger_jobs k WHERE k.run_id = c.up), c.depth + 1 FROM chain c WHERE c.up IS NOT NULL),
    deep AS (SELECT run_id, max(depth) AS depth FROM chain GROUP BY run_id),
    t AS (SELECT r.run_id, {REFUSAL_SQL} AS refusal, (SELECT any_value(d.depth) FROM deep d WHERE d.run_id = r.run_id) AS depth,
            r.run_id IN (SELECT run_id FROM ledger_batches WHERE status IN ('acknowledged', 'deleted')) OR r.run_id IN (SELECT j.run_id FROM ledger_jobs j JOIN results o ON o.command_id = j.command_id WHERE o.status = 'acknowledged') AS known
          FROM ledger_runs r WHERE r.status = 'blocked' AND r.conflict_code = 'INTERRUPTED_NO_CHECKPOINT' AND r.resolved_at IS NULL),
    u AS (SELECT *, CASE WHEN depth >= 3 THEN 'LimitReached' WHEN refusal IS NOT NULL THEN 'Refused' WHEN depth IS NULL THEN 'ScheduledReleased' ELSE 'Requeued' END AS outcome FROM t)
    SELECT run_id, outcome, CAST(CASE WHEN depth IS NULL THEN 0 WHEN outcome = 'LimitReached' THEN depth ELSE depth + 1 END AS BIGINT) AS attempt, CASE outcome WHEN 'Refused' THEN refusal END AS refusal, outcome IN ('ScheduledReleased', 'Requeued') AND known AS notice FROM u""",
    "ledger_runs",
    "ledger_batches",
    "ledger_sends",
    "ledger_jobs",
    "ledger_resolutions",
    "results",
)
def auto_recovery(spark, d):
    return lg.auto_recovery(*_tables(spark, d, "ledger_runs", "ledger_batches", "ledger_sends", "ledger_jobs", "ledger_resolutions", "results"))


@query(
    "closing_notices",
    """SELECT r.run_id, f.entity_name, coalesce((SELECT any_value(e.failure_code) FROM entities e WHERE e.run_id = r.run_id AND e.entity_name = f.entity_name), r.conflict_code, 'RUN_FAILED') AS code,
      coalesce((SELECT any_value(e.expected_rows) FROM entities e WHERE e.run_id = r.run_id AND e.entity_name = f.entity_name), 0)::BIGINT AS rows_read, coalesce((SELECT any_value(e.expected_batches) FROM entities e WHERE e.run_id = r.run_id AND e.entity_name = f.entity_name), 0)::BIGINT AS batches_created,
      (SELECT count(*) FROM ledger_batches b WHERE b.run_id = r.run_id AND b.status IN ('acknowledged', 'deleted')) AS batches_acknowledged
    FROM ledger_runs r JOIN frozen f USING (run_id) WHERE r.status IN ('failed', 'blocked') AND r.resolved_at IS NULL
      AND (r.run_id IN (SELECT run_id FROM ledger_batches WHERE status IN ('acknowledged', 'deleted')) OR r.run_id IN (SELECT j.run_id FROM ledger_jobs j JOIN results o USING (command_id) WHERE o.status = 'acknowledged'))""",
    "ledger_runs",
    "ledger_batches",
    "ledger_jobs",
    "results",
    "entities",
    "frozen",
)
def closing_notices(spark, d):
    names = ("ledger_runs", "ledger_batches", "ledger_jobs", "results", "entities", "frozen")
    return lg.notices(**{n.removeprefix("ledger_"): table(spark, d, n) for n in names})


@query("notice_queue", "SELECT run_id, attempt_count FROM ledger_notices WHERE status = 'pending' AND coalesce(next_attempt_at <= TIMESTAMP '1998-06-01', TRUE) QUALIFY row_number() OVER (ORDER BY created_at, run_id) <= 100", "ledger_notices")
def notice_queue(spark, d):
    return lg.notice_queue(notices=table(spark, d, "ledger_notices"))


@query(
    "due_completions",
    "SELECT run_id, status = 'completing' AS again FROM ledger_runs WHERE status = 'uploading' OR (status = 'completing' AND completion_claim IS NULL AND coalesce(next_completion_at, TIMESTAMP '1900-01-01') <= TIMESTAMP '1998-06-01') QUALIFY row_number() OVER (ORDER BY ifnull(started_at, created_at), run_id) <= 50",
    "ledger_runs",
)
def due_completions(spark, d):
    return lg.due_completions(runs=table(spark, d, "ledger_runs"))


@query(
    "completion_retry",
    "SELECT run_id, if(ifnull(status = 'completing' AND completion_claim = 'c1', FALSE), if(completion_attempts < ifnull(completion_bound, 20), 'Scheduled', 'Blocked'), 'ClaimLost') AS outcome FROM ledger_runs WHERE status IN ('completing', 'uploading', 'succeeded')",
    "ledger_runs",
)
def completion_retry(spark, d):
    return lg.completion_retry(runs=table(spark, d, "ledger_runs"))


@query(
    "create_scheduled",
    "SELECT schedule_key FROM keys WHERE schedule_key NOT IN (SELECT schedule_key FROM ledger_runs WHERE schedule_key IS NOT NULL AND (status IN ('pending', 'running', 'paused', 'uploading', 'completing') OR (status IN ('failed', 'blocked') AND resolved_at IS NULL)))",
    "keys",
    "ledger_runs",
)
def create_scheduled(spark, d):
    return lg.create_scheduled(keys=table(spark, d, "keys"), runs=table(spark, d, "ledger_runs"))


@query(
    "finalize_commit",
    """, t AS (SELECT b.run_id, b.entity_name, CASE WHEN b.failure_code IS NOT NULL THEN NULL WHEN b.base_present AND c.entity_name IS NULL THEN 'ROW_VANISHED' WHEN NOT b.base_present AND c.entity_name IS NOT NULL THEN 'ROW_UNEXPECTEDLY_PRESENT'
        WHEN NOT b.base_present THEN NULL WHEN c.generation <> b.base_generation THEN 'GENERATION_MISMATCH' WHEN c.cursor_at <> b.base_at THEN 'BASE_CURSOR_MISMATCH' WHEN c.fingerprint IS DISTINCT FROM b.base_fingerprint THEN 'DOMAIN_MISMATCH' END AS conflict, b.failure_code
        FROM commit_captured b LEFT JOIN cursors c ON c.entity_name = b.entity_name),
    u AS (SELECT r.run_id, r.sealed, (SELECT arg_min(conflict, entity_name) FROM t WHERE t.run_id = r.run_id AND conflict IS NOT NULL) AS conflict, (SELECT min(entity_name) FROM t WHERE t.run_id = r.run_id AND conflict IS NOT NULL) AS entity,
          (SELECT count(*) FROM commit_owners o JOIN commit_bindings g ON g.run_id = o.owner_run_id AND g.entity_name = o.entity_name AND g.expected_epoch = o.epoch WHERE o.owner_run_id = r.run_id AND o.released_at IS NULL) AS freed,
          (SELECT count(failure_code) FROM t WHERE t.run_id = r.run_id) AS skipped FROM commit_runs r)
    SELECT run_id, CASE WHEN conflict IS NOT NULL THEN conflict WHEN freed <> sealed THEN 'OWNERSHIP_RELEASE_MISMATCH' ELSE 'Finalized' END AS outcome, entity, skipped FROM u""",
    "commit_runs",
    "commit_captured",
    "cursors",
    "commit_owners",
    "commit_bindings",
)
def finalize_commit(spark, d):
    return lg.commit(*_tables(spark, d, "commit_runs", "commit_captured", "cursors", "commit_owners", "commit_bindings"))


@query(
    "older_readiness",
    """, ok AS (SELECT run_id FROM older_runs r WHERE status = 'uploading' AND batches_created = batches_acknowledged AND batches_created = (SELECT count(*) FROM older_batches b WHERE b.run_id = r.run_id)
        AND NOT EXISTS (SELECT 1 FROM older_batches b WHERE b.run_id = r.run_id AND (b.status <> 'acknowledged' OR b.cursor_to IS NULL))
        AND (SELECT list_sort(list(DISTINCT entity_name)) FROM older_batches b WHERE b.run_id = r.run_id) = (SELECT list_sort(list(DISTINCT entity_name)) FROM older_requested m WHERE m.run_id = r.run_id)),
    last AS (SELECT run_id, entity_name, list(DISTINCT cursor_to) AS c FROM (SELECT *, rank() OVER (PARTITION BY run_id, entity_name ORDER BY created_at DESC) AS place FROM older_batches) x WHERE place = 1 GROUP BY run_id, entity_name)
    SELECT run_id, entity_name, if(len(c) = 1, c[1], NULL) AS cursor_to, len(c) > 1 AS tied FROM last WHERE run_id IN (SELECT run_id FROM ok)""",
    "older_runs",
    "older_batches",
    "older_requested",
)
def older_readiness(spark, d):
    return lg.older_readiness(runs=table(spark, d, "older_runs"), batches=table(spark, d, "older_batches"), requested=table(spark, d, "older_requested"))


@query(
    "missing_file_blocks",
    """, lost AS (SELECT batch_id, run_id FROM ledger_batches WHERE status IN ('ready', 'retry_waiting') AND batch_id NOT IN (SELECT batch_id FROM files))
    SELECT 'batch' AS kind, batch_id AS id, status AS from_status, 'dead_letter' AS to_status, if(batch_id IN (SELECT batch_id FROM lost), 'SPOOL_FILE_MISSING', 'RUN_BLOCKED') AS code FROM ledger_batches WHERE status IN ('creating', 'ready', 'retry_waiting') AND run_id IN (SELECT run_id FROM lost)
    UNION ALL SELECT 'run', run_id::VARCHAR, status, 'blocked', 'SPOOL_FILE_MISSING' FROM ledger_runs WHERE status IN ('running', 'uploading', 'completing') AND run_id IN (SELECT run_id FROM lost)
    UNION ALL SELECT 'job', job_id::VARCHAR, status, 'blocked', NULL FROM ledger_jobs WHERE status IN ('pending', 'deferred', 'running') AND run_id IN (SELECT run_id FROM lost)""",
    "ledger_runs",
    "ledger_batches",
    "ledger_jobs",
    "files",
)
def missing_file_blocks(spark, d):
    runs, batches, jobs, files = _tables(spark, d, "ledger_runs", "ledger_batches", "ledger_jobs", "files")
    return lg.missing_file_blocks(runs=runs, batches=batches, jobs=jobs, files=files)


@query(
    "seal_runs",
    """, sums AS (SELECT e.*, (SELECT count(*) FROM batches b WHERE b.run_id = e.run_id AND b.entity_name = e.entity_name) AS n, (SELECT coalesce(sum(row_count), 0) FROM batches b WHERE b.run_id = e.run_id AND b.entity_name = e.entity_name) AS t FROM entities e),
    t AS (SELECT r.*, (SELECT list_sort(list(DISTINCT entity_name)) FROM older_requested m WHERE m.run_id = r.run_id) AS asked, (SELECT list_sort(list(entity_name)) FROM entities e WHERE e.run_id = r.run_id) AS planned,
        (SELECT arg_min(CASE WHEN expected_batches < 1 AND failure_code IS NULL THEN 'BATCHES_MISSING' WHEN expected_batches <> n THEN 'BATCH_COUNT' ELSE 'ROW_COUNT' END, entity_name) FROM sums s WHERE s.run_id = r.run_id AND ((expected_batches < 1 AND failure_code IS NULL) OR expected_batches <> n OR expected_rows <> t)) AS code,
        (SELECT min(entity_name) FROM sums s WHERE s.run_id = r.run_id AND ((expected_batches < 1 AND failure_code IS NULL) OR expected_batches <> n OR expected_rows <> t)) AS entity,
        (SELECT sum(expected_batches) FROM sums s WHERE s.run_id = r.run_id) AS eb, (SELECT sum(expected_rows) FROM sums s WHERE s.run_id = r.run_id) AS er, (SELECT count(*) - count(failure_code) FROM sums s WHERE s.run_id = r.run_id) AS fine, (SELECT count(*) FROM batches b WHERE b.run_id = r.run_id) AS n
      FROM seal_counters r)
    SELECT run_id, CASE WHEN status <> 'running' THEN 'NOT_RUNNING' WHEN planned IS NULL OR planned IS DISTINCT FROM asked THEN 'ENTITY_SET_MISMATCH' WHEN code IS NOT NULL THEN code WHEN fine = 0 THEN 'ALL_ENTITIES_FAILED' WHEN eb <> n OR eb <> batches_created OR er <> rows_read THEN 'EXPECTED_BATCH_COUNT' ELSE 'sealed' END AS outcome, entity FROM t""",
    "seal_counters",
    "older_requested",
    "entities",
    "batches",
)
def seal_runs(spark, d):
    runs, requested, entities, batches = _tables(spark, d, "seal_counters", "older_requested", "entities", "batches")
    return v.seal_runs(runs=runs, requested=requested, entities=entities, batches=batches)


@query(
    "read_completeness",
    """SELECT event_id, CASE WHEN scope = 'delta' THEN NULL WHEN NOT verify THEN 'not_checked' WHEN why IS NULL THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN scope = 'full' AND verify THEN why END AS reason FROM (
      SELECT *, list_filter([count_failure, key_failure, count_after_failure, if(count_after IS NULL, 'COUNT_FAILED', NULL), if(count_before IS DISTINCT FROM count_after, 'COUNT_CHANGED', NULL), if(rows <> count_before, 'ROWS_NOT_EQUAL_COUNT', NULL), if(keys <> count_before, 'KEY_PASS_COUNT_MISMATCH', NULL), if(row_digest <> key_digest, 'KEY_SET_MISMATCH', NULL)], lambda x: x IS NOT NULL)[1] AS why FROM full_reads) t""",
    "full_reads",
)
def read_completeness(spark, d):
    return v.read_completeness(table(spark, d, "full_reads")).select("event_id", "status", "reason")


# Replayed one event of a run after the other: the state of all its batches is carried along.
REPLAY = """, ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place) AS i FROM send_events),
start AS (SELECT run_id, map_from_entries(list({'k': batch_id, 'v': {'status': 'ready', 'live': 0, 'n': 0, 'tried': MAP {}::MAP(INTEGER, VARCHAR), 'seen': MAP {}::MAP(INTEGER, VARCHAR)}})) AS m FROM (SELECT DISTINCT run_id, batch_id FROM send_events) x GROUP BY run_id),
f AS (
  SELECT run_id, CAST(0 AS BIGINT) AS i, NULL::VARCHAR AS code, m, NULL::VARCHAR AS batch_id, NULL::VARCHAR AS place, NULL::VARCHAR AS result FROM start
  UNION ALL
  SELECT run_id, i, CASE WHEN code IS NULL AND blocks IS NOT NULL THEN blocks ELSE code END,
    map_from_entries(list_transform(map_entries(m), lambda z: {'k': z.key, 'v': CASE WHEN z.key = batch_id THEN
        {'status': CASE WHEN result = 'Claimed' THEN 'uploading' WHEN result = 'Acknowledged' THEN 'acknowledged' WHEN result = 'Scheduled' THEN 'retry_waiting' WHEN result = 'Reset' THEN 'ready' WHEN blocks IS NOT NULL AND s.status IN ('ready', 'retry_waiting', 'uploading') THEN 'dead_letter' ELSE s.status END,
         'live': CASE WHEN result = 'Claimed' THEN attempt ELSE s.live END, 'n': s.n + CASE WHEN result = 'Claimed' THEN 1 ELSE 0 END,
         'tried': CASE WHEN result = 'Claimed' THEN map_concat(s.tried, MAP {attempt: 'admitted'}) WHEN result = 'Acknowledged' THEN map_concat(s.tried, MAP {attempt: 'acknowledged'}) WHEN result = 'Rejected' THEN map_concat(s.tried, MAP {attempt: 'rejected_ack'})
                  WHEN kind IN ('fail', 'refuse') AND o = 'admitted' THEN map_concat(s.tried, MAP {attempt: 'unknown'}) WHEN kind = 'unsent' AND o = 'admitted' THEN map_concat(s.tried, MAP {attempt: 'precheck_failed'}) ELSE s.tried END,
         'seen': CASE WHEN result IN ('AttestationContradicted', 'Acknowledged', 'Rejected', 'LateEvidence') THEN map_concat(s.seen, MAP {attempt: hash}) ELSE s.seen END}
       WHEN code IS NULL AND blocks IS NOT NULL AND z.value.status IN ('ready', 'retry_waiting', 'uploading') THEN {'status': 'dead_letter', 'live': z.value.live, 'n': z.value.n, 'tried': z.value.tried, 'seen': z.value.seen} ELSE z.value END})),
    batch_id, place, result
  FROM (SELECT *, CASE WHEN code IS NOT NULL THEN NULL WHEN result = 'LedgerConflict' THEN 'SEND_LEDGER_CONFLICT' WHEN result = 'Exhausted' THEN 'UPLOAD_ATTEMPTS_EXHAUSTED' WHEN result = 'AttestationContradicted' THEN 'PRECHECK_ATTESTATION_CONTRADICTED' WHEN result = 'Rejected' THEN 'ACK_INVALID'
                  WHEN result = 'Blocked' AND kind = 'refuse' THEN 'ENTITY_REVOKED' WHEN result = 'Blocked' OR (result = 'LateEvidence' AND s.status IN ('ready', 'retry_waiting', 'uploading')) THEN 'UPLOAD_OUTCOME_UNKNOWN' END AS blocks
    FROM (SELECT *, CASE
        WHEN kind = 'claim' THEN CASE WHEN code IS NOT NULL OR s.status NOT IN ('ready', 'retry_waiting') THEN 'NotClaimed' WHEN len(list_filter(map_values(s.tried), lambda v: v <> 'precheck_failed')) > 0 THEN 'LedgerConflict' WHEN s.n >= 2 THEN 'Exhausted' ELSE 'Claimed' END
        WHEN kind = 'reset' THEN CASE WHEN s.status = 'uploading' THEN 'Reset' ELSE 'NoChange' END
        WHEN kind = 'ack' THEN CASE WHEN o IS NULL THEN 'ClaimLost' WHEN NOT live AND old IS NOT NULL THEN if(old = hash, 'AlreadyObserved', 'ObservationConflict') WHEN o = 'precheck_failed' THEN 'AttestationContradicted' WHEN live AND valid THEN 'Acknowledged' WHEN live THEN 'Rejected' ELSE 'LateEvidence' END
        WHEN o IS DISTINCT FROM 'admitted' THEN 'ClaimLost'
        WHEN kind = 'unsent' THEN CASE WHEN NOT live THEN 'LateOutcome' WHEN s.n >= 2 THEN 'Exhausted' ELSE 'Scheduled' END
        WHEN live OR s.status IN ('ready', 'retry_waiting', 'uploading') THEN 'Blocked' ELSE 'LateOutcome' END AS result
      FROM (SELECT f.run_id, e.i, f.code, f.m, e.batch_id, e.place, e.kind, e.attempt, e.hash, e.valid, f.m[e.batch_id] AS s, f.m[e.batch_id].tried[e.attempt] AS o, f.m[e.batch_id].seen[e.attempt] AS old,
              f.code IS NULL AND f.m[e.batch_id].status = 'uploading' AND f.m[e.batch_id].live = e.attempt AND coalesce(f.m[e.batch_id].tried[e.attempt] = 'admitted', FALSE) AS live
            FROM f JOIN ordered e ON e.run_id = f.run_id AND e.i = f.i + 1) a) b) c),
ends AS (SELECT run_id, arg_max(code, i) AS code, arg_max(m, i) AS m FROM f GROUP BY run_id)
SELECT f.run_id, f.batch_id, f.place, f.result, ends.m[f.batch_id].status AS batch_status, (SELECT max(g.code) FROM f g WHERE g.run_id = f.run_id) AS run_code FROM f JOIN ends ON ends.run_id = f.run_id WHERE f.i > 0"""


@query("send_replay", REPLAY, "send_events")
def send_replay(spark, d):
    return lg.send_outcomes(table(spark, d, "send_events"), bound=2)


_SAME = "{0} IS NOT DISTINCT FROM json_extract_string({1}, '$.{2}') AND json_type({1}, '$.{2}') IN ('VARCHAR', 'NULL')"
_NUMBER = "coalesce(json_type({1}, '$.{2}') IN ('UBIGINT', 'BIGINT') AND CAST({1} ->> '$.{2}' AS BIGINT) = {0}, FALSE)"


def _read(source: str, texts: dict[str, str], numbers: dict[str, str]) -> str:
    return " AND ".join([_SAME.format(value, source, name) for name, value in texts.items()] + [_NUMBER.format(value, source, name) for name, value in numbers.items()])


# The body read by JSON paths, its names as lists, so that one that comes twice is one too many.
@query(
    "stored_completion",
    f""", e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY entity_name) - 1 AS i FROM stored_entities),
    p AS (SELECT b.run_id, CASE WHEN json_valid(body) THEN body END AS j FROM stored_bodies b),
    item AS (SELECT p.run_id, bool_and(coalesce(list_sort(json_keys(x)) = list_sort(list_concat(['entity', 'status', 'readScope', 'rowsRead', 'batchesCreated', 'errorCode', 'errorMessage'], CASE WHEN completeness IS NULL THEN []::VARCHAR[] ELSE ['completeness', 'completenessReason'] END, CASE WHEN snapshot_at IS NULL THEN []::VARCHAR[] ELSE ['snapshotAtUtc'] END))
          AND {_read("x", {"entity": "entity_name", "status": "if(failure_code IS NULL, 'done', 'failed')", "readScope": "read_scope", "errorCode": "failure_code", "errorMessage": "failure_message"}, {"rowsRead": "row_total", "batchesCreated": "batches"})}
          AND completeness IS NOT DISTINCT FROM (x ->> '$.completeness') AND completeness_reason IS NOT DISTINCT FROM (x ->> '$.completenessReason') AND snapshot_at IS NOT DISTINCT FROM (x ->> '$.snapshotAtUtc'), FALSE)) AS fit
        FROM (SELECT p.run_id, e.*, json_extract(j, '$.entities[' || i || ']') AS x FROM p JOIN e ON e.run_id = p.run_id) p GROUP BY p.run_id),
    n AS (SELECT run_id, count(*) AS n, count(failure_code) AS failed FROM e GROUP BY run_id)
    SELECT r.run_id, coalesce(mode IN ('incremental', 'bootstrap_full', 'entity_reload') AND json_type(j) = 'OBJECT' AND fit AND json_array_length(j, '$.entities') = n
      AND list_sort(json_keys(j)) = list_sort(list_concat(['runId', 'status', 'mode', 'rowsRead', 'batchesCreated', 'batchesAcknowledged', 'completedAtUtc', 'entitiesFailed', 'entities'], CASE WHEN database_id IS NULL THEN []::VARCHAR[] ELSE ['sourceIdentity'] END, CASE WHEN generation IS NULL THEN []::VARCHAR[] ELSE ['sourceGeneration'] END))
      AND {_read("j", {"runId": "r.run_id::VARCHAR", "status": "if(failed = 0, 'succeeded', 'partial_success')", "mode": "mode"}, {"rowsRead": "rows_read", "batchesCreated": "batches_created", "batchesAcknowledged": "batches_acknowledged", "entitiesFailed": "failed"})}
      AND TRY_CAST(j ->> '$.completedAtUtc' AS TIMESTAMPTZ) IS NOT NULL AND (database_id IS NULL OR (j ->> '$.sourceIdentity.databaseId' = database_id AND j ->> '$.sourceIdentity.exportEpoch' = export_epoch AND j ->> '$.sourceIdentity.environment' = environment))
      AND generation IS NOT DISTINCT FROM (j ->> '$.sourceGeneration'), FALSE) AS valid
    FROM stored_runs r JOIN p USING (run_id) LEFT JOIN item USING (run_id) LEFT JOIN n USING (run_id)""",
    "stored_runs",
    "stored_entities",
    "stored_bodies",
)
def stored_completion(spark, d):
    return completion.stored_valid(*_tables(spark, d, "stored_bodies", "stored_runs", "stored_entities"))


# One entity that holds all rows, cut in blocks.
@query(
    "parallel_batches",
    """, n AS (SELECT event_id, length(props) + 128 AS size, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT event_id, i, size, CAST(1 AS BIGINT) AS batch, size AS filled FROM n WHERE i = 1
          UNION ALL SELECT n.event_id, n.i, n.size, g.batch + CASE WHEN g.filled >= 5000 THEN 1 ELSE 0 END, CASE WHEN g.filled >= 5000 THEN n.size ELSE g.filled + n.size END FROM g JOIN n ON n.i = g.i + 1)
    SELECT event_id, batch FROM g""",
    "stamps",
)
def parallel_batches(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", (F.length("props") + 128).alias("size"))
    return filling.fill(df, F.col("size"), ["ts", "event_id"], F.lit("all"), 5000).select("event_id", "batch")


@query(
    "quota_admission",
    "SELECT event_id, event_type, 600000 - sum(length(props) + 128) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 100000 AS admitted FROM events",
)
def quota_admission(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "ts", (F.length("props") + 128).alias("size"))
    return filling.admitted(df, "size", ["ts", "event_id"], "event_type", 600_000, 100_000).select("event_id", "event_type", "admitted")
