"""SQL for queries whose operators are SQL themselves, written apart from them and in another form."""

from __future__ import annotations

# name -> (SQL, derived tables)
SEPARATE: dict[str, tuple[str, str]] = {
    "schedulable": ("SELECT entity_name FROM definitions WHERE enabled AND sync_mode NOT ILIKE 'manual_only' INTERSECT ALL SELECT entity_name FROM cursors", "definitions cursors"),
    "unschedulable": (
        "SELECT entity_name, 'disabled' AS reason FROM definitions WHERE NOT enabled UNION ALL SELECT entity_name, 'manual_only' FROM definitions WHERE enabled AND sync_mode ILIKE 'manual_only' "
        "UNION ALL SELECT entity_name, 'no_baseline' FROM definitions WHERE enabled AND sync_mode NOT ILIKE 'manual_only' AND entity_name NOT IN (SELECT entity_name FROM cursors)",
        "definitions cursors",
    ),
    "balance": ("SELECT l_partkey, l_suppkey, CAST(coalesce(sum(q) FILTER (WHERE l_returnflag <> 'R'), 0) - coalesce(sum(q) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS quantity FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) t GROUP BY ALL", ""),
    "row_cursor": ("SELECT event_id, TRY_CAST(stamp AS TIMESTAMP) AS cursor_at, TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL AS dated, event_id::VARCHAR AS cursor_id FROM stamps", "stamps"),
    "failure_code": (
        "SELECT event_id, coalesce(code, 'ODATA_HTTP_' || http) AS code, cause IN ('timeout', 'transport', 'io') OR (cause = 'http' AND list_contains([408, 429, 500, 502, 503, 504], http)) AS transient "
        "FROM failures JOIN (VALUES ('timeout', 'ODATA_TIMEOUT'), ('http', NULL), ('transport', 'ODATA_TRANSPORT'), ('io', 'ODATA_TRANSPORT'), ('limit', 'ODATA_LIMIT'), ('json', 'ODATA_JSON'), ('other', 'ODATA_READ')) c(cause, code) USING (cause)",
        "failures",
    ),
    "batch_aggregate": ("SELECT DISTINCT run_id, entity_name, count(*) OVER w AS batches, CAST(sum(row_count) OVER w AS BIGINT) AS row_total FROM batches WINDOW w AS (PARTITION BY run_id, entity_name)", "batches"),
    "read_scope": ("SELECT run_id, entity_name, CASE mode WHEN 'incremental' THEN 'delta' ELSE 'full' END AS read_scope FROM entities", "entities"),
    "seal_check": (
        """, k AS (SELECT run_id, entity_name FROM entities UNION SELECT run_id, entity_name FROM batches),
        t AS (SELECT k.run_id, k.entity_name, (SELECT any_value(e.expected_batches) FROM entities e WHERE e.run_id = k.run_id AND e.entity_name = k.entity_name) AS eb, (SELECT any_value(e.expected_rows) FROM entities e WHERE e.run_id = k.run_id AND e.entity_name = k.entity_name) AS er,
                     (SELECT count(*) FROM batches b WHERE b.run_id = k.run_id AND b.entity_name = k.entity_name) AS b, (SELECT coalesce(sum(b.row_count), 0) FROM batches b WHERE b.run_id = k.run_id AND b.entity_name = k.entity_name) AS n FROM k)
        SELECT run_id, entity_name, CASE WHEN eb IS NULL THEN 'ENTITY_NOT_PLANNED' WHEN b = 0 AND eb > 0 THEN 'BATCHES_MISSING' WHEN eb <> b THEN 'BATCH_COUNT' WHEN er <> n THEN 'ROW_COUNT' ELSE 'sealed' END AS state FROM t""",
        "entities batches",
    ),
    "run_totals": (
        "SELECT run_id, CAST(sum(expected_rows) AS BIGINT) AS rows_total, CAST(sum(expected_batches) AS BIGINT) AS batches_total, count(failure_code) AS failed, CASE count(*) - count(failure_code) WHEN count(*) THEN 'complete' WHEN 0 THEN 'failed' ELSE 'partial' END AS outcome FROM entities GROUP BY run_id",
        "entities",
    ),
    "latest_run_per_entity": ("SELECT r.entity_name, r.run_id, r.failure_code FROM runs r JOIN (SELECT entity_name, max(struct_pack(f := finished_at, i := run_id)) AS top FROM runs WHERE status = 'succeeded' GROUP BY entity_name) t ON t.entity_name = r.entity_name AND t.top.i = r.run_id", "runs"),
    "completion_items": (
        "SELECT run_id, entity_name, 1 + (SELECT count(*) FROM entities o WHERE o.run_id = e.run_id AND o.entity_name < e.entity_name) AS place, ifnull(failure_code, 'OK') AS code, expected_rows AS row_count, expected_batches AS batch_count, if(mode = 'incremental', 'delta', 'full') AS read_scope FROM entities e WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')",
        "entities runs",
    ),
    "source_unchanged": (
        "SELECT b.entity_name, CASE WHEN NOT EXISTS (SELECT 1 FROM after a WHERE a.entity_name = b.entity_name) THEN 'MISSING' WHEN NOT EXISTS (SELECT 1 FROM after a WHERE a.entity_name = b.entity_name AND a.base_id = b.base_id) THEN 'BASE_CHANGED' WHEN NOT EXISTS (SELECT 1 FROM after a WHERE a.entity_name = b.entity_name AND a.version = b.version) THEN 'VERSION_CHANGED' ELSE 'same' END AS verdict FROM before b",
        "before after",
    ),
    "intake_resolution": (
        "SELECT command_id, CASE WHEN payload IS NULL THEN 'rejected' WHEN command_id NOT IN (SELECT command_id FROM commands) THEN 'stored' WHEN (command_id, payload_hash) IN (SELECT (command_id, payload_hash) FROM commands) THEN 'duplicate' ELSE 'payload_conflict' END AS outcome FROM incoming",
        "incoming commands",
    ),
    "first_sent_backfill": (
        "SELECT command_id, coalesce(first_sent_at, (SELECT min(a.started_at) FROM command_attempts a WHERE a.command_id = c.command_id), CASE WHEN attempt_count > 0 AND command_id NOT IN (SELECT command_id FROM command_attempts) THEN started_at END) AS first_sent_at, if(post_attempt_count = 0, attempt_count, post_attempt_count) AS post_attempt_count FROM commands c",
        "commands command_attempts",
    ),
    "outbox_merge": (
        "SELECT command_id, 'pending' AS status FROM commands WHERE status = 'result_pending' UNION ALL SELECT command_id, status FROM results WHERE command_id NOT IN (SELECT command_id FROM commands WHERE status = 'result_pending')",
        "results commands",
    ),
    "insert_if_absent": ("SELECT command_id, 'pending' AS status FROM commands WHERE status = 'completed' AND command_id NOT IN (SELECT command_id FROM results)", "results commands"),
    "close_attempts": ("SELECT command_id, outcome, attempt_no FROM command_attempts WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY command_id ORDER BY attempt_no) = 1", "command_attempts"),
    "last_outcome": (
        "SELECT c.command_id, a.outcome, coalesce(n, 0) AS attempts FROM commands c LEFT JOIN (SELECT command_id, outcome, count(*) OVER (PARTITION BY command_id) AS n FROM command_attempts QUALIFY rank() OVER (PARTITION BY command_id ORDER BY attempt_no DESC) = 1) a ON a.command_id = c.command_id",
        "commands command_attempts",
    ),
    "busy_entities": ("SELECT run_id FROM runs WHERE status = 'pending' AND entity_name NOT IN (SELECT entity_name FROM owners WHERE released_at IS NULL)", "runs owners"),
    "elder_runs": ("SELECT r.run_id, j.job_id FROM jobs j RIGHT JOIN (SELECT run_id FROM runs WHERE status = 'pending' OR status = 'blocked') r USING (run_id)", "runs jobs"),
    "sensitive_files": ("SELECT batch_id FROM batches WHERE status IN ('ready', 'dead_letter') AND (run_id, entity_name) IN (SELECT (run_id, entity_name) FROM entities WHERE sensitive)", "batches entities"),
    "sensitive_entities": ("SELECT entity_name FROM entities GROUP BY entity_name HAVING bool_or(sensitive)", "entities"),
    "ownership_join": ("SELECT entity_name, owner_run_id, epoch FROM owned WHERE released_at IS NULL INTERSECT ALL SELECT entity_name, run_id, expected_epoch FROM bindings", "owned bindings"),
    "last_run_of_cursor": ("SELECT entity_name, cursor_at, (SELECT any_value(r.status) FROM runs r WHERE r.run_id = c.last_run_id) AS status FROM cursors c WHERE last_run_id IN (SELECT run_id FROM runs)", "cursors runs"),
    "attempt_blockers": ("SELECT * FROM (SELECT b.run_id, sum((SELECT count(*) FROM batch_attempts a WHERE a.batch_id = b.batch_id AND a.outcome <> 'precheck'))::BIGINT AS attempts FROM batches b GROUP BY b.run_id) t WHERE attempts > 0", "batch_attempts batches"),
    "active_config": ("SELECT entity_name, run_id, version FROM configs WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY version DESC) = 1", "configs"),
    "latest_version": ("SELECT entity_name, ifnull((SELECT max(version) FROM configs c WHERE c.entity_name = p.entity_name AND c.status IN ('active', 'superseded')), 0) AS version FROM priorities p", "priorities configs"),
    "config_supersede": (
        "SELECT run_id, entity_name, version, CASE WHEN status = 'rejected' THEN status WHEN EXISTS (SELECT 1 FROM (SELECT entity_name AS n, max(version) AS top FROM configs WHERE status <> 'rejected' GROUP BY 1) m WHERE m.n = c.entity_name AND m.top = c.version) THEN 'active' ELSE 'superseded' END AS next_status FROM configs c",
        "configs",
    ),
    "cursor_upsert": (
        "SELECT entity_name, cursor_at, ifnull((SELECT c.generation FROM cursors c WHERE c.entity_name = n.entity_name), 0) + 1 AS generation FROM fresh n UNION ALL SELECT entity_name, cursor_at, generation FROM cursors WHERE entity_name NOT IN (SELECT entity_name FROM fresh)",
        "cursors fresh",
    ),
    "begin_entity": (
        "SELECT entity_name, domain_status, CASE domain_status || ' ' || mode WHEN 'absent incremental' THEN 'BASELINE_REQUIRED' WHEN 'changed incremental' THEN 'RESET' ELSE 'BEGIN' END AS action FROM ("
        "SELECT d.entity_name, d.mode, coalesce((SELECT if(c.fingerprint IS NULL, 'unknown', if(c.fingerprint = d.fingerprint, 'same', 'changed')) FROM cursors c WHERE c.entity_name = d.entity_name), 'absent') AS domain_status FROM definitions d) t",
        "definitions cursors",
    ),
    "ownership_acquire": (
        "SELECT entity_name, if((SELECT count(*) FROM owners WHERE released_at IS NULL AND entity_name IN (SELECT entity_name FROM priorities)) > 0, 'refused', 'acquired') AS outcome, 1 + ifnull((SELECT o.epoch FROM owners o WHERE o.entity_name = p.entity_name), 0) AS epoch FROM priorities p",
        "priorities owners",
    ),
    "domain_reset": ("SELECT entity_name, generation, cursor_at AS archived_at FROM cursors WHERE (entity_name, generation) IN (SELECT (entity_name, generation) FROM definitions)", "cursors definitions"),
    "cursors_after_reset": ("SELECT entity_name FROM (SELECT entity_name, generation FROM cursors EXCEPT SELECT entity_name, generation FROM definitions) t", "cursors definitions"),
    "batch_retention": ("SELECT b.batch_id FROM batches b, runs r WHERE r.run_id = b.run_id AND (r.status, b.status) = ('succeeded', 'acknowledged') AND b.acknowledged_at < TIMESTAMP '1997-01-01'", "batches runs"),
    "dead_letter_files": (
        "SELECT batch_id, entity_name FROM batches b WHERE status = 'dead_letter' AND created_at < DATE '2000-01-01' AND run_id NOT IN (SELECT run_id FROM ledger_runs WHERE resolved_at IS NULL AND status IN ('pending', 'running', 'paused', 'uploading', 'completing', 'blocked')) AND EXISTS (SELECT 1 FROM entities e WHERE e.run_id = b.run_id AND e.entity_name = b.entity_name AND NOT e.sensitive)",
        "batches ledger_runs entities",
    ),
    "missing_files": ("SELECT run_id FROM batches WHERE status = 'ready' AND batch_id NOT IN (SELECT batch_id FROM files) GROUP BY run_id", "batches files"),
    "orphan_files": ("SELECT batch_id FROM files WHERE batch_id NOT IN (SELECT batch_id FROM batches)", "files batches"),
    "spool_size": ("SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (WHERE quarantined), 0) AS BIGINT) AS quarantined FROM files", "files"),
    "keep_newest": ("SELECT entity_name, run_id FROM configs EXCEPT SELECT entity_name, unnest(arg_max(run_id, (version, run_id), 3)) FROM configs GROUP BY entity_name", "configs"),
    "ack_first_observation": (
        "SELECT batch_id, hash, attempt_no, conflicting FROM (SELECT *, min(hash) OVER (PARTITION BY batch_id) IS DISTINCT FROM max(hash) OVER (PARTITION BY batch_id) AS conflicting, row_number() OVER (PARTITION BY batch_id ORDER BY attempt_no) AS n FROM batch_attempts WHERE outcome = 'acknowledged') t WHERE n = 1",
        "batch_attempts",
    ),
    "send_outcome": (
        "SELECT batch_id, CASE WHEN list_contains(o, 'acknowledged') THEN 'acknowledged' WHEN list_has_any(o, ['unknown', 'refused']) THEN 'block' WHEN len(list_filter(o, lambda x: x = 'unsent')) >= 5 THEN 'dead_letter' WHEN list_contains(o, 'unsent') THEN 'retry' ELSE 'wait' END AS action FROM (SELECT batch_id, list(outcome) AS o FROM batch_attempts GROUP BY batch_id) t",
        "batch_attempts",
    ),
    "complete_entity": ("SELECT run_id, entity_name FROM entities e WHERE failure_code IS NULL AND expected_batches > 0 AND expected_batches = (SELECT count(*) FROM batches b WHERE b.run_id = e.run_id AND b.entity_name = e.entity_name)", "entities batches"),
    "duplicate_claims": ("SELECT DISTINCT entity_name, n FROM (SELECT entity_name, count(*) OVER (PARTITION BY entity_name) AS n FROM runs WHERE status = 'pending') t WHERE n >= 2", "runs"),
    "cursor_validity": (
        "SELECT event_id, d AND i AS valid, d AND i AND NOT (stamp IS NULL AND cursor_id IS NULL) AS valid_final FROM (SELECT *, ifnull(stamp, '2000-01-01') <> 'never' AS d, ifnull(trim(cursor_id), 'x') <> '' AS i FROM probes) t",
        "probes",
    ),
    "source_identity": (
        "SELECT event_id, list_filter([if(bound IS NULL, 'BindingMissing', NULL), if(bound = '', 'BindingInvalid', NULL), if(endpoint NOT LIKE '%/o', 'EndpointMismatch', NULL), CASE fetched WHEN 'unavailable' THEN 'Unavailable' WHEN 'not_ready' THEN 'NotReady' WHEN 'malformed' THEN 'Malformed' END, "
        "if(scope = 'area', 'ScopeUnsupported', NULL), if(database_id = 'other', 'DatabaseMismatch', NULL), if(epoch = 2, 'EpochMismatch', NULL), if(environment = 'test', 'EnvironmentMismatch', NULL), 'Match'], lambda x: x IS NOT NULL)[1] AS verdict FROM probes",
        "probes",
    ),
    "clock_model": (
        "SELECT event_id, o AS offset_ms, u AS uncertainty_ms, greatest(o, -o) > 30000 + u AS drifts, remote_ms + u >= expires_ms AS expired, remote_ms - u >= not_before_ms AS may_start FROM (SELECT *, remote_ms - (sent_ms + u) AS o FROM (SELECT *, 0.5 * (received_ms - sent_ms) AS u FROM probes) p) t",
        "probes",
    ),
    "constraint_report": (
        "SELECT unnest(['status', 'finished_after_start', 'failure_has_code']) AS rule, unnest([count(*) - count(*) FILTER (WHERE status IN ('pending', 'succeeded', 'failed', 'blocked')), count(*) FILTER (WHERE started_at > finished_at), count(*) FILTER (WHERE status = 'failed') - count(failure_code) FILTER (WHERE status = 'failed')]) AS violations FROM runs",
        "runs",
    ),
    "snapshot_clock": (
        "SELECT run_id, entity_name, version, n + (SELECT max(x) FROM unnest(lags) AS t(x)) AS snapshot_at FROM (SELECT *, list(version - n) OVER (PARTITION BY entity_name ORDER BY run_id) AS lags FROM (SELECT run_id, entity_name, version, row_number() OVER (PARTITION BY entity_name ORDER BY run_id) AS n FROM configs) c) d",
        "configs",
    ),
}
