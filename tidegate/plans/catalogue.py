"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..operators import agent
from ..operators import extraction as ex
from ..operators import queue as q
from ..operators import runs as r
from ..operators import verification as v
from .oracles import SEPARATE
from .tables import table, with_tables

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def relational(name: str, op: Callable[..., DataFrame], **tables: str) -> None:
    """A query of an operator that is SQL itself. Its oracle is the one written apart; without one, the same text."""
    QUERIES[name] = lambda spark, d: op(**{k: table(spark, d, t) for k, t in tables.items()})
    if name in SEPARATE:
        sql, names = SEPARATE[name]
        ORACLES[name] = with_tables(sql, *names.split())
        return
    names = list(dict.fromkeys(tables.values()))
    ORACLES[name] = with_tables(f"SELECT * FROM ({op.sql.strip().format(**tables)}) result", *names)


def query(name: str, oracle: str | None = None, *names: str):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_tables(oracle, *names)
        return f

    return add


# --- extraction ---------------------------------------------------------------------------------------------------
EVENTS = ex.Entity("events", "events", ("event_id",), ("user_id", "value"), updated_at="ts")
ORDERS = ex.Entity("orders", "orders", ("o_orderkey",), ("o_custkey",), updated_at="o_orderdate", filter="o_orderstatus = 'F' or o_totalprice > 100000")
LINES = ex.Entity("lines", "lineitem", ("l_orderkey", "l_linenumber", "l_returnflag"), ("l_quantity",))
COMMITTED, UPPER = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)


@query("delta_window", "SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-09 23:50:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def delta_window(spark, d):
    return ex.scan(table(spark, d, "events"), EVENTS, COMMITTED, UPPER)


@query("full_window", "SELECT event_id, ts, user_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'")
def full_window(spark, d):
    return ex.scan(table(spark, d, "events"), EVENTS, COMMITTED, UPPER, full=True)


@query("static_filter", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND o_orderdate >= TIMESTAMP '1996-12-31 23:50:00' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'")
def static_filter(spark, d):
    return ex.scan(table(spark, d, "orders"), ORDERS, dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1))


@query("key_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000")
def key_scan(spark, d):
    return ex.key_scan(table(spark, d, "orders"), ORDERS)


@query("count_scan", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000")
def count_scan(spark, d):
    return ex.count_scan(table(spark, d, "orders"), ORDERS)


@query("envelope_rows", "SELECT CAST(event_id AS VARCHAR) AS source_id, ts AS source_updated_at, event_type = 'error' AS deleted, user_id, value FROM events")
def envelope_rows(spark, d):
    entity = ex.Entity("events", "events", ("event_id",), ("user_id", "value"), updated_at="ts", deleted="gone")
    out = ex.envelope(table(spark, d, "events").withColumn("gone", F.col("event_type") == "error"), entity)
    return out.select(F.col("sourceId").alias("source_id"), F.col("sourceUpdatedAt").alias("source_updated_at"), "deleted", "data.user_id", "data.value")


@query("composite_source_id", """SELECT l_partkey, l_suppkey, '[' || l_orderkey || ',' || l_linenumber || ',"' || l_returnflag || '"]' AS source_id FROM lineitem""")
def composite_source_id(spark, d):
    df = table(spark, d, "lineitem")
    return df.select("l_partkey", "l_suppkey", ex.source_id(df, LINES.keys).alias("source_id"))


@query("final_cursor_by_entity", "SELECT o_orderpriority, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS cursor_at, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS cursor_id FROM orders GROUP BY 1")
def final_cursor_by_entity(spark, d):
    return ex.final_cursor(table(spark, d, "orders"), ORDERS, "o_orderpriority")


@query(
    "greedy_batches",
    """WITH RECURSIVE n AS (SELECT event_id, event_type, length(props) + 128 AS size, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT event_id, event_type, i, size, CAST(1 AS BIGINT) AS batch, size AS filled FROM n WHERE i = 1
          UNION ALL SELECT n.event_id, n.event_type, n.i, n.size, g.batch + CASE WHEN g.filled >= 5000 THEN 1 ELSE 0 END, CASE WHEN g.filled >= 5000 THEN n.size ELSE g.filled + n.size END
          FROM g JOIN n ON n.event_type = g.event_type AND n.i = g.i + 1)
    SELECT event_type, event_id, batch FROM g""",
)
def greedy_batches(spark, d):
    df = table(spark, d, "events").select("event_type", "event_id", "ts", (F.length("props") + 128).alias("size"))
    return ex.greedy_batches(df, "size", ["ts", "event_id"], "event_type", 5000).select("event_type", "event_id", "batch")


relational("schedulable", ex.schedulable, entities="definitions", cursors="cursors")
relational("unschedulable", ex.unschedulable, entities="definitions", cursors="cursors")
relational("balance", ex.balance, lines="lineitem")
relational("row_cursor", ex.row_cursor, stamps="stamps")
relational("failure_code", ex.failure_code, failures="failures")


@query("oversized_rows", "SELECT event_id, strlen(props) > 9 AS too_long FROM events")
def oversized_rows(spark, d):
    return table(spark, d, "events").select("event_id", ex.oversized(F.col("props"), 9).alias("too_long"))


@query("lagged_window", "SELECT event_id, ts, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09 23:50:00' AND TIMESTAMP '2024-01-19 23:59:30'")
def lagged_window(spark, d):
    return ex.scan(table(spark, d, "events"), EVENTS, COMMITTED, ex.upper_bound(UPPER, 30))


@query(
    "outcome_class",
    """SELECT f.event_id, CASE WHEN h.kind IS NOT NULL THEN h.kind WHEN f.http BETWEEN 200 AND 299 AND b.kind IS NOT NULL THEN b.kind ELSE 'technical' END AS outcome
    FROM failures f LEFT JOIN (VALUES (404, 'not_found'), (409, 'conflict'), (400, 'business_error'), (401, 'business_error'), (403, 'business_error'), (422, 'business_error'), (202, 'processing')) h(http, kind) ON h.http = f.http
    LEFT JOIN (VALUES ('succeeded', 'succeeded'), ('completed', 'succeeded'), ('created', 'succeeded'), ('processing', 'processing'), ('executing', 'processing'), ('pending', 'processing'), ('not_found', 'not_found'),
               ('business_failed', 'business_error'), ('failed', 'business_error'), ('rejected', 'business_error'), ('validation_error', 'business_error')) b(said, kind) ON b.said = lower(trim(f.body))""",
    "failures",
)
def outcome_class(spark, d):
    return table(spark, d, "failures").select("event_id", ex.outcome_class(F.col("http"), F.col("body")).alias("outcome"))


@query(
    "mode_gate",
    """SELECT s.event_id, s.mode, g.lease AND NOT s.stopped AS may_lease, g.execute AND NOT s.stopped AS may_execute, g.extract AND NOT s.stopped AND NOT s.local_paused AS may_extract, s.ready AS may_deliver
    FROM (SELECT *, NOT ready OR handshake_maintenance OR rejected AS stopped FROM states) s
    JOIN (VALUES ('normal', TRUE, TRUE, TRUE), ('pause_etl', TRUE, TRUE, FALSE), ('pause_commands', FALSE, FALSE, TRUE), ('drain', FALSE, TRUE, TRUE), ('maintenance', FALSE, FALSE, FALSE), ('disabled', FALSE, FALSE, FALSE)) g(mode, lease, execute, extract) ON g.mode = s.mode""",
    "states",
)
def mode_gate(spark, d):
    return ex.mode_gate(table(spark, d, "states")).select("event_id", "mode", "may_lease", "may_execute", "may_extract", "may_deliver")


@query("file_names", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name, '[^A-Za-z0-9._-]', '_', 'g')), ''), 'entity') AS file_name FROM part")
def file_names(spark, d):
    safe = F.regexp_replace("p_name", "[^A-Za-z0-9._-]", "_")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(F.trim(safe), F.lit("")), F.lit("entity")).alias("file_name"))


# --- verification -------------------------------------------------------------------------------------------------
DIGEST_SQL = """SELECT {by}{limb3} AS digest, n FROM (
  SELECT {by}n, s3 % 4294967296 AS d3, (s2 + s3 // 4294967296) % 4294967296 AS d2, (s1 + (s2 + s3 // 4294967296) // 4294967296) % 4294967296 AS d1,
         (s0 + (s1 + (s2 + s3 // 4294967296) // 4294967296) // 4294967296) % 4294967296 AS d0
  FROM (SELECT {by}count(*) AS n, {sums} FROM (SELECT {by}sha256({key}) AS h FROM {source}) GROUP BY ALL))"""


def digest_sql(key: str, source: str, by: str = "") -> str:
    sums = ", ".join(f"coalesce(sum(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT)), 0)::HUGEINT AS s{i}" for i in range(4))
    limbs = " || ".join(f"upper(lpad(to_hex(d{i}::BIGINT), 8, '0'))" for i in range(4))
    return DIGEST_SQL.format(by=by, limb3=limbs, sums=sums, key=key, source=source)


@query("key_digest", digest_sql("l_orderkey || chr(31) || l_linenumber || chr(31)", "lineitem", "l_returnflag, "))
def key_digest(spark, d):
    df = table(spark, d, "lineitem")
    return v.key_digest(df, [ex.raw("l_orderkey", "bigint"), ex.raw("l_linenumber", "int")], ["l_returnflag"])


def completeness(spark, d: str, name: str, key: str, date: str, upper: dt.datetime) -> DataFrame:
    """One row: a full read of a table up to a bound, checked against counts and a key pass."""
    df = table(spark, d, name)
    entity = ex.Entity(name, name, (key,), (key,), updated_at=date)
    rows = v.key_digest(ex.scan(df, entity, None, upper, full=True), [ex.raw(key, "bigint")]).select(F.col("digest").alias("row_digest"), F.col("n").alias("rows"))
    keys = v.key_digest(ex.key_scan(df, entity), [ex.raw(key, "bigint")]).select(F.col("digest").alias("key_digest"), F.col("n").alias("keys"))
    count = ex.count_scan(df, entity).select(F.col("n").alias("count_before"), F.col("n").alias("count_after"))
    null = F.lit(None).cast("string")
    one = rows.crossJoin(keys).crossJoin(count)  # one row each
    return one.select(F.lit(name).alias("entity"), "rows", "row_digest", v.verdict(null, null, F.col("count_before"), F.col("count_after"), F.col("rows"), F.col("keys"), F.col("row_digest"), F.col("key_digest")).alias("verdict"))


COMPLETENESS = "SELECT '{name}' AS entity, a.n AS rows, a.digest AS row_digest, CASE WHEN a.n <> c.n THEN 'ROWS_NOT_EQUAL_COUNT' WHEN b.n <> c.n THEN 'KEY_PASS_COUNT_MISMATCH' WHEN a.digest <> b.digest THEN 'KEY_SET_MISMATCH' ELSE 'verified' END AS verdict FROM ({rows}) a, ({keys}) b, (SELECT count(*) AS n FROM {name}) c"


@query(
    "completeness_verdict",
    " UNION ALL ".join(
        COMPLETENESS.format(name=name, rows=digest_sql(f"{key} || chr(31)", f"{name} WHERE {date} <= TIMESTAMP '{upper}'"), keys=digest_sql(f"{key} || chr(31)", name))
        for name, key, date, upper in (("events", "event_id", "ts", "2024-01-20"), ("orders", "o_orderkey", "o_orderdate", "2030-01-01"))
    ),
)
def completeness_verdict(spark, d):
    return completeness(spark, d, "events", "event_id", "ts", UPPER).union(completeness(spark, d, "orders", "o_orderkey", "o_orderdate", dt.datetime(2030, 1, 1)))


relational("batch_aggregate", v.batch_aggregate, batches="batches")
relational("read_scope", v.read_scope, entities="entities")
relational("seal_check", v.seal, entities="entities", batches="batches")
relational("run_totals", v.run_totals, entities="entities")


# The checks in their order, each as a set of runs.
@query(
    "claim_readiness",
    """SELECT r.run_id, CASE WHEN r.run_id NOT IN (SELECT run_id FROM entities) THEN 'legacy'
      WHEN r.run_id IN (SELECT e.run_id FROM entities e LEFT JOIN batches b ON b.run_id = e.run_id AND b.entity_name = e.entity_name GROUP BY e.run_id, e.entity_name, e.expected_batches, e.expected_rows, e.failure_code
                        HAVING e.expected_batches IS NULL OR (e.failure_code IS NULL AND e.expected_batches < 1) OR e.expected_batches <> count(b.batch_id) OR e.expected_rows IS DISTINCT FROM coalesce(sum(b.row_count), 0)) THEN 'violated'
      WHEN r.run_id NOT IN (SELECT run_id FROM entities WHERE failure_code IS NULL) THEN 'violated'
      WHEN r.run_id IN (SELECT e.run_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM batch_bindings g JOIN batch_owners o ON o.entity_name = g.entity_name AND o.owner_run_id = g.run_id AND o.epoch = g.expected_epoch
                        WHERE g.run_id = e.run_id AND g.entity_name = e.entity_name AND g.expected_epoch > 0 AND o.released_at IS NULL)) THEN 'ownership'
      WHEN r.run_id IN (SELECT g.run_id FROM batch_bindings g WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.run_id = g.run_id AND e.entity_name = g.entity_name)) THEN 'ownership'
      WHEN r.run_id IN (SELECT o.owner_run_id FROM batch_owners o WHERE o.released_at IS NULL AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.run_id = o.owner_run_id AND e.entity_name = o.entity_name)) THEN 'ownership'
      WHEN r.run_id IN (SELECT run_id FROM batches WHERE status IN ('dead_letter', 'deleted')) THEN 'violated'
      WHEN r.run_id IN (SELECT run_id FROM batches WHERE status <> 'acknowledged') THEN 'transient'
      WHEN r.run_id IN (SELECT b.run_id FROM batches b WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.run_id = b.run_id AND e.entity_name = b.entity_name)) THEN 'violated' ELSE 'ready' END AS readiness FROM runs r""",
    "runs",
    "entities",
    "batches",
    "batch_owners",
    "batch_bindings",
)
def claim_readiness(spark, d):
    return v.readiness(runs=table(spark, d, "runs"), entities=table(spark, d, "entities"), batches=table(spark, d, "batches"), owners=table(spark, d, "batch_owners"), bindings=table(spark, d, "batch_bindings"))


relational("latest_run_per_entity", v.latest_failed, runs="runs")
relational("completion_items", v.completion, entities="entities", runs="runs")
relational("source_unchanged", v.source_unchanged, before="before", after="after")

# --- queue --------------------------------------------------------------------------------------------------------
NOW, NOT_BEFORE = dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 24)
READY_SQL = """FROM (SELECT *, coalesce(sum(CASE WHEN status IN ('completed', 'cancelled', 'expired', 'dead_letter') THEN 0 ELSE 1 END) OVER (PARTITION BY ordering_key ORDER BY received_at, queue_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM commands) c
  WHERE (ordering_key IS NULL OR held = 0) AND list_contains(['queued', 'retry_waiting', 'unknown_result'], status) AND coalesce(next_attempt_at, TIMESTAMP '2024-01-25') <= TIMESTAMP '2024-01-25'
  AND (coalesce(not_before, TIMESTAMP '2024-01-24') <= TIMESTAMP '2024-01-24' OR status = 'unknown_result' OR greatest(attempt_count, post_attempt_count) > 0 OR first_sent_at IS NOT NULL)"""


def _times():
    return F.lit(NOW).cast("timestamp_ntz"), F.lit(NOT_BEFORE).cast("timestamp_ntz")


@query("ready_head_of_line", f"SELECT command_id, ordering_key, priority, status {READY_SQL}", "commands")
def ready_head_of_line(spark, d):
    return q.ready(table(spark, d, "commands"), *_times()).select("command_id", "ordering_key", "priority", "status")


@query("ready_top", f"SELECT command_id, priority {READY_SQL} ORDER BY priority DESC, received_at, queue_sequence LIMIT 20", "commands")
def ready_top(spark, d):
    return q.take_ready(table(spark, d, "commands"), *_times(), 20).select("command_id", "priority")


@query("ready_count", f"SELECT count(*) AS ready {READY_SQL} AND exec_claim_owner_id IS NULL", "commands")
def ready_count(spark, d):
    return q.ready_count(table(spark, d, "commands"), *_times())


@query(
    "head_of_line_blockers",
    "SELECT command_id, CAST(coalesce(sum(CASE WHEN status NOT IN ('completed', 'cancelled', 'expired', 'dead_letter') THEN 1 ELSE 0 END) OVER (PARTITION BY ordering_key ORDER BY received_at, queue_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM commands WHERE ordering_key IS NOT NULL",
    "commands",
)
def head_of_line_blockers(spark, d):
    return q.blockers(table(spark, d, "commands"))


@query("retry_schedule", "SELECT event_id, [1, 2, 5, 10, 30, 60, 300][least(greatest(event_id % 12, 1), 7)] AS seconds, least(500 * (1 << CAST(least(greatest(event_id % 24, 1) - 1, 16) AS BIGINT)), 60000) AS millis FROM events")
def retry_schedule(spark, d):
    return table(spark, d, "events").select("event_id", q.retry_seconds(F.col("event_id") % 12).alias("seconds"), q.backoff_millis(F.col("event_id") % 24, 500, 60000).alias("millis"))


STEPS = "SELECT command_id, coalesce(lag(status) OVER (PARTITION BY ordering_key ORDER BY received_at, command_id), 'received') AS from_status, status AS to_status FROM {commands} WHERE ordering_key IS NOT NULL"


@query(
    "state_transition_violations",
    f"SELECT * FROM ({STEPS.format(commands='commands')}) s WHERE (from_status, to_status) NOT IN ({', '.join(repr((a, b)) for a, bs in q.TRANSITIONS.items() for b in bs)})",
    "commands",
)
def state_transition_violations(spark, d):
    return q.transition_violations(spark.sql(STEPS, commands=table(spark, d, "commands"))).select("command_id", "from_status", "to_status")


METRICS_SQL = """SELECT (SELECT count(*) FROM commands WHERE status IN ('queued', 'retry_waiting', 'unknown_result', 'executing')) AS commands_pending,
      (SELECT count(*) FROM results WHERE NOT (status = 'acknowledged' OR status = 'dead_letter')) AS results_pending,
      (SELECT count(*) FROM batches WHERE status IN ('ready', 'uploading', 'retry_waiting')) AS batches_pending,
      CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM commands WHERE result_status = 'dead_letter' UNION ALL SELECT count(*) FROM batches WHERE status = 'dead_letter' UNION ALL SELECT count(*) FROM results WHERE status = 'dead_letter') t) AS BIGINT) AS dead_letters,
      (SELECT count(*) FROM commands WHERE result_status = 'dead_letter') AS commands_dead,
      (SELECT received_at FROM commands WHERE status IN ('queued', 'retry_waiting', 'unknown_result', 'executing') ORDER BY received_at LIMIT 1) AS oldest_command,
      (SELECT created_at FROM results WHERE status IN ('pending', 'sending', 'retry_waiting') ORDER BY created_at LIMIT 1) AS oldest_result,
      (SELECT count(*) FROM (SELECT run_id FROM runs WHERE status IN ('blocked', 'failed') EXCEPT SELECT run_id FROM resolutions) t) AS runs_unresolved,
      (SELECT count(*) FROM (SELECT e.failure_code, rank() OVER (PARTITION BY e.entity_name ORDER BY r.finished_at DESC, r.run_id DESC) AS place FROM entities e, runs r WHERE r.run_id = e.run_id AND r.status = 'succeeded') t WHERE place = 1 AND failure_code IS NOT NULL) AS entities_failing"""
METRICS_TABLES = ("commands", "results", "batches", "runs", "entities", "resolutions")
LIMITS = {"state_bytes": 95, "spool_bytes": 92, "reserve_bytes": 3, "drift_ms": 12, "lag_seconds": 60}


@query("queue_metrics", METRICS_SQL, *METRICS_TABLES)
def queue_metrics(spark, d):
    return q.metrics(*[table(spark, d, t) for t in METRICS_TABLES])


@query(
    "heartbeat",
    f"SELECT m.*, CASE WHEN runs_unresolved + entities_failing > 0 THEN 'degraded' ELSE 'healthy' END AS state, CASE WHEN runs_unresolved > 0 THEN 'RUNS_UNRESOLVED' WHEN entities_failing > 0 THEN 'ENTITIES_FAILING' ELSE 'OK' END AS reason FROM ({METRICS_SQL}) m",
    *METRICS_TABLES,
)
def heartbeat(spark, d):
    vitals = spark.sql("SELECT FALSE AS rejected, 'normal' AS mode, 1L AS state_bytes, 1L AS spool_bytes, 50L AS disk_free, TRUE AS command_api, TRUE AS data_api, 0L AS drift_ms, CAST(NULL AS BIGINT) AS lag_seconds")
    return agent.heartbeat(queue_metrics(spark, d), vitals, LIMITS)


@query(
    "health_state",
    """SELECT event_id, split_part(found, ':', 1) AS state, split_part(found, ':', 2) AS reason FROM (
      SELECT event_id, list_filter([
        CASE WHEN rejected THEN 'incompatible_version:COMPATIBILITY_REJECTED' END, CASE mode WHEN 'maintenance' THEN 'maintenance:MODE_MAINTENANCE' WHEN 'disabled' THEN 'maintenance:MODE_DISABLED' END,
        CASE WHEN state_bytes > 94 THEN 'storage_critical:STATE_LIMIT' END, CASE WHEN spool_bytes > 91 THEN 'storage_critical:SPOOL_LIMIT' END, CASE WHEN disk_free < 4 THEN 'storage_critical:DISK_RESERVE' END,
        CASE WHEN NOT (command_api OR data_api) THEN 'offline_source:SOURCE_UNAVAILABLE' END, CASE WHEN NOT command_api THEN 'degraded:SOURCE_COMMAND_API_UNAVAILABLE' END, CASE WHEN NOT data_api THEN 'degraded:SOURCE_DATA_UNAVAILABLE' END,
        CASE WHEN drift_ms NOT BETWEEN -12 AND 12 THEN 'degraded:CLOCK_DRIFT' END, CASE WHEN runs_unresolved > 0 THEN 'degraded:RUNS_UNRESOLVED' END, CASE WHEN entities_failing > 0 THEN 'degraded:ENTITIES_FAILING' END,
        CASE WHEN lag_seconds > 60 THEN 'degraded:LAG' END, 'healthy:OK'], lambda x: x IS NOT NULL)[1] AS found FROM vitals) t""",
    "vitals",
)
def health_state(spark, d):
    state, reason = r.health(LIMITS)
    return table(spark, d, "vitals").select("event_id", state.alias("state"), reason.alias("reason"))


@query(
    "admission",
    """SELECT e.command_id, (SELECT arg_min(code, place) FROM (VALUES
        (1, e.command_id IS NULL OR trim(e.command_id) = '' OR e.command_id = '00000000-0000-0000-0000-000000000000', 'INVALID_COMMAND_ID'), (2, e.command_type IS NULL OR e.command_type NOT IN ('click', 'view', 'purchase', 'signup'), 'UNSUPPORTED_COMMAND_TYPE'),
        (3, e.payload_version IS DISTINCT FROM 1, 'UNSUPPORTED_PAYLOAD_VERSION'), (4, e.payload IS NULL, 'INVALID_PAYLOAD'), (5, trim(e.payload_hash) = '', 'PAYLOAD_HASH_MISMATCH'), (6, e.refused IS NOT NULL, e.refused),
        (7, e.payload_hash <> e.computed_hash, 'PAYLOAD_HASH_MISMATCH')) t(place, bad, code) WHERE bad) AS code FROM envelopes e""",
    "envelopes",
)
def admission(spark, d):
    return q.admission(table(spark, d, "envelopes"), ["click", "view", "purchase", "signup"])


@query("sequence_backfill", "SELECT command_id, n AS queue_sequence FROM (SELECT command_id, old_sequence, row_number() OVER (ORDER BY received_at, command_id) AS n FROM commands) c WHERE old_sequence = 0", "commands")
def sequence_backfill(spark, d):
    return q.sequence_backfill(table(spark, d, "commands").withColumn("queue_sequence", F.col("old_sequence")))


@query(
    "sequence_allocation",
    "SELECT command_id, (SELECT max(queue_sequence) FROM commands) + row_number() OVER (ORDER BY received_at, command_id) AS queue_sequence FROM incoming WHERE command_id NOT IN (SELECT command_id FROM commands)",
    "commands",
    "incoming",
)
def sequence_allocation(spark, d):
    return q.sequence_allocation(table(spark, d, "commands"), table(spark, d, "incoming"))


@query("claim_commands", f"SELECT command_id, status, attempt_count, post_attempt_count, 'w9' AS exec_claim_owner_id, TIMESTAMP '2024-01-25' AS exec_claim_acquired_at {READY_SQL} AND NOT (exec_claim_owner_id IS NOT NULL AND coalesce(exec_claim_acquired_at >= TIMESTAMP '2024-01-10', FALSE))", "commands")
def claim_commands(spark, d):
    return q.claim(table(spark, d, "commands"), "w9", *_times(), F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz"))


@query("release_claims", "SELECT command_id, nullif(exec_claim_owner_id, 'w1') AS exec_claim_owner_id FROM commands WHERE exec_claim_owner_id IN ('w1', 'w2')", "commands")
def release_claims(spark, d):
    return q.release_claim(table(spark, d, "commands"), "w1")


@query(
    "retention_delete_set",
    """SELECT command_id FROM commands WHERE status = 'completed' AND acknowledged_at < TIMESTAMP '2024-01-20' AND result_status IS DISTINCT FROM 'dead_letter'
    EXCEPT SELECT command_id FROM results WHERE status IN ('pending', 'sending', 'dead_letter', 'retry_waiting') EXCEPT SELECT command_id FROM command_jobs WHERE status = 'running'""",
    "commands",
    "results",
    "command_jobs",
)
def retention_delete_set(spark, d):
    return q.retention(table(spark, d, "commands"), table(spark, d, "results"), table(spark, d, "command_jobs"), dt.datetime(2024, 1, 20))


relational("intake_resolution", q.intake, incoming="incoming", commands="commands")
relational("first_sent_backfill", q.first_sent_backfill, commands="commands", attempts="command_attempts")
relational("outbox_merge", q.outbox_merge, results="results", commands="commands")
relational("insert_if_absent", q.insert_if_absent, results="results", commands="commands")
relational("close_attempts", q.close_attempt, attempts="command_attempts")
relational("last_outcome", q.last_outcome, commands="commands", attempts="command_attempts")


# --- runs ---------------------------------------------------------------------------------------------------------
PENDING = "SELECT o_custkey AS run_id, min(o_orderdate) AS created_at, {collect} AS entities FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey"


@query(
    "overlap_dispatch",
    f"SELECT run_id FROM ({PENDING.format(collect='list(DISTINCT CAST(o_orderkey % 997 AS BIGINT))', orders='orders')}) r WHERE NOT EXISTS (SELECT 1 FROM ({PENDING.format(collect='list(DISTINCT CAST(o_orderkey % 997 AS BIGINT))', orders='orders')}) p "
    "WHERE (p.created_at < r.created_at OR (p.created_at = r.created_at AND p.run_id < r.run_id)) AND list_has_any(p.entities, r.entities))",
)
def overlap_dispatch(spark, d):
    pending = table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("run_id")).agg(F.min("o_orderdate").alias("created_at"), F.collect_set(F.col("o_orderkey") % 997).alias("entities"))
    return r.overlapping(pending)


@query(
    "manifest_set_equality",
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)
    SELECT user_id, bool_and(a.event_type IS NOT NULL AND b.event_type IS NOT NULL) AS same FROM a FULL OUTER JOIN b USING (user_id, event_type) GROUP BY user_id""",
)
def manifest_set_equality(spark, d):
    df = table(spark, d, "events")
    return r.same_sets(df.filter("event_id % 2 = 0"), df.filter("event_id % 2 = 1"), "user_id", "event_type")


CAS = """, j AS (SELECT b.entity_name, c.cursor_at IS NOT DISTINCT FROM b.base_at AND coalesce(c.generation, 0) = coalesce(b.base_generation, 0) AS ok, coalesce(c.generation, 0) + 1 AS g, b.next_at FROM {captured} b LEFT JOIN cursors c USING (entity_name)),
w AS (SELECT bool_and(ok) AS all_ok FROM j)
SELECT entity_name, CASE WHEN NOT ok THEN 'conflict' WHEN all_ok THEN 'committed' ELSE 'held' END AS outcome, CASE WHEN all_ok THEN g END AS generation, CASE WHEN all_ok THEN next_at END AS cursor_at FROM j, w"""


def _cas(name: str, captured: str) -> None:
    QUERIES[name] = lambda spark, d: r.publish_cursors(table(spark, d, "cursors"), table(spark, d, captured))
    ORACLES[name] = with_tables("", "cursors", captured).strip() + CAS.format(captured=captured)


_cas("cursor_cas_conflict", "captured")
_cas("cursor_cas_commit", "captured_clean")


# The predicates, row by row.
@query(
    "job_dispatch",
    """SELECT j.job_id, r.run_id FROM jobs j JOIN runs r ON r.run_id = j.run_id
    WHERE j.status = 'waiting' AND r.status = 'pending' AND j.mode = r.mode AND j.version IS NOT NULL AND j.version = r.version
      AND EXISTS (SELECT 1 FROM manifests m WHERE m.run_id = r.run_id)
      AND r.run_id NOT IN (SELECT run_id FROM (SELECT run_id, entity_name FROM manifests EXCEPT SELECT run_id, entity_name FROM job_manifests) x)
      AND r.run_id NOT IN (SELECT run_id FROM (SELECT run_id, entity_name FROM job_manifests EXCEPT SELECT run_id, entity_name FROM manifests) x)
      AND NOT EXISTS (SELECT 1 FROM runs p JOIN manifests e2 ON e2.run_id = p.run_id JOIN manifests e1 ON e1.entity_name = e2.entity_name
                      WHERE e1.run_id = r.run_id AND p.status = 'pending' AND p.run_id <> r.run_id AND (p.created_at < r.created_at OR (p.created_at = r.created_at AND p.run_id < r.run_id)))
      AND NOT EXISTS (SELECT 1 FROM manifests e JOIN manifest_owners o ON o.entity_name = e.entity_name AND o.released_at IS NULL WHERE e.run_id = r.run_id)
    ORDER BY r.created_at, r.run_id, j.job_id LIMIT 100""",
    "jobs",
    "runs",
    "manifests",
    "job_manifests",
    "manifest_owners",
)
def job_dispatch(spark, d):
    return r.dispatch(*[table(spark, d, t) for t in ("jobs", "runs", "manifest_owners", "manifests", "job_manifests")])


@query(
    "due_uploads",
    """SELECT b.batch_id FROM batches b
    WHERE b.status = 'ready' AND EXISTS (SELECT 1 FROM runs r WHERE r.run_id = b.run_id AND r.status IN ('pending', 'failed'))
      AND EXISTS (SELECT 1 FROM batch_owners o WHERE o.entity_name = b.entity_name AND o.owner_run_id = b.run_id AND o.released_at IS NULL)
      AND NOT EXISTS (SELECT 1 FROM batch_attempts x WHERE x.batch_id = b.batch_id AND x.outcome <> 'precheck')
    ORDER BY b.created_at, b.batch_id LIMIT 200""",
    "batches",
    "runs",
    "batch_owners",
    "batch_attempts",
)
def due_uploads(spark, d):
    return r.due_uploads(batches=table(spark, d, "batches"), runs=table(spark, d, "runs"), owners=table(spark, d, "batch_owners"), attempts=table(spark, d, "batch_attempts"))


relational("busy_entities", r.busy, runs="runs", owners="owners")
relational("elder_runs", r.elder, runs="runs", jobs="jobs")
relational("sensitive_files", r.sensitive_files, batches="batches", entities="entities")
relational("sensitive_entities", r.sensitive_entities, entities="entities")
relational("ownership_join", r.owned_batches, owners="owned", bindings="bindings")
relational("last_run_of_cursor", r.last_run, cursors="cursors", runs="runs")
relational("attempt_blockers", r.attempt_blockers, attempts="batch_attempts", batches="batches")
relational("active_config", r.active_config, configs="configs")
relational("latest_version", r.latest_version, entities="priorities", configs="configs")
relational("config_supersede", r.supersede, configs="configs")
relational("cursor_upsert", r.upsert, cursors="cursors", fresh="fresh")
relational("begin_entity", r.begin_entity, definitions="definitions", cursors="cursors")
relational("ownership_acquire", r.acquire, definitions="priorities", owners="owners")
relational("domain_reset", r.domain_reset, cursors="cursors", definitions="definitions")
relational("cursors_after_reset", r.cursors_left, cursors="cursors", definitions="definitions")
relational("batch_retention", r.batch_retention, batches="batches", runs="runs")
relational("missing_files", r.missing_files, batches="batches", files="files")
relational("orphan_files", r.orphan_files, files="files", batches="batches")
relational("spool_size", r.spool_size, files="files")
relational("keep_newest", r.keep_newest, configs="configs")
relational("ack_first_observation", r.ack, attempts="batch_attempts")
relational("send_outcome", r.send_outcome, attempts="batch_attempts")
relational("complete_entity", r.complete_entity, entities="entities", batches="batches")


relational("duplicate_claims", r.duplicate_claims, runs="runs")
relational("constraint_report", r.constraints, runs="runs")
relational("snapshot_clock", r.snapshot_clock, configs="configs")


@query(
    "terminate_cascade",
    """, e AS (SELECT run_id FROM runs WHERE status = 'failed')
    SELECT 'run' AS kind, run_id::VARCHAR AS id, 'failed' AS status, 'STOPPED' AS error FROM e
    UNION ALL SELECT 'entity', x.run_id || '/' || x.entity_name, 'failed', 'STOPPED' FROM entities x WHERE x.status = 'extracting' AND EXISTS (SELECT 1 FROM e WHERE e.run_id = x.run_id)
    UNION ALL SELECT 'batch', x.batch_id, 'dead_letter', 'STOPPED' FROM batches x WHERE x.status NOT IN ('acknowledged', 'dead_letter', 'deleted') AND x.run_id IN (SELECT run_id FROM e)
    UNION ALL SELECT 'job', CAST(x.job_id AS VARCHAR), 'blocked', NULL FROM jobs x WHERE x.status = 'waiting' AND x.run_id IN (SELECT run_id FROM e)""",
    "runs",
    "entities",
    "batches",
    "jobs",
)
def terminate_cascade(spark, d):
    ended = table(spark, d, "runs").filter("status = 'failed'").select("run_id")
    return r.terminate(ended, *[table(spark, d, t) for t in ("entities", "batches", "jobs")], "failed", "STOPPED")


@query(
    "ack_validation",
    """SELECT b.batch_id, CASE WHEN a.batch_id IS NULL THEN 'not_stored' WHEN coalesce(a.ack_status = 'acknowledged' AND a.ack_batch_id = b.batch_id AND a.checksum_valid AND a.rows_accepted = b.row_count, FALSE) THEN 'valid'
      ELSE array_to_string(list_filter([CASE WHEN a.ack_status IS DISTINCT FROM 'acknowledged' THEN 'status' END, CASE WHEN a.ack_batch_id IS DISTINCT FROM b.batch_id THEN 'batchId' END,
        CASE WHEN a.checksum_valid IS NOT TRUE THEN 'checksumValid' END, CASE WHEN a.rows_accepted IS DISTINCT FROM b.row_count THEN 'rowsAccepted' END], lambda x: x IS NOT NULL), ', ') END AS verdict
    FROM batches b LEFT JOIN acks a USING (batch_id)""",
    "batches",
    "acks",
)
def ack_validation(spark, d):
    return r.ack_valid(table(spark, d, "batches"), table(spark, d, "acks"))


@query(
    "owned_as_requested",
    """SELECT q.run_id, coalesce(json_valid(requested) AND json_type(requested) = 'ARRAY' AND json_array_length(requested) > 0
        AND len(list_filter(json_extract(requested, '$[*]'), lambda x: json_type(x) <> 'VARCHAR' OR trim(x ->> '$') = '')) = 0
        AND list_sort(json_extract_string(requested, '$[*]')) = list_sort(list_distinct(json_extract_string(requested, '$[*]')))
        AND list_sort(json_extract_string(requested, '$[*]')) = s.bound AND s.bound = o.owned AND s.held = len(s.bound), FALSE) AS holds
    FROM (SELECT run_id, CASE WHEN json_valid(requested) THEN requested END AS requested FROM requests) q LEFT JOIN (SELECT b.run_id, list_sort(list(b.entity_name)) AS bound, count(*) FILTER (WHERE b.expected_epoch > 0 AND x.epoch = b.expected_epoch) AS held
                               FROM bindings b LEFT JOIN owned x ON x.owner_run_id = b.run_id AND x.entity_name = b.entity_name AND x.released_at IS NULL GROUP BY b.run_id) s ON s.run_id = q.run_id
    LEFT JOIN (SELECT owner_run_id, list_sort(list(entity_name)) AS owned FROM owned WHERE released_at IS NULL GROUP BY owner_run_id) o ON o.owner_run_id = q.run_id""",
    "requests",
    "bindings",
    "owned",
)
def owned_as_requested(spark, d):
    return r.owned_as_requested(table(spark, d, "requests"), table(spark, d, "bindings"), table(spark, d, "owned"))


@query(
    "names_resolved",
    """SELECT event_id, ifnull(json_type(j) = 'OBJECT' AND (coalesce(json_type(j, '$.entities'), 'NULL') = 'NULL' OR (json_type(j, '$.entities') = 'ARRAY' AND (json_array_length(j, '$.entities') = 0
      OR (len(list_filter(json_extract(j, '$.entities[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 AND list_sort(list_distinct(json_extract_string(j, '$.entities[*]'))) = ['A', 'B'])))), FALSE) AS fits
    FROM (SELECT event_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM job_payloads) t""",
    "job_payloads",
)
def names_resolved(spark, d):
    return table(spark, d, "job_payloads").select("event_id", r.names_resolved(F.col("payload"), F.array(F.lit("A"), F.lit("B"))).alias("fits"))


CONFLICTS = """SELECT command_id, payload_hash, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(occurrences) AS BIGINT) AS occurrences
    FROM (SELECT * FROM stored_conflicts UNION ALL SELECT * FROM conflicts) t GROUP BY ALL"""


@query("dedupe_conflict", CONFLICTS, "conflicts", "stored_conflicts")
def dedupe_conflict(spark, d):
    return q.conflict_occurrences(table(spark, d, "stored_conflicts"), table(spark, d, "conflicts"))


@query("newest_conflicts", f"SELECT * FROM ({CONFLICTS}) c QUALIFY row_number() OVER (ORDER BY last_seen DESC, command_id, payload_hash) <= 50", "conflicts", "stored_conflicts")
def newest_conflicts(spark, d):
    return q.newest_conflicts(dedupe_conflict(spark, d), 50)


@query(
    "certificate_bucket",
    """SELECT event_id, CASE WHEN expiry <= now THEN 0 WHEN expiry <= now + INTERVAL 1 DAY THEN 1 WHEN expiry <= now + INTERVAL 3 DAY THEN 3 WHEN expiry <= now + INTERVAL 7 DAY THEN 7
    WHEN expiry <= now + INTERVAL 14 DAY THEN 14 WHEN expiry <= now + INTERVAL 30 DAY THEN 30 END AS warn_days FROM failures""",
    "failures",
)
def certificate_bucket(spark, d):
    return table(spark, d, "failures").select("event_id", r.certificate_warning(F.col("expiry"), F.col("now")).alias("warn_days"))


@query("fail_entity", "SELECT run_id, entity_name, 'failed' AS status, expected_batches AS frozen_batches, substring(trim(regexp_replace(coalesce(failure_code, 'READ'), '[^A-Z_]', '', 'g')), 1, 8) AS message FROM entities WHERE failure_code IS NOT NULL", "entities")
def fail_entity(spark, d):
    message = F.substring(F.trim(F.regexp_replace(F.coalesce("failure_code", F.lit("READ")), "[^A-Z_]", "")), 1, 8)
    return table(spark, d, "entities").filter("failure_code is not null").select("run_id", "entity_name", F.lit("failed").alias("status"), F.col("expected_batches").alias("frozen_batches"), message.alias("message"))


# --- around a transfer --------------------------------------------------------------------------------------------
relational("source_identity", agent.identity, probes="probes")
relational("clock_model", agent.clock, probes="probes")
relational("cursor_validity", agent.cursor_valid, probes="probes")


@query(
    "quarantine_names",
    f"SELECT name, nullif(regexp_extract(name, '{agent.SET_ASIDE}', 1), '') AS entity, coalesce(CAST(nullif(regexp_extract(name, '{agent.SET_ASIDE}', 7), '') AS BIGINT), written_ms) AS since_ms FROM quarantined",
    "quarantined",
)
def quarantine_names(spark, d):
    return agent.set_aside(table(spark, d, "quarantined"))


@query(
    "error_codes",
    r"""SELECT event_id, coalesce(nullif(regexp_extract(body, '^\{"error":\s*\{[^{}]*"code":\s*"([A-Z0-9_]{1,64})"', 1), ''), nullif(regexp_extract(regexp_replace(body, '"[^"]*":\{[^{}]*\},?', '', 'g'), '^\{"code":\s*"([A-Z0-9_]{1,64})"', 1), '')) AS code FROM error_bodies""",
    "error_bodies",
)
def error_codes(spark, d):
    return table(spark, d, "error_bodies").select("event_id", payload.error_codes(spark)("body").alias("code"))


@query(
    "completion_document",
    f"""SELECT run_id, CAST(to_json(list({{'entity': entity_name, 'code': code, 'rows': row_count::BIGINT, 'batches': batch_count::BIGINT, 'readScope': read_scope}} ORDER BY entity_name)) AS VARCHAR) AS document
    FROM ({v.completion.sql.strip().format(entities="entities", runs="runs")}) GROUP BY run_id""",
    "entities",
    "runs",
)
def completion_document(spark, d):
    return agent.completion_documents(v.completion(entities=table(spark, d, "entities"), runs=table(spark, d, "runs")))


# --- payloads: no SQL has these, tests hold them against plain Python ---------------------------------------------
@query("canonical_json_hash")
def canonical_json_hash(spark, d):
    return table(spark, d, "events").select("event_id", payload.payload_hash(spark)("props").alias("payload_hash"))


@query("payload_policy")
def payload_policy(spark, d):
    return table(spark, d, "events").select("event_id", payload.policy(spark)("props").alias("code"))


@query("raw_token_digest")
def raw_token_digest(spark, d):
    df = table(spark, d, "events").withColumn("token", payload.raw_token(spark, "k")("props"))
    return v.key_digest(df, [F.col("token")], ["event_type"])


from . import identity, ledger  # noqa: E402, F401  # they add their queries to these
