"""Runs, batches, cursors and ownership: state transitions as the rows that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import operator


def overlapping(pending: DataFrame) -> DataFrame:
    """run_id of pending runs (run_id, created_at, entities) that no older pending run shares an entity with.

    Entities are exploded and each keeps its first run (min, combined map-side); a run is free if it is the first of
    all its entities. No pair of runs is ever formed.
    """
    each = pending.select("run_id", F.struct("created_at", "run_id").alias("place"), F.explode("entities").alias("entity"))
    first = each.groupBy("entity").agg(F.min("place").alias("first"))
    return each.join(first, "entity").groupBy("run_id").agg(F.bool_and(F.col("place") == F.col("first")).alias("free")).filter("free").select("run_id")


def same_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key and same: whether both sides have the same set of values for it. One shuffle, no pairs."""
    both = left.select(key, value, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, value, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = both.groupBy(key, value).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.groupBy(key).agg(F.bool_and((F.col("l") == 1) & (F.col("r") == 1)).alias("same"))


def text_list(json_text: Column) -> Column:
    """The strings of a JSON array of strings; null for anything else, blank or repeated entries included."""
    parsed = F.try_parse_json(json_text)
    each = F.try_variant_get(parsed, "$", "array<variant>")
    strings = F.transform(each, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    good = F.forall(strings, lambda x: x.isNotNull() & (F.trim(x) != "")) & (F.size(F.array_distinct(strings)) == F.size(strings))
    return F.when(F.coalesce(good, F.lit(False)), strings)


def owned_as_requested(requests: DataFrame, bindings: DataFrame, owners: DataFrame) -> DataFrame:
    """run_id and holds: whether the entities that a run asks for (requested, JSON), those bound to it and those it
    actively owns are the same, not none, and at the same positive epochs.

    The three sets meet in one aggregation by (run, entity); no pairs are formed.
    """
    asked = requests.select("run_id", text_list(F.col("requested")).alias("names"))
    null = F.lit(None).cast("long")
    rows = (
        asked.select("run_id", F.explode("names").alias("entity_name"), F.lit(1).alias("asked"), null.alias("bound"), null.alias("owned"))
        .union(bindings.select("run_id", "entity_name", F.lit(0), F.col("expected_epoch").cast("long"), null))
        .union(owners.filter("released_at is null").select("owner_run_id", "entity_name", F.lit(0), null, F.col("epoch").cast("long")))
    )
    each = rows.groupBy("run_id", "entity_name").agg(F.max("asked").alias("asked"), F.max("bound").alias("bound"), F.max("owned").alias("owned"))
    fits = (F.col("asked") == 1) & F.coalesce((F.col("bound") > 0) & (F.col("bound") == F.col("owned")), F.lit(False))
    whole = each.groupBy("run_id").agg(F.bool_and(fits).alias("fits"))
    return asked.join(whole, "run_id", "left").select("run_id", (F.coalesce(F.size("names") > 0, F.lit(False)) & F.coalesce("fits", F.lit(False))).alias("holds"))


def names_resolved(payload: Column, resolved: Column) -> Column:
    """Whether a job's payload names the resolved entities: an object without `entities` or with an empty list stands for
    all of them; otherwise a list of texts, none empty, that is the same set."""
    parsed = F.try_parse_json(payload)
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    given = F.try_variant_get(parsed, "$.entities", "variant")
    absent = given.isNull() | (F.schema_of_variant(given) == "VOID")
    each = F.try_variant_get(given, "$", "array<variant>")
    texts = F.transform(each, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    same = F.forall(texts, lambda x: x.isNotNull() & (x != "")) & (F.size(F.array_except(texts, resolved)) == 0) & (F.size(F.array_except(resolved, texts)) == 0)
    return kind.startswith("OBJECT") & F.coalesce(F.when(absent, F.lit(True)).when(F.size(each) == 0, F.lit(True)).otherwise(same), F.lit(False))


def publish_cursors(current: DataFrame, captured: DataFrame) -> DataFrame:
    """Compare and swap, all or none: entity_name, outcome ('committed' with the next generation, or 'conflict').

    captured: entity_name, base_at, base_generation, next_at. Null bases match null cursors only.
    """
    joined = captured.alias("b").join(current.alias("c"), "entity_name", "left")
    ok = F.col("c.cursor_at").eqNullSafe(F.col("b.base_at")) & F.coalesce("c.generation", F.lit(0)).eqNullSafe(F.coalesce("b.base_generation", F.lit(0)))
    each = joined.select("entity_name", ok.alias("ok"), (F.coalesce("c.generation", F.lit(0)) + 1).alias("generation"), "b.next_at")
    whole = each.agg(F.bool_and("ok").alias("all_ok"))
    return each.crossJoin(F.broadcast(whole)).select(  # one row
        "entity_name",
        F.when(~F.col("ok"), "conflict").when(F.col("all_ok"), "committed").otherwise("held").alias("outcome"),
        F.when(F.col("all_ok"), F.col("generation")).alias("generation"),
        F.when(F.col("all_ok"), F.col("next_at")).alias("cursor_at"),
    )


def dispatch(jobs: DataFrame, runs: DataFrame, owners: DataFrame, manifests: DataFrame, job_manifests: DataFrame, limit: int = 100) -> DataFrame:
    """job_id, run_id of the first `limit` waiting jobs that may start, by their runs' age.

    A job's mode, version and entities must be its run's (manifests: run_id, entity_name); no older pending run may share
    an entity, and no entity may be owned. All of it is decided before the limit, so that a busy head hides no eligible job.
    """
    pending = runs.filter("status = 'pending'").select("run_id", "created_at", "mode", "version")
    entities = pending.join(manifests, "run_id").groupBy("run_id", "created_at").agg(F.collect_set("entity_name").alias("entities"))
    owned = manifests.join(owners.filter("released_at IS NULL"), "entity_name", "left_semi").select("run_id")
    same = same_sets(manifests, job_manifests, "run_id", "entity_name").filter("same")
    eligible = pending.join(overlapping(entities), "run_id", "left_semi").join(owned, "run_id", "left_anti").join(same, "run_id", "left_semi")
    own = jobs.filter("status = 'waiting'").join(eligible, ["run_id", "mode", "version"])
    return own.orderBy("created_at", "run_id", "job_id").limit(limit).select("job_id", "run_id")


busy = operator("SELECT r.run_id FROM {runs} r ANTI JOIN (SELECT entity_name FROM {owners} WHERE released_at IS NULL) o ON o.entity_name = r.entity_name WHERE r.status = 'pending'")
elder = operator("SELECT r.run_id, j.job_id FROM {runs} r LEFT JOIN {jobs} j ON j.run_id = r.run_id WHERE r.status IN ('pending', 'blocked')")
sensitive_files = operator("SELECT b.batch_id FROM {batches} b JOIN {entities} e ON e.run_id = b.run_id AND e.entity_name = b.entity_name WHERE e.sensitive AND b.status <> 'acknowledged'")
sensitive_entities = operator("SELECT DISTINCT entity_name FROM {entities} WHERE sensitive")
owned_batches = operator("""
SELECT o.entity_name, o.owner_run_id, o.epoch FROM {owners} o JOIN {bindings} b ON b.run_id = o.owner_run_id AND b.entity_name = o.entity_name AND b.expected_epoch = o.epoch
WHERE o.released_at IS NULL
""")
last_run = operator("SELECT c.entity_name, c.cursor_at, r.status FROM {cursors} c JOIN {runs} r ON r.run_id = c.last_run_id")
attempt_blockers = operator("SELECT b.run_id, count(*) AS attempts FROM {attempts} a JOIN {batches} b ON b.batch_id = a.batch_id WHERE a.outcome NOT IN ('precheck') GROUP BY b.run_id")
due_uploads = operator("""
SELECT b.batch_id FROM {batches} b SEMI JOIN (SELECT run_id FROM {runs} WHERE status IN ('pending', 'failed')) r ON r.run_id = b.run_id
SEMI JOIN (SELECT entity_name, owner_run_id FROM {owners} WHERE released_at IS NULL) o ON o.owner_run_id = b.run_id AND o.entity_name = b.entity_name
ANTI JOIN (SELECT batch_id FROM {attempts} WHERE outcome <> 'precheck') a ON a.batch_id = b.batch_id
WHERE b.status = 'ready' ORDER BY b.created_at, b.batch_id LIMIT :limit
""", limit=200)
active_config = operator("SELECT entity_name, max_by(run_id, version) AS run_id, max(version) AS version FROM {configs} WHERE status = 'active' GROUP BY entity_name")
latest_version = operator("SELECT e.entity_name, coalesce(max(c.version), 0) AS version FROM {entities} e LEFT JOIN {configs} c ON c.entity_name = e.entity_name AND c.status <> 'rejected' GROUP BY e.entity_name")
supersede = operator("""
SELECT run_id, entity_name, version, CASE WHEN status = 'rejected' THEN 'rejected' WHEN version = max(CASE WHEN status <> 'rejected' THEN version END) OVER (PARTITION BY entity_name) THEN 'active' ELSE 'superseded' END AS next_status
FROM {configs}
""")
upsert = operator("""
SELECT coalesce(n.entity_name, c.entity_name) AS entity_name, coalesce(n.cursor_at, c.cursor_at) AS cursor_at, coalesce(c.generation, 0) + CASE WHEN n.entity_name IS NULL THEN 0 ELSE 1 END AS generation
FROM {cursors} c FULL OUTER JOIN {fresh} n ON n.entity_name = c.entity_name
""")
begin_entity = operator("""
SELECT e.entity_name, CASE WHEN c.entity_name IS NULL THEN 'absent' WHEN c.fingerprint IS NULL THEN 'unknown' WHEN c.fingerprint = e.fingerprint THEN 'same' ELSE 'changed' END AS domain_status,
       CASE WHEN c.entity_name IS NULL AND e.mode = 'incremental' THEN 'BASELINE_REQUIRED' WHEN c.fingerprint <> e.fingerprint AND e.mode = 'incremental' THEN 'RESET' ELSE 'BEGIN' END AS action
FROM {definitions} e LEFT JOIN {cursors} c ON c.entity_name = e.entity_name
""")
acquire = operator("""
SELECT d.entity_name, CASE WHEN t.held > 0 THEN 'refused' ELSE 'acquired' END AS outcome, coalesce(o.epoch, 0) + 1 AS epoch
FROM {definitions} d LEFT JOIN {owners} o ON o.entity_name = d.entity_name
CROSS JOIN (SELECT count(*) AS held FROM {owners} h SEMI JOIN {definitions} w ON w.entity_name = h.entity_name WHERE h.released_at IS NULL) t
""")
domain_reset = operator("SELECT c.entity_name, c.generation, c.cursor_at AS archived_at FROM {cursors} c SEMI JOIN {definitions} d ON d.entity_name = c.entity_name AND d.generation = c.generation")
cursors_left = operator("SELECT c.entity_name FROM {cursors} c ANTI JOIN {definitions} d ON d.entity_name = c.entity_name AND d.generation = c.generation")
# Statuses of what a terminated run leaves open.
OPEN_BATCHES = ("creating", "ready", "retry_waiting", "uploading")
CLOSED_JOBS = ("finished", "cancelled", "blocked")


def terminate(ended: DataFrame, entities: DataFrame, batches: DataFrame, jobs: DataFrame, status: str, code: str) -> DataFrame:
    """kind, id, status, error of every row that changes when the runs in `ended` (run_id) end with a status.

    Entities still extracting fail, batches not yet sent go to the dead letters, open jobs are blocked: unresolved work
    is never called finished. Ownership stays as it is.
    """

    def part(kind: str, rows: DataFrame, key: Column, to: str, error: str | None = code) -> DataFrame:
        return rows.join(ended.select("run_id"), "run_id", "left_semi").select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), F.lit(to).alias("status"), F.lit(error).cast("string").alias("error"))

    return (
        part("run", ended, F.col("run_id"), status)
        .union(part("entity", entities.filter("status = 'extracting'"), F.concat_ws("/", F.col("run_id").cast("string"), F.col("entity_name")), "failed"))
        .union(part("batch", batches.filter(F.col("status").isin(*OPEN_BATCHES)), F.col("batch_id"), "dead_letter"))
        .union(part("job", jobs.filter(~F.col("status").isin(*CLOSED_JOBS)), F.col("job_id"), "blocked", None))
    )


batch_retention = operator("""
SELECT b.batch_id FROM {batches} b SEMI JOIN (SELECT run_id FROM {runs} WHERE status = 'succeeded') r ON r.run_id = b.run_id
WHERE b.status = 'acknowledged' AND b.acknowledged_at < CAST(:before AS TIMESTAMP_NTZ)
""", before='1997-01-01 00:00:00')
dead_letter_files = operator("""
SELECT b.batch_id, b.entity_name FROM {batches} b JOIN {runs} r ON r.run_id = b.run_id
JOIN {entities} e ON e.run_id = b.run_id AND e.entity_name = b.entity_name
WHERE b.status = 'dead_letter' AND NOT e.sensitive AND (r.resolved_at IS NOT NULL OR r.status IN ('failed', 'cancelled', 'succeeded', 'partial_success')) AND b.created_at < CAST(:before AS TIMESTAMP_NTZ)
""", before='2000-01-01 00:00:00')
missing_files = operator("SELECT DISTINCT b.run_id FROM {batches} b ANTI JOIN {files} f ON f.batch_id = b.batch_id WHERE b.status = 'ready'")
orphan_files = operator("SELECT f.batch_id FROM {files} f ANTI JOIN {batches} b ON b.batch_id = f.batch_id")
spool_size = operator("SELECT coalesce(sum(bytes), 0) AS bytes, coalesce(sum(CASE WHEN quarantined THEN bytes ELSE 0 END), 0) AS quarantined FROM {files}")
keep_newest = operator("SELECT entity_name, run_id FROM (SELECT entity_name, run_id, row_number() OVER (PARTITION BY entity_name ORDER BY version DESC, run_id DESC) AS n FROM {configs}) x WHERE n > :keep", keep=3)
ack = operator("SELECT batch_id, min_by(hash, attempt_no) AS hash, min(attempt_no) AS attempt_no, count(DISTINCT hash) > 1 AS conflicting FROM {attempts} WHERE outcome = 'acknowledged' GROUP BY batch_id")
def ack_valid(batches: DataFrame, acks: DataFrame) -> DataFrame:
    """batch_id and verdict: 'not_stored' without an answer, 'valid' if all of it matches the batch, else what does not.

    acks: batch_id (that was sent), ack_status, ack_batch_id, checksum_valid, rows_accepted.
    """
    a, b = acks.alias("a"), batches.select("batch_id", "row_count").alias("b")
    wrong = F.concat_ws(
        ", ",
        F.when(~F.col("ack_status").eqNullSafe("acknowledged"), "status"),
        F.when(~F.col("ack_batch_id").eqNullSafe(F.col("b.batch_id")), "batchId"),
        F.when(~F.col("checksum_valid").eqNullSafe(True), "checksumValid"),
        F.when(~F.col("rows_accepted").eqNullSafe(F.col("row_count")), "rowsAccepted"),
    )
    verdict = F.when(F.col("a.batch_id").isNull(), "not_stored").when(wrong == "", "valid").otherwise(wrong)
    return b.join(a, F.col("a.batch_id") == F.col("b.batch_id"), "left").select("b.batch_id", verdict.alias("verdict"))


send_outcome = operator("""
SELECT batch_id, CASE WHEN count_if(outcome = 'acknowledged') > 0 THEN 'acknowledged' WHEN count_if(outcome IN ('unknown', 'refused')) > 0 THEN 'block'
       WHEN count_if(outcome = 'unsent') >= :most THEN 'dead_letter' WHEN count_if(outcome = 'unsent') > 0 THEN 'retry' ELSE 'wait' END AS action
FROM {attempts} GROUP BY batch_id
""", most=5)
complete_entity = operator("""
SELECT e.run_id, e.entity_name FROM {entities} e JOIN (SELECT run_id, entity_name, count(*) AS n FROM {batches} GROUP BY run_id, entity_name) b
  ON b.run_id = e.run_id AND b.entity_name = e.entity_name WHERE b.n = e.expected_batches AND b.n >= 1 AND e.failure_code IS NULL
""")
duplicate_claims = operator("SELECT entity_name, count(*) AS n FROM {runs} WHERE status = 'pending' GROUP BY entity_name HAVING count(*) > 1")
constraints = operator("""
SELECT 'status' AS rule, count_if(status NOT IN ('pending', 'succeeded', 'failed', 'blocked')) AS violations FROM {runs}
UNION ALL SELECT 'finished_after_start', count_if(finished_at < started_at) FROM {runs}
UNION ALL SELECT 'failure_has_code', count_if(status = 'failed' AND failure_code IS NULL) FROM {runs}
""")
snapshot_clock = operator("SELECT run_id, entity_name, version, max(version - n) OVER (PARTITION BY entity_name ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + n AS snapshot_at FROM (SELECT run_id, entity_name, version, row_number() OVER (PARTITION BY entity_name ORDER BY run_id) AS n FROM {configs}) x")
def health(limits: dict, source: str = "source") -> tuple[Column, Column]:
    """(state, reason) of a row: rejected, mode, state_bytes, spool_bytes, disk_free, command_api, data_api, drift_ms,
    runs_unresolved, entities_failing, lag_seconds. The first that applies counts. limits: state_bytes, spool_bytes,
    reserve_bytes, drift_ms, lag_seconds (None: lag is not judged)."""
    name = source.upper()
    late = F.lit(False) if limits.get("lag_seconds") is None else F.coalesce(F.col("lag_seconds") > limits["lag_seconds"], F.lit(False))
    # States and their order.
    order = [
        (F.col("rejected"), "incompatible_version", F.lit("COMPATIBILITY_REJECTED")),
        (F.col("mode").isin("maintenance", "disabled"), "maintenance", F.concat(F.lit("MODE_"), F.upper("mode"))),
        (F.col("state_bytes") >= limits["state_bytes"], "storage_critical", F.lit("STATE_LIMIT")),
        (F.col("spool_bytes") >= limits["spool_bytes"], "storage_critical", F.lit("SPOOL_LIMIT")),
        (F.col("disk_free") <= limits["reserve_bytes"], "storage_critical", F.lit("DISK_RESERVE")),
        (~F.col("command_api") & ~F.col("data_api"), f"offline_{source}", F.lit(f"{name}_UNAVAILABLE")),
        (~F.col("command_api"), "degraded", F.lit(f"{name}_COMMAND_API_UNAVAILABLE")),
        (~F.col("data_api"), "degraded", F.lit(f"{name}_DATA_UNAVAILABLE")),
        (F.abs("drift_ms") > limits["drift_ms"], "degraded", F.lit("CLOCK_DRIFT")),
        (F.col("runs_unresolved") > 0, "degraded", F.lit("RUNS_UNRESOLVED")),
        (F.col("entities_failing") > 0, "degraded", F.lit("ENTITIES_FAILING")),
        (late, "degraded", F.lit("LAG")),
    ]
    state = F.coalesce(*[F.when(when, F.lit(s)) for when, s, _ in order], F.lit("healthy"))
    reason = F.coalesce(*[F.when(when, r) for when, _, r in order], F.lit("OK"))
    return state, reason


# Days before expiry at which certificates are warned of.
WARN_DAYS = (30, 14, 7, 3, 1)


def certificate_warning(expiry: Column, now: Column) -> Column:
    """The tightest of WARN_DAYS that the time left does not exceed; 0 from the expiry on, null while none is reached."""
    left = F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.when(left <= 0, 0).otherwise(F.array_min(F.filter(F.array(*map(F.lit, WARN_DAYS)), lambda d: left <= d.cast("long") * 86_400_000_000)))
