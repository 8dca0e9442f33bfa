"""Command queue: what is ready, in which order, and what blocks it; intake, claims, retries, retention.

The head-of-line rule is a running count per ordering key instead of a self join: a key's rows are sorted once, and a
key that holds a large share of all rows is compacted to its first open row (min_by), which is all the rule needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import operator

# Statuses that no longer hold up their key, and those from which a command may run.
CLOSED = ("completed", "cancelled", "expired", "dead_letter")
RUNNABLE = ("queued", "retry_waiting", "unknown_result")
# Allowed transitions of a command.
TRANSITIONS = {
    "received": ("queued", "dead_letter"),
    "queued": ("executing", "expired", "cancelled", "dead_letter"),
    "executing": ("succeeded_local", "business_failed_local", "retry_waiting", "unknown_result"),
    "unknown_result": ("executing", "succeeded_local", "business_failed_local", "retry_waiting", "dead_letter"),
    "retry_waiting": ("queued", "dead_letter"),
    "succeeded_local": ("result_pending",),
    "business_failed_local": ("result_pending",),
    "expired": ("result_pending",),
    "cancelled": ("result_pending",),
    "dead_letter": ("result_pending",),
    "result_pending": ("completed",),
    "completed": (),
}
# Seconds to wait after each attempt.
RETRY_SECONDS = (1, 2, 5, 10, 30, 60, 300)


def due(now: Column, not_before: Column) -> Column:
    """Runnable, and its times have come; not_before holds back only what was never sent."""
    sent = (F.col("status") == "unknown_result") | (F.col("attempt_count") > 0) | (F.col("post_attempt_count") > 0) | F.col("first_sent_at").isNotNull()
    return F.col("status").isin(*RUNNABLE) & (F.col("not_before").isNull() | (F.col("not_before") <= not_before) | sent) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def heads(commands: DataFrame) -> DataFrame:
    """ordering_key and head: place (received_at, queue_sequence) of the key's first open command. Combined map-side."""
    open_rows = commands.filter(F.col("ordering_key").isNotNull() & ~F.col("status").isin(*CLOSED))
    return open_rows.groupBy("ordering_key").agg(F.min(F.struct("received_at", "queue_sequence")).alias("head"))


def ready(commands: DataFrame, now: Column, not_before: Column) -> DataFrame:
    """Commands that an execution pass would take now: due, and no earlier open command has their ordering key."""
    first = heads(commands).select(F.col("ordering_key").alias("_key"), "head")
    joined = commands.filter(due(now, not_before)).join(first, F.col("ordering_key") == F.col("_key"), "left")
    return joined.filter(F.col("ordering_key").isNull() | ~(F.col("head") < F.struct("received_at", "queue_sequence"))).select(commands.columns)


def take_ready(commands: DataFrame, now: Column, not_before: Column, limit: int) -> DataFrame:
    """The next `limit` ready commands: by priority, then arrival. Eligibility comes before the limit."""
    return ready(commands, now, not_before).orderBy(F.desc("priority"), F.asc("received_at"), F.asc("queue_sequence")).limit(limit)


def ready_count(commands: DataFrame, now: Column, not_before: Column) -> DataFrame:
    return ready(commands, now, not_before).filter(F.col("exec_claim_owner_id").isNull()).agg(F.count("*").alias("ready"))


def blockers(commands: DataFrame) -> DataFrame:
    """command_id and how many earlier open commands of its key hold it up: a running count."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("ordering_key").orderBy("received_at", "queue_sequence").rowsBetween(W.unboundedPreceding, -1)
    keyed = commands.filter("ordering_key is not null")
    return keyed.select("command_id", F.coalesce(F.sum((~F.col("status").isin(*CLOSED)).cast("long")).over(w), F.lit(0)).alias("n_before"))


def retry_seconds(attempt: Column) -> Column:
    """Seconds to wait after the attempt, without jitter: by the table, its last entry beyond."""
    table = F.array(*map(F.lit, RETRY_SECONDS))
    return F.element_at(table, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))


def backoff_millis(attempt: Column, base: int, most: int) -> Column:
    """base * 2^(attempt - 1), at most 2^16 times and at most `most`; no jitter."""
    power = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(16))
    return F.least(F.lit(base) * F.pow(F.lit(2.0), power).cast("long"), F.lit(most).cast("long"))


def transition_violations(steps: DataFrame) -> DataFrame:
    """Rows of steps (from_status, to_status, ...) that the state machine does not allow."""
    spark = steps.sparkSession
    edges = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")
    return steps.join(F.broadcast(edges), ["from_status", "to_status"], "left_anti")  # a fixed table of 26 edges


# Statuses that count as waiting, by table.
WAITING_COMMANDS = (*RUNNABLE, "executing")
WAITING_RESULTS = ("pending", "sending", "retry_waiting")
DELIVERED = ("acknowledged", "dead_letter")
WAITING_BATCHES = ("ready", "uploading", "retry_waiting")
UNRESOLVED = ("blocked", "failed")


def metrics(commands: DataFrame, results: DataFrame, batches: DataFrame, runs: DataFrame, entities: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The nine numbers of a heartbeat, one row. A dead letter counts by its result, whatever became of the result since.

    An entity fails if the last succeeded run that had it (by finish, then id) skipped it with a code: the latest row of
    each entity is a maximum, combined on the map side.
    """
    waiting = F.col("status").isin(*WAITING_COMMANDS)
    c = commands.agg(F.count_if(waiting).alias("commands_pending"), F.count_if(F.col("result_status") == "dead_letter").alias("commands_dead"), F.min(F.when(waiting, F.col("received_at"))).alias("oldest_command"))
    o = results.agg(F.count_if(~F.col("status").isin(*DELIVERED)).alias("results_pending"), F.count_if(F.col("status") == "dead_letter").alias("results_dead"), F.min(F.when(F.col("status").isin(*WAITING_RESULTS), F.col("created_at"))).alias("oldest_result"))
    b = batches.agg(F.count_if(F.col("status").isin(*WAITING_BATCHES)).alias("batches_pending"), F.count_if(F.col("status") == "dead_letter").alias("batches_dead"))
    u = runs.filter(F.col("status").isin(*UNRESOLVED)).join(resolutions.select("run_id"), "run_id", "left_anti").agg(F.count("*").alias("runs_unresolved"))
    done = entities.select("run_id", F.col("entity_name").alias("e"), "failure_code").join(runs.filter("status = 'succeeded'").select("run_id", "finished_at"), "run_id")
    latest = done.groupBy("e").agg(F.max_by(F.col("failure_code").isNotNull(), F.struct("finished_at", "run_id")).alias("fails"))
    f = latest.agg(F.count_if("fails").alias("entities_failing"))
    one = c.crossJoin(o).crossJoin(b).crossJoin(u).crossJoin(f)  # one row each
    total = F.col("commands_dead") + F.col("results_dead") + F.col("batches_dead")
    return one.select("commands_pending", "results_pending", "batches_pending", total.alias("dead_letters"), "commands_dead", "oldest_command", "oldest_result", "runs_unresolved", "entities_failing")


# Intake: by id, stored, known or in conflict with what is known; invalid ones are refused first.
intake = operator("""
SELECT i.command_id,
       CASE WHEN i.payload IS NULL THEN 'rejected' WHEN c.command_id IS NULL THEN 'stored'
            WHEN c.payload_hash = i.payload_hash THEN 'duplicate' ELSE 'payload_conflict' END AS outcome
FROM {incoming} i LEFT JOIN {commands} c ON c.command_id = i.command_id
""")

def admission(envelopes: DataFrame, supported: list[str], version: int = 1) -> DataFrame:
    """command_id and code: the first reason, in a fixed order, to refuse a command, or null.

    envelopes: command_id (text), command_type, payload_version, payload, payload_hash; refused, the code that the payload
    policy gives or null; computed_hash, that of the canonical payload.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    # Codes.
    checks = [
        (blank("command_id") | (F.col("command_id") == "00000000-0000-0000-0000-000000000000"), F.lit("INVALID_COMMAND_ID")),
        (blank("command_type") | ~F.col("command_type").isin(*supported), F.lit("UNSUPPORTED_COMMAND_TYPE")),
        (~F.col("payload_version").eqNullSafe(version), F.lit("UNSUPPORTED_PAYLOAD_VERSION")),
        (F.col("payload").isNull(), F.lit("INVALID_PAYLOAD")),
        (blank("payload_hash"), F.lit("PAYLOAD_HASH_MISMATCH")),
        (F.col("refused").isNotNull(), F.col("refused")),
        (F.col("payload_hash") != F.col("computed_hash"), F.lit("PAYLOAD_HASH_MISMATCH")),
    ]
    return envelopes.select("command_id", F.coalesce(*[F.when(when, code) for when, code in checks]).alias("code"))


def conflict_occurrences(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored conflicts and newly seen ones (command_id, payload_hash, first_seen, last_seen, occurrences) as one table."""
    both = stored.unionByName(seen)
    return both.groupBy("command_id", "payload_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"))


def newest_conflicts(conflicts: DataFrame, limit: int) -> DataFrame:
    """A report of the last seen conflicts, newest first, then by id."""
    return conflicts.orderBy(F.desc("last_seen"), "command_id", "payload_hash").limit(limit)


def numbered(df: DataFrame, order: list[str], coarse: Column) -> DataFrame:
    """df and _n: the place of each row, from 1, in the order of the whole table.

    coarse rises with order (hours of a time, say): rows are counted by it, a table of as many rows as it has values gives
    each its offset, and rows are numbered within it. No task sees more than the rows of one coarse value.
    """
    from pyspark.sql.window import Window as W

    rows = df.withColumn("_coarse", coarse)
    counts = rows.groupBy("_coarse").agg(F.count("*").alias("_rows"))
    offsets = counts.select("_coarse", F.coalesce(F.sum("_rows").over(W.orderBy("_coarse").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_coarse").orderBy(*order))
    return rows.withColumn("_inside", inside).join(offsets, "_coarse").withColumn("_n", F.col("_before") + F.col("_inside")).drop("_coarse", "_inside", "_before")


def sequence_backfill(commands: DataFrame) -> DataFrame:
    """command_id, queue_sequence of rows that have none (0): their place among all rows by arrival, then id."""
    places = numbered(commands.select("command_id", "received_at", "queue_sequence"), ["received_at", "command_id"], F.date_trunc("hour", "received_at"))
    return places.filter("queue_sequence = 0").select("command_id", F.col("_n").alias("queue_sequence"))


def sequence_allocation(commands: DataFrame, incoming: DataFrame) -> DataFrame:
    """command_id, queue_sequence of commands that come in new: beyond the largest of the whole table, by arrival, then id."""
    new = incoming.select("command_id", "received_at").join(commands.select("command_id"), "command_id", "left_anti")
    top = commands.agg(F.coalesce(F.max("queue_sequence"), F.lit(0)).alias("top"))
    places = numbered(new, ["received_at", "command_id"], F.date_trunc("hour", "received_at"))
    return places.crossJoin(F.broadcast(top)).select("command_id", (F.col("top") + F.col("_n")).alias("queue_sequence"))  # one row


# What older rows lack: the first send, by the attempts, or for rows that have none by the start; sends, by the attempts counted.
first_sent_backfill = operator("""
SELECT c.command_id, coalesce(c.first_sent_at, a.started, CASE WHEN a.command_id IS NULL AND c.attempt_count > 0 THEN c.started_at END) AS first_sent_at,
       CASE WHEN c.post_attempt_count = 0 AND c.attempt_count > 0 THEN c.attempt_count ELSE c.post_attempt_count END AS post_attempt_count
FROM {commands} c LEFT JOIN (SELECT command_id, min(started_at) AS started FROM {attempts} GROUP BY command_id) a ON a.command_id = c.command_id
""")

def retention(commands: DataFrame, results: DataFrame, jobs: DataFrame, before) -> DataFrame:
    """command_id of rows that leave: completed, acknowledged before a time, no dead letter, nothing open in outbox or jobs."""
    done = commands.filter((F.col("status") == "completed") & (F.col("acknowledged_at") < F.lit(before)) & ~F.col("result_status").eqNullSafe("dead_letter")).select("command_id")
    open_results = results.filter(~F.col("status").eqNullSafe("acknowledged")).select("command_id")
    open_jobs = jobs.filter(~F.coalesce(F.col("status").isin("finished", "cancelled"), F.lit(False))).select("command_id")
    return done.join(open_results, "command_id", "left_anti").join(open_jobs, "command_id", "left_anti")


# Crash recovery: what was running is of unknown result and due at once; claims on what may run go, others stay as evidence;
# a result that was being sent is sent again.
queue_recovery = operator("""
SELECT 'command' AS kind, command_id AS id, status AS from_status, 'unknown_result' AS to_status, 'PROCESS_RESTART' AS code FROM {commands} WHERE status = 'executing'
UNION ALL SELECT 'claim', command_id, status, status, NULL FROM {commands} WHERE status IN ('queued', 'retry_waiting', 'unknown_result') AND (exec_claim_owner_id IS NOT NULL OR exec_claim_acquired_at IS NOT NULL)
UNION ALL SELECT 'result', command_id, status, 'pending', NULL FROM {results} WHERE status = 'sending'
""")


def claim(commands: DataFrame, owner: str, now: Column, not_before: Column, stale_before: Column) -> DataFrame:
    """What a claim by owner would take, as it then is: ready commands whose claim is free, or was left before stale_before.

    Status and attempts stay as they are; they change when the command is sent.
    """
    free = F.col("exec_claim_owner_id").isNull() | F.col("exec_claim_acquired_at").isNull() | (F.col("exec_claim_acquired_at") < stale_before)
    return ready(commands, now, not_before).filter(free).select("command_id", "status", "attempt_count", "post_attempt_count", F.lit(owner).alias("exec_claim_owner_id"), now.alias("exec_claim_acquired_at"))


def release_claim(commands: DataFrame, owner: str) -> DataFrame:
    """Claims after owner lets go of its own; those of others stay."""
    return commands.filter("exec_claim_owner_id is not null").select("command_id", F.when(F.col("exec_claim_owner_id") != owner, F.col("exec_claim_owner_id")).alias("exec_claim_owner_id"))


# Statuses from which a command may be finished or put off, and of a result that is not yet delivered.
OPEN_COMMANDS = (*RUNNABLE, "executing")
OPEN_RESULTS = ("pending", "retry_waiting", "sending")


def _owned(reporter: str) -> Column:
    """Whether the claim is the reporter's; one that reports without a claim may touch unclaimed commands only."""
    return F.col("exec_claim_owner_id").eqNullSafe(F.col(reporter))


def reschedule(commands: DataFrame, reports: DataFrame, now: Column, seconds: int = 2) -> DataFrame:
    """reports (command_id, to_status, owner, retry_at) and what they change: command_id, status, next_attempt_at; claims go."""
    may = F.col("status").isin(*OPEN_COMMANDS) & _owned("owner")
    at = F.coalesce("retry_at", now + F.make_dt_interval(secs=F.lit(seconds)))
    return reports.join(commands, "command_id").filter(may).select("command_id", F.col("to_status").alias("status"), at.alias("next_attempt_at"))


def finish(commands: DataFrame, results: DataFrame, endings: DataFrame) -> DataFrame:
    """endings (command_id, local_status, owner) and what they come to: command_id, finished, status, result_status, outbox_status.

    A command is cancelled only if it was never tried or sent. Its result is put out, unless one was acknowledged before.
    """
    never = F.col("status").isin("queued", "retry_waiting") & (F.col("attempt_count") == 0) & (F.col("post_attempt_count") == 0) & F.col("first_sent_at").isNull()
    may = F.col("status").isin(*OPEN_COMMANDS) & _owned("owner") & ((F.col("local_status") != "cancelled") | never)
    known = results.select("command_id", F.col("status").alias("out"))
    out = F.when(F.col("out") == "acknowledged", F.col("out")).otherwise("pending")
    return endings.join(commands, "command_id").join(known, "command_id", "left").select(
        "command_id",
        may.alias("finished"),
        F.when(may, "result_pending").otherwise(F.col("status")).alias("status"),
        F.when(may, F.col("local_status")).alias("result_status"),
        F.when(may, out).otherwise(F.col("out")).alias("outbox_status"),
    )


# The outbox: what waits, also for another try, and is due; first in first out.
outbox_due = operator("""
SELECT o.result_id, o.command_id, o.attempt_count, c.command_type FROM {results} o LEFT JOIN {commands} c ON c.command_id = o.command_id
WHERE o.status IN ('pending', 'retry_waiting') AND (o.next_attempt_at IS NULL OR o.next_attempt_at <= CAST(:now AS TIMESTAMP_NTZ)) ORDER BY o.created_at, o.result_id LIMIT :limit
""", now="2024-01-25 00:00:00", limit=50)


def outbox_transitions(results: DataFrame, commands: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (command_id, answer: acknowledged, retry or conflict) to sent results, and what they change: command_id, applied,
    outbox_status, command_status. Only an undelivered result moves; an acknowledgement or a retry needs its command to have the result."""
    c = commands.select("command_id", F.col("status").alias("of_command"), (F.col("status").isin("result_pending", "completed") & F.col("result_status").isNotNull() & F.col("result_json").isNotNull()).alias("held"))
    whole = answers.join(results.select("command_id", F.col("status").alias("out")), "command_id", "left").join(c, "command_id", "left")
    applied = F.coalesce(F.col("out").isin(*OPEN_RESULTS) & ((F.col("answer") == "conflict") | F.coalesce("held", F.lit(False))), F.lit(False))
    to = F.when(F.col("answer") == "conflict", "dead_letter").when(F.col("answer") == "retry", "retry_waiting").otherwise("acknowledged")
    return whole.select(
        "command_id",
        applied.alias("applied"),
        F.when(applied, to).otherwise(F.col("out")).alias("outbox_status"),
        F.when(applied & (F.col("answer") == "acknowledged"), "completed").otherwise(F.col("of_command")).alias("command_status"),
    )


outbox_merge = operator("""
SELECT coalesce(n.command_id, o.command_id) AS command_id, CASE WHEN n.command_id IS NULL THEN o.status ELSE 'pending' END AS status
FROM {results} o FULL OUTER JOIN (SELECT command_id FROM {commands} WHERE status = 'result_pending') n ON n.command_id = o.command_id
""")

insert_if_absent = operator("SELECT c.command_id, 'pending' AS status FROM {commands} c ANTI JOIN {results} o ON o.command_id = c.command_id WHERE c.status = 'completed'")

close_attempt = operator("SELECT command_id, min_by(outcome, attempt_no) AS outcome, min(attempt_no) AS attempt_no FROM {attempts} WHERE outcome IS NOT NULL GROUP BY command_id")

last_outcome = operator("""
SELECT c.command_id, a.outcome, coalesce(a.n, 0) AS attempts
FROM {commands} c LEFT JOIN (SELECT command_id, max_by(outcome, attempt_no) AS outcome, count(*) AS n FROM {attempts} GROUP BY command_id) a ON a.command_id = c.command_id
""")
