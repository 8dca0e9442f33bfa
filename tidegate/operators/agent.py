"""What surrounds a transfer: identity of the source, clocks, names of set-aside files, documents for the receiver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import operator
from .runs import health

# Hexadecimal groups of an id in file names.
_ID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
SET_ASIDE = rf"^(.+)-{_ID}-{_ID}\.ndjson\.gz(\.tmp)?(\.orphan)?(\.([0-9]{{1,15}}))?$"


def set_aside(files: DataFrame) -> DataFrame:
    """files (name, written_ms) and entity, since_ms: from the name if it has that form, else no entity and the write time."""
    millis = F.regexp_extract("name", SET_ASIDE, 7)
    return files.select("name", F.nullif(F.regexp_extract("name", SET_ASIDE, 1), F.lit("")).alias("entity"), F.coalesce(F.nullif(millis, F.lit("")).cast("long"), F.col("written_ms")).alias("since_ms"))


def completion_documents(items: DataFrame) -> DataFrame:
    """run_id and document: one JSON text for each run, entities by name. A run has a bounded manifest of entities."""
    entry = F.struct(F.col("entity_name").alias("entity"), F.col("code"), F.col("row_count").alias("rows"), F.col("batch_count").alias("batches"), F.col("read_scope").alias("readScope"))
    return items.groupBy("run_id").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("document"))


# The verdict on a fetched identity, against what the source is bound to; the first difference counts.
identity = operator("""
SELECT event_id, CASE WHEN bound IS NULL THEN 'BindingMissing' WHEN bound = '' THEN 'BindingInvalid' WHEN endpoint <> bound_endpoint THEN 'EndpointMismatch'
       WHEN fetched = 'unavailable' THEN 'Unavailable' WHEN fetched = 'not_ready' THEN 'NotReady' WHEN fetched = 'malformed' THEN 'Malformed'
       WHEN scope <> 'whole-infobase' THEN 'ScopeUnsupported' WHEN database_id <> bound THEN 'DatabaseMismatch' WHEN epoch <> :epoch THEN 'EpochMismatch'
       WHEN environment <> :environment THEN 'EnvironmentMismatch' ELSE 'Match' END AS verdict FROM {probes}
""", epoch=3, environment='prod')

# Clocks: the offset is taken at the middle of a round trip, half of which is its uncertainty. An expiry is judged by the
# later clock, a not-before by the earlier one.
clock = operator("""
SELECT event_id, remote_ms - (sent_ms + received_ms) / 2 AS offset_ms, (received_ms - sent_ms) / 2 AS uncertainty_ms,
       abs(remote_ms - (sent_ms + received_ms) / 2) - (received_ms - sent_ms) / 2 > 30000 AS drifts,
       expires_ms <= remote_ms + (received_ms - sent_ms) / 2 AS expired, not_before_ms <= remote_ms - (received_ms - sent_ms) / 2 AS may_start FROM {probes}
""")

# A cursor is valid with a date that parses or none, and an id that is not blank or none; a final one has either.
cursor_valid = operator("""
SELECT event_id, (stamp IS NULL OR TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL) AND (cursor_id IS NULL OR trim(cursor_id) <> '') AS valid,
       (stamp IS NOT NULL OR cursor_id IS NOT NULL) AND (stamp IS NULL OR TRY_CAST(stamp AS TIMESTAMP) IS NOT NULL) AND (cursor_id IS NULL OR trim(cursor_id) <> '') AS valid_final FROM {probes}
""")

def heartbeat(metrics: DataFrame, vitals: DataFrame, limits: dict) -> DataFrame:
    """One row: the queue's numbers (queue.metrics), and the state that they and the vitals (one row) come to."""
    state, reason = health(limits)
    return metrics.crossJoin(vitals).select(*metrics.columns, state.alias("state"), reason.alias("reason"))  # one row each
