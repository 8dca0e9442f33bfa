"""Extraction: a declared entity is scanned with its columns and a bounded window, rows get ids and envelopes."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import operator

_PATH = re.compile(r"[\w.$-]+|\w+/Balance\(Dimensions='\w+(,\w+)*'\)")


@dataclass(frozen=True)
class Entity:
    """What is declared of an entity; nothing is inferred from data."""

    code: str
    path: str
    keys: tuple[str, ...]
    select: tuple[str, ...]
    updated_at: str | None = None
    deleted: str | None = None
    mode: str = "incremental"
    page_size: int = 500
    overlap_minutes: int = 10
    schema_version: int = 1
    filter: str | None = None
    enabled: bool = True
    extra: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = []
        if not self.code or not self.keys or not self.select:
            out.append("code, keys and select are needed")
        if not _PATH.fullmatch(self.path or ""):
            out.append("path has characters that are not allowed")
        if not all(re.fullmatch(r"\w+", c) for c in (*self.keys, *self.select, *filter(None, (self.updated_at, self.deleted)))):
            out.append("a column name is not a plain name")
        if not 1 <= self.page_size <= 10_000:
            out.append("page size is 1 to 10000")
        if self.filter is not None and (not 1 <= len(self.filter) <= 512 or not self.filter.strip() or any(ord(c) < 32 for c in self.filter)):
            out.append("a filter has 1 to 512 characters, not blank, no control characters")
        return out

    def columns(self) -> list[str]:
        """select, keys, date and deletion mark, each once, in the order of their code points."""
        return sorted({*self.select, *self.keys, *filter(None, (self.updated_at, self.deleted))})

    def frozen(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, default=list, separators=(",", ":"))


def scan(df: DataFrame, entity: Entity, committed: dt.datetime | None = None, upper: dt.datetime | None = None, full: bool = False) -> DataFrame:
    """The entity's columns of the rows in the window: committed - overlap <= updated_at <= upper, both ends included.

    A full read has no lower end. The static filter is a conjunct of its own, so an `or` in it cannot open the window.
    Bounds are literals of the column's own type: they are pushed to the files.
    """
    if entity.problems():
        raise ValueError("; ".join(entity.problems()))
    out = df.filter(F.expr(entity.filter)) if entity.filter else df
    if entity.updated_at:
        kind = df.schema[entity.updated_at].dataType
        if committed is not None and not full:
            out = out.filter(F.col(entity.updated_at) >= F.lit(committed - dt.timedelta(minutes=entity.overlap_minutes)).cast(kind))
        if upper is not None:
            out = out.filter(F.col(entity.updated_at) <= F.lit(upper).cast(kind))
    return out.select(*entity.columns())


def key_scan(df: DataFrame, entity: Entity) -> DataFrame:
    """Keys only, under the static filter, whatever the date."""
    return (df.filter(F.expr(entity.filter)) if entity.filter else df).select(*entity.keys)


def count_scan(df: DataFrame, entity: Entity) -> DataFrame:
    return (df.filter(F.expr(entity.filter)) if entity.filter else df).agg(F.count("*").alias("n"))


def raw(column: str, kind: str) -> Column:
    """JSON text of a typed column: strings are quoted and escaped, numbers are their digits."""
    c = F.col(column)
    if kind == "string":
        return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    return c.cast("string")


def source_id(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """A single key as plain text, several as a JSON array of their raw texts. A null key is an error."""
    kinds = dict(df.dtypes)
    refuse = lambda c, k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key {k} is missing"))).otherwise(c)
    if len(keys) == 1:
        return refuse(F.col(keys[0]).cast("string"), keys[0])
    return F.concat(F.lit("["), F.concat_ws(",", *[refuse(raw(k, kinds[k]), k) for k in keys]), F.lit("]"))


def envelope(df: DataFrame, entity: Entity) -> DataFrame:
    """sourceId, sourceUpdatedAt (null if there is none), deleted (true only for a true mark), data."""
    mark = F.col(entity.deleted).eqNullSafe(F.lit(True)) if entity.deleted else F.lit(False)
    date = F.col(entity.updated_at) if entity.updated_at else F.lit(None).cast("timestamp_ntz")
    return df.select(source_id(df, entity.keys).alias("sourceId"), date.alias("sourceUpdatedAt"), mark.alias("deleted"), F.struct(*entity.columns()).alias("data"))


def final_cursor(df: DataFrame, entity: Entity, by: str | None = None) -> DataFrame:
    """The last row in the order of the scan (date, then keys): its date and id; for each value of `by`, if given."""
    order = F.struct(*filter(None, [entity.updated_at, *entity.keys]))
    last = [F.max_by(F.col(entity.updated_at), order).alias("cursor_at"), F.max_by(source_id(df, entity.keys), order).alias("cursor_id")]
    return df.groupBy(by).agg(*last) if by else df.agg(*last)


def greedy_batches(df: DataFrame, size: str, order: list[str], by: str, target: int, stream_rows: int = 2_000_000) -> DataFrame:
    """df and batch (from 1): rows fill a batch in order until its size reaches target, then the next one begins.

    The rule is a fold over each group's rows in order. While no group has more than stream_rows rows, a group is one sorted
    stream; beyond that, all of them are cut by a parallel scan over blocks of rows (filling.fill), to the same batches.
    """
    from . import filling

    largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if largest > stream_rows:
        return filling.fill(df, F.col(size), order, F.col(by), target)
    return filling.stream(df, size, order, by, target)


schedulable = operator("SELECT e.entity_name FROM {entities} e SEMI JOIN {cursors} c ON c.entity_name = e.entity_name WHERE e.enabled AND lower(e.sync_mode) <> 'manual_only'")
unschedulable = operator("""
SELECT e.entity_name, CASE WHEN NOT e.enabled THEN 'disabled' WHEN lower(e.sync_mode) = 'manual_only' THEN 'manual_only' ELSE 'no_baseline' END AS reason
FROM {entities} e LEFT JOIN {cursors} c ON c.entity_name = e.entity_name
WHERE NOT e.enabled OR lower(e.sync_mode) = 'manual_only' OR c.entity_name IS NULL
""")
balance = operator("SELECT l_partkey, l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END) AS quantity FROM {lines} GROUP BY l_partkey, l_suppkey")
# A row's cursor: its time, if it can be read, and its id.
row_cursor = operator("SELECT event_id, TRY_CAST(stamp AS TIMESTAMP_NTZ) AS cursor_at, TRY_CAST(stamp AS TIMESTAMP_NTZ) IS NOT NULL AS dated, CAST(event_id AS STRING) AS cursor_id FROM {stamps}")


def oversized(text: Column, most: int = 8 << 20) -> Column:
    """Whether a row's UTF-8 text is beyond the limit."""
    return F.octet_length(text) > most


def upper_bound(now: dt.datetime, lag_seconds: int = 30) -> dt.datetime:
    """The end of a window: some time before now, so that rows still being written are left to the next run."""
    return now - dt.timedelta(seconds=lag_seconds)


# Failure codes of reads by cause.
failure_code = operator("""
SELECT event_id, CASE WHEN cause = 'timeout' THEN 'ODATA_TIMEOUT' WHEN cause = 'http' THEN 'ODATA_HTTP_' || CAST(http AS STRING)
       WHEN cause IN ('transport', 'io') THEN 'ODATA_TRANSPORT' WHEN cause = 'limit' THEN 'ODATA_LIMIT' WHEN cause = 'json' THEN 'ODATA_JSON' ELSE 'ODATA_READ' END AS code,
       cause = 'timeout' OR cause = 'transport' OR cause = 'io' OR (cause = 'http' AND http IN (408, 429, 500, 502, 503, 504)) AS transient
FROM {failures}
""")
# What a status in a body means, and answers that count by their HTTP status alone.
BODY_OUTCOMES = {
    "succeeded": ("succeeded", "completed", "created"),
    "processing": ("processing", "executing", "pending"),
    "not_found": ("not_found",),
    "business_error": ("business_failed", "failed", "rejected", "validation_error"),
}
HTTP_OUTCOMES = {"not_found": (404,), "conflict": (409,), "business_error": (400, 401, 403, 422), "processing": (202,)}


def outcome_class(http: Column, body_status: Column) -> Column:
    """Class of an answer: by HTTP status first, then, of a success with a body, by the body's status; else technical."""
    said = F.lower(F.trim(body_status))
    by_http = [F.when(http.isin(*codes), F.lit(kind)) for kind, codes in HTTP_OUTCOMES.items()]
    by_body = [F.when(http.between(200, 299) & said.isin(*names), F.lit(kind)) for kind, names in BODY_OUTCOMES.items()]
    return F.coalesce(*by_http, *by_body, F.lit("technical"))


# Modes in which something stops.
NO_LEASE = ("pause_commands", "drain", "maintenance", "disabled")
NO_EXECUTION = ("pause_commands", "maintenance", "disabled")
NO_EXTRACTION = ("pause_etl", "maintenance", "disabled")


def mode_gate(states: DataFrame) -> DataFrame:
    """states (ready, local_paused, mode, handshake_maintenance, rejected) and what is allowed. Delivery and looking up
    what was sent need readiness only."""
    free = F.col("ready") & ~F.col("handshake_maintenance") & ~F.col("rejected")
    return states.select(
        "*",
        (free & ~F.col("mode").isin(*NO_LEASE)).alias("may_lease"),
        (free & ~F.col("mode").isin(*NO_EXECUTION)).alias("may_execute"),
        (free & ~F.col("local_paused") & ~F.col("mode").isin(*NO_EXTRACTION)).alias("may_extract"),
        F.col("ready").alias("may_deliver"),
    )
