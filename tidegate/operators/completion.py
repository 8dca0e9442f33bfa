"""A stored completion body against what the tables say: every value is worked out again, the names must be exact.

Bodies are read as VARIANT, which refuses a name that comes twice; a name that differs by case only is one too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a body, its entities and a source's identity hold, names in order; modes that a run may have.
IDENTITY = "databaseId string, environment string, exportEpoch string"
ENTITY = "batchesCreated bigint, completeness string, completenessReason string, entity string, errorCode string, errorMessage string, readScope string, rowsRead bigint, snapshotAtUtc string, status string"
BODY = (
    f"batchesAcknowledged bigint, batchesCreated bigint, completedAtUtc string, entities array<struct<{ENTITY}>>, entitiesFailed bigint, "
    f"mode string, rowsRead bigint, runId string, sourceGeneration string, sourceIdentity struct<{IDENTITY}>, status string"
)
MODES = ("incremental", "bootstrap_full", "entity_reload")


def _text(value: Column) -> Column:
    """The kind of a JSON text, or of the JSON null that stands where none is expected."""
    return F.when(value.isNull(), "VOID").otherwise("STRING")


def _object(*fields: tuple[str, str | Column, Column | None]) -> Column:
    """The kind of an object, as schema_of_variant writes it, of (name, kind, condition or null) in the order of names."""
    parts = []
    for name, kind, when in fields:
        part = F.concat(F.lit(f"{name}: "), F.lit(kind) if isinstance(kind, str) else kind)
        parts.append(part if when is None else F.when(when, part))
    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *parts), F.lit(">"))


def stored_valid(bodies: DataFrame, runs: DataFrame, entities: DataFrame) -> DataFrame:
    """run_id, valid for each stored body (run_id, body).

    runs: run_id, mode, rows_read, batches_created, batches_acknowledged, database_id, export_epoch, environment, generation
    (the last four null where the run has none). entities: run_id, entity_name, row_total, batches, failure_code,
    failure_message, read_scope, completeness, completeness_reason, snapshot_at. A run's entities are its bounded manifest.
    """
    checked = F.col("completeness").isNotNull()
    item = {
        "entity": F.col("entity_name"), "batchesCreated": F.col("batches").cast("long"), "completeness": F.col("completeness"), "completenessReason": F.when(checked, F.col("completeness_reason")), "errorCode": F.col("failure_code"), "errorMessage": F.col("failure_message"),
        "readScope": F.col("read_scope"), "rowsRead": F.col("row_total").cast("long"), "snapshotAtUtc": F.col("snapshot_at"), "status": F.when(F.col("failure_code").isNotNull(), "failed").otherwise("done"),
    }
    expected = entities.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*[value.alias(name) for name, value in item.items()]))).alias("expected"), F.count("failure_code").alias("failed"))
    whole = bodies.join(runs, "run_id").join(expected, "run_id", "left").withColumn("v", F.try_parse_json("body"))
    whole = whole.withColumn("got", F.try_variant_get("v", "$", f"struct<{BODY}>")).withColumn("listed", F.try_variant_get("v", "$.entities", "variant"))
    identity, generation = F.col("database_id").isNotNull(), F.col("generation").isNotNull()

    def kind(e: Column) -> Column:
        checked, dated = e["completeness"].isNotNull(), e["snapshotAtUtc"].isNotNull()
        return _object(
            ("batchesCreated", "BIGINT", None), ("completeness", "STRING", checked), ("completenessReason", _text(e["completenessReason"]), checked), ("entity", _text(e["entity"]), None), ("errorCode", _text(e["errorCode"]), None), ("errorMessage", _text(e["errorMessage"]), None),
            ("readScope", _text(e["readScope"]), None), ("rowsRead", "BIGINT", None), ("snapshotAtUtc", "STRING", dated), ("status", "STRING", None),
        )

    planned = F.coalesce("expected", F.array().cast(expected.schema["expected"].dataType))
    failed = F.coalesce("failed", F.lit(0))
    who = _object(("databaseId", "STRING", None), ("environment", _text(F.col("environment")), None), ("exportEpoch", _text(F.col("export_epoch")), None))
    shape = _object(
        ("batchesAcknowledged", "BIGINT", None), ("batchesCreated", "BIGINT", None), ("completedAtUtc", "STRING", None), ("entities", F.schema_of_variant("listed"), None), ("entitiesFailed", "BIGINT", None), ("mode", "STRING", None), ("rowsRead", "BIGINT", None),
        ("runId", "STRING", None), ("sourceGeneration", "STRING", generation), ("sourceIdentity", who, identity), ("status", "STRING", None),
    )
    got = lambda name: F.col(f"got.{name}")
    valid = (
        F.col("mode").isin(*MODES)
        & (got("runId") == F.col("run_id").cast("string"))
        & (got("status") == F.when(failed == 0, "succeeded").otherwise("partial_success"))
        & (got("mode") == F.col("mode"))
        & (got("rowsRead") == F.col("rows_read"))
        & (got("batchesCreated") == F.col("batches_created"))
        & (got("batchesAcknowledged") == F.col("batches_acknowledged"))
        & (got("entitiesFailed") == failed)
        & got("completedAtUtc").rlike(r"^\d{4}-\d\d-\d\dT")
        & got("completedAtUtc").try_cast("timestamp").isNotNull()
        & (~identity | ((got("sourceIdentity.databaseId") == F.col("database_id")) & got("sourceIdentity.exportEpoch").eqNullSafe(F.col("export_epoch")) & got("sourceIdentity.environment").eqNullSafe(F.col("environment"))))
        & got("sourceGeneration").eqNullSafe(F.col("generation"))
        & (F.transform(got("entities"), lambda x: F.struct(*[x[name].alias(name) for name in item])) == planned)
        & (F.schema_of_variant("v") == shape)
        & (F.transform(F.try_variant_get("listed", "$", "array<variant>"), F.schema_of_variant) == F.transform(planned, kind))
    )
    return whole.select("run_id", F.coalesce(valid, F.lit(False)).alias("valid"))
