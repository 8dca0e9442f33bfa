"""Queries over names, addresses and stored cursors, kept as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from .catalogue import query
from .tables import DERIVED, table

_ID = "'0000000a-000b-000c-000d-00000000000e'"
DERIVED |= {
    "addresses": ("events", None, {
        "event_id": "event_id",
        "data_url": "CASE event_id % 16 WHEN 0 THEN 'HTTP://Host.Example:80/Base/odata/standard.odata/' WHEN 1 THEN 'https://host.example:443/base/ODATA/x' WHEN 2 THEN 'https://host.example:8443/Base/odata' WHEN 3 THEN 'ftp://host.example/x' WHEN 4 THEN 'https://user:word@host.example/x' "
        "WHEN 5 THEN 'https://host.example/x?y=1' WHEN 6 THEN 'https://host.example/x#y' WHEN 7 THEN ' http://host.example/ ' WHEN 8 THEN 'http://host.example' WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN 'https://host.example//' WHEN 12 THEN 'host.example/x' WHEN 13 THEN 'https://host.example:80/base/odata/x' ELSE 'https://host.example/base/odata/x' END",
        "command_url": "CASE event_id % 6 WHEN 0 THEN 'https://HOST.example/base/hs/agent/' WHEN 1 THEN 'https://host.example/other/hs/agent' WHEN 2 THEN 'https://host.example/agent' WHEN 3 THEN 'http://host.example/Base/hs/agent' WHEN 4 THEN 'https://host.example:8443/Base/hs' ELSE 'https://host.example/base/hs/agent' END",
        "database_id": f"CASE event_id % 9 WHEN 0 THEN upper({_ID}) WHEN 1 THEN '00000000-0000-0000-0000-000000000000' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE {_ID} END",
        "epoch": f"CASE event_id % 11 WHEN 0 THEN '00000000-0000-0000-0000-000000000000' WHEN 1 THEN {_ID} || ' ' ELSE {_ID} END",
        "environment": "CASE event_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'Production' ELSE 'production' END",
        "token": "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN 'é' WHEN 3 THEN NULL WHEN 4 THEN repeat('x', 129) WHEN 5 THEN repeat('y', 128) ELSE 'token-' || CAST(event_id AS STRING) END",
        "code": "CASE event_id % 4 WHEN 0 THEN 'RunModeMismatch' WHEN 1 THEN 'claimLost' WHEN 2 THEN 'EntityABC' ELSE event_type END",
    }),
    "stored_cursors": ("events", None, {
        "event_id": "event_id",
        "final": "event_id % 2 = 0",
        "cursor_text": """CASE event_id % 17 WHEN 0 THEN '{"updatedAtUtc":"2024-01-05T06:07:08Z","sourceId":"7"}' WHEN 1 THEN '{"UpdatedAtUtc":null,"SOURCEID":"7"}' WHEN 2 THEN '{"updatedAtUtc":null,"sourceId":null}' WHEN 3 THEN '{}' WHEN 4 THEN '{"updatedAtUtc":"never"}' WHEN 5 THEN '{"sourceId":" "}' WHEN 6 THEN '{"sourceId":7}'
         WHEN 7 THEN '{"sourceId":"7","other":null}' WHEN 8 THEN '{"sourceId":"7","SourceId":"8"}' WHEN 9 THEN '{"sourceId":"7","sourceId":"7"}' WHEN 10 THEN '[]' WHEN 11 THEN 'broken' WHEN 12 THEN NULL WHEN 13 THEN '"text"' WHEN 14 THEN '{"updatedAtUtc":20240105}' WHEN 15 THEN '{"updatedAtUtc":"2024-13-05T06:07:08Z"}' ELSE '{"updatedAtUtc":"2024-01-05T06:07:08Z"}' END""",
    }),
}

_FORM = r"""CASE WHEN regexp_matches(u, '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#@:\[\]\s]+(:[0-9]{{1,5}})?(/[^?#\s]*)?$')
  THEN lower(regexp_extract(u, '^[a-zA-Z]+://[^/:]+')) || CASE WHEN lower(regexp_extract(u, '^[a-zA-Z]+://[^/:]+:([0-9]+)', 1)) = '' OR (u ILIKE 'http:%' AND regexp_matches(u, '^[^/]+//[^/]+:0*80(/|$)')) OR (u ILIKE 'https:%' AND regexp_matches(u, '^[^/]+//[^/]+:0*443(/|$)')) THEN '' ELSE ':' || regexp_extract(u, '^[a-zA-Z]+://[^/:]+:0*([0-9]+)', 1) END
    || CASE regexp_extract(u, '^[^/]+//[^/]+(/.*)$', 1) WHEN '/' THEN '' WHEN '//' THEN '' ELSE regexp_replace(regexp_extract(u, '^[^/]+//[^/]+(/.*)$', 1), '/$', '') END END"""


@query(
    "endpoint_form",
    f""", a AS (SELECT event_id, data_url, {_FORM.replace("{{", "{").replace("}}", "}").replace("u,", "trim(data_url),").replace("(u ", "(trim(data_url) ")} AS x, {_FORM.replace("{{", "{").replace("}}", "}").replace("u,", "trim(command_url),").replace("(u ", "(trim(command_url) ")} AS y FROM addresses)
    SELECT event_id, x AS data_endpoint, coalesce(regexp_extract(x, '^[^/]+//[^/]+') = regexp_extract(y, '^[^/]+//[^/]+') AND (strpos(lower(x || '/'), '/odata/') = 0 OR strpos(lower(y || '/'), '/hs/') = 0
      OR left(x || '/', strpos(lower(x || '/'), '/odata/') - 1) = left(y || '/', strpos(lower(y || '/'), '/hs/') - 1)), FALSE) AS same FROM a""",
    "addresses",
)
def endpoint_form(spark, d):
    return table(spark, d, "addresses").select("event_id", identity.endpoint(F.col("data_url")).alias("data_endpoint"), identity.same_publication(F.col("data_url"), F.col("command_url")).alias("same"))


@query(
    "source_binding",
    """SELECT event_id, coalesce(len(database_id) = 36 AND lower(database_id) = '0000000a-000b-000c-000d-00000000000e' AND epoch = '0000000a-000b-000c-000d-00000000000e' AND environment <> 'Production' AND event_id % 16 NOT IN (3, 4, 5, 6, 9, 10, 12), FALSE) AS valid,
      CASE WHEN database_id = '0000000a-000b-000c-000d-00000000000e' AND epoch = database_id AND environment IN ('test', 'production') THEN environment END AS parsed_environment, coalesce(len(token) BETWEEN 1 AND 128 AND NOT contains(token, ' ') AND strlen(token) = len(token), FALSE) AS token_valid,
      upper(list_aggregate(list_transform(string_split(code, ''), lambda c, i: CASE WHEN i > 1 AND c BETWEEN 'A' AND 'Z' THEN '_' || c ELSE c END), 'string_agg', '')) AS code FROM addresses""",
    "addresses",
)
def source_binding(spark, d):
    a = table(spark, d, "addresses")
    ids = [F.col(c) for c in ("database_id", "epoch", "environment")]
    return a.select(
        "event_id",
        identity.binding_valid(*ids, F.col("data_url")).alias("valid"),
        identity.parse_namespace(identity.namespace(*ids))["environment"].alias("parsed_environment"),
        identity.token_valid(F.col("token")).alias("token_valid"),
        identity.upper_snake(F.col("code")).alias("code"),
    )


@query(
    "stored_cursor",
    """SELECT event_id, coalesce(json_type(j) = 'OBJECT' AND len(json_keys(j)) = len(list_distinct(list_transform(json_keys(j), lambda k: lower(k)))) AND len(list_filter(json_keys(j), lambda k: lower(k) NOT IN ('updatedatutc', 'sourceid'))) = 0
      AND len(list_filter(json_extract(j, '$.*'), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0 AND (a IS NULL OR TRY_CAST(a AS TIMESTAMPTZ) IS NOT NULL) AND coalesce(trim(s), 'x') <> '' AND (NOT final OR coalesce(a, s) IS NOT NULL), FALSE) AS valid
    FROM (SELECT *, coalesce(j ->> '$.updatedAtUtc', j ->> '$.UpdatedAtUtc') AS a, coalesce(j ->> '$.sourceId', j ->> '$.SOURCEID') AS s FROM (SELECT event_id, final, CASE WHEN json_valid(cursor_text) THEN cursor_text END AS j FROM stored_cursors) t) u""",
    "stored_cursors",
)
def stored_cursor(spark, d):
    return table(spark, d, "stored_cursors").select("event_id", identity.cursor_valid(F.col("cursor_text"), F.col("final")).alias("valid"))
