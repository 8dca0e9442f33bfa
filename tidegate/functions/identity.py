"""Names, addresses and cursors as text: expressions, evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ends of texts are \z, as $ also stands before a last line end.
# The form of an id, of a namespace and of a service's address; environments; longest token.
ID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NO_ID = "00000000-0000-0000-0000-000000000000"
PREFIX = "1c-identity:v1:"
ENVIRONMENTS = ("test", "production")
ADDRESS = r"^(?i:(https?))://([^/?#@:\[\]\s]+)(?::([0-9]{1,5}))?(/[^?#\s]*)?\z"
TOKEN = r"^[!-~]{1,128}\z"
MARKERS = ("/odata/", "/hs/")


def endpoint(url: Column) -> Column:
    """An address in one form: scheme and host in lower case, no default port, no slash at the end; null for one with
    credentials, query or fragment, or of another scheme."""
    text = F.trim(url, F.lit(" \t\n\r\f\v"))
    part = lambda i: F.regexp_extract(text, ADDRESS, i)
    scheme, port = F.lower(part(1)), part(3)
    number = port.try_cast("int")
    default = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    path = F.regexp_replace(part(4), "(?<=.)/$", "")
    plain = F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(default, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), F.when(path == "/", "").otherwise(path))
    return F.when(text.rlike(ADDRESS), plain)


def same_publication(data_url: Column, command_url: Column) -> Column:
    """Whether two addresses are of one publication: one authority, and the same path before the usual markers, where both have them."""
    a, b = endpoint(data_url), endpoint(command_url)
    authority = lambda x: F.regexp_extract(x, "^[^/]+//[^/]+", 0)
    path = lambda x: F.concat(F.regexp_replace(x, "^[^/]+//[^/]+", ""), F.lit("/"))
    at = [F.instr(F.lower(path(x)), m) for x, m in zip((a, b), MARKERS, strict=True)]
    before = [F.substring(path(x), F.lit(1), i - 1) for x, i in zip((a, b), at, strict=True)]
    same = (authority(a) == authority(b)) & ((at[0] == 0) | (at[1] == 0) | (before[0] == before[1]))
    return F.coalesce(same, F.lit(False))


def namespace(database_id: Column, epoch: Column, environment: Column) -> Column:
    return F.concat(F.lit(PREFIX), database_id, F.lit(":"), epoch, F.lit(":"), environment)


def parse_namespace(value: Column) -> Column:
    """struct(database_id, epoch, environment) of exactly what namespace() makes; null for anything else."""
    form = f"^{PREFIX}({ID}):({ID}):({'|'.join(ENVIRONMENTS)})\\z"
    part = lambda i: F.regexp_extract(value, form, i)
    good = value.rlike(form) & (part(1) != NO_ID) & (part(2) != NO_ID)
    return F.when(good, F.struct(part(1).alias("database_id"), part(2).alias("epoch"), part(3).alias("environment")))


def binding_valid(database_id: Column, epoch: Column, environment: Column, url: Column) -> Column:
    """Whether a configured binding may be used: two ids (of any case) that are not empty, a known environment, an address."""
    real = lambda c: c.rlike(f"^(?i:{ID})\\z") & (c != NO_ID)
    return F.coalesce(real(database_id) & real(epoch) & environment.isin(*ENVIRONMENTS) & endpoint(url).isNotNull(), F.lit(False))


def token_valid(token: Column) -> Column:
    return F.coalesce(token.rlike(TOKEN), F.lit(False))


def upper_snake(name: Column) -> Column:
    """CamelCase as UPPER_SNAKE_CASE."""
    return F.upper(F.regexp_replace(name, "(?<=.)([A-Z])", "_$1"))


def cursor_valid(text: Column, final: Column) -> Column:
    """Whether a stored cursor is one: a JSON object of nothing but updatedAtUtc and sourceId (in any case, each once), texts or
    null, the time readable, the id not blank; a final one has at least one of them."""
    members = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"))
    names = F.transform(members, lambda m: F.lower(m["key"]))
    kinds = F.forall(members, lambda m: F.schema_of_variant(m["value"]).isin("STRING", "VOID"))
    value = lambda name: F.try_variant_get(F.get(F.filter(members, lambda m: F.lower(m["key"]) == name), F.lit(0))["value"], "$", "string")
    at, id_ = value("updatedatutc"), value("sourceid")
    shape = (F.size(F.array_except(names, F.array(F.lit("updatedatutc"), F.lit("sourceid")))) == 0) & (F.size(F.array_distinct(names)) == F.size(names)) & kinds
    readable = at.isNull() | at.try_cast("timestamp").isNotNull()
    named = id_.isNull() | (F.trim(id_) != "")
    return F.coalesce(shape & readable & named & (~final | at.isNotNull() | id_.isNotNull()), F.lit(False))
