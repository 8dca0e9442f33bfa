"""A paged OData service as a Spark data source: spark.read.format("tidegate_pages").

Rows are cut into ranges of $skip by the service's own $count, a Spark partition each, so that a scan is as wide as the
cluster; a service that pages by links of its own is read in their order, in one partition. Comparisons that Spark pushes
down become conjuncts of $filter, beside the window of the scan and the static filter.

A page is parsed whole before a row of it is given out, so that reading it again repeats nothing. What may pass is tried
again, with waits that double: time-outs, lost connections, broken bodies and a few statuses. All else fails the task.
Rows that come or go while a scan pages through them shift its pages, as with every $skip: the verdict on a full read
(operators.verification) is there to tell.
"""

from __future__ import annotations

import datetime as dt
import decimal
import http.client
import json
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.payload import parse
from ..operators.extraction import Entity
from ..shipping import ship
from .pages import PAGE_BYTES, ROW_BYTES, TRANSIENT, PageError, count_of, next_link, raw_rows

NAME = "tidegate_pages"
# The longest wait between two tries; operators of the service's filter language; formats of its dates.
MOST_WAIT = 60.0
OPERATORS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
DATES = {"Edm.DateTime": "datetime'{0:%Y-%m-%dT%H:%M:%S.%f}0'", "Edm.DateTimeOffset": "datetimeoffset'{0:%Y-%m-%dT%H:%M:%S.%f}0Z'"}
ISO = "{0:%Y-%m-%dT%H:%M:%S.%f}0Z"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None  # a redirect is an answer like any other, and never leads elsewhere


def get(address: str, headers: dict[str, str], seconds: float, most: int) -> str:
    """The body of an answer. At most `most` bytes are read, and one more to see that there are more."""
    request = urllib.request.Request(address, headers={"Accept": "application/json", **headers})
    with urllib.request.build_opener(_Stay).open(request, timeout=seconds) as answer:
        body = answer.read(most + 1)
        if len(body) > most:
            raise PageError("ODATA_LIMIT", "page too large")
        if answer.length:
            raise http.client.IncompleteRead(body, answer.length)
    return body.decode("utf-8-sig")


def passes(error: Exception) -> bool:
    """Whether the same read may succeed if it is tried again."""
    if isinstance(error, PageError):
        return False
    if isinstance(error, urllib.error.HTTPError):
        return error.code in TRANSIENT
    if isinstance(error, urllib.error.URLError):
        return not isinstance(error.reason, ssl.SSLError)
    return isinstance(error, OSError | http.client.HTTPException) and not isinstance(error, ssl.SSLError)


def tried(read: Callable[[], str], retries: int, base_seconds: float, wait: Callable[[float], None] = time.sleep) -> str:
    """What read gives, tried again up to `retries` times."""
    for attempt in range(retries + 1):
        try:
            return read()
        except Exception as e:
            if attempt < retries and passes(e):
                wait(min(MOST_WAIT, base_seconds * 2.0**attempt))
                continue
            if isinstance(e, urllib.error.HTTPError):
                raise PageError(f"ODATA_HTTP_{e.code}", str(e)) from e
            if isinstance(e, TimeoutError):
                raise PageError("ODATA_TIMEOUT", str(e)) from e
            if isinstance(e, OSError | http.client.HTTPException):
                raise PageError("ODATA_TRANSPORT", str(e)) from e
            raise
    raise AssertionError


def inside(base: str, link: str) -> bool:
    """Whether an address is of the service: the same scheme and host, and below its path."""
    a, b = urlsplit(link), urlsplit(base)
    under = b.path if b.path.endswith("/") else b.path + "/"
    return (a.scheme.lower(), a.netloc.lower()) == (b.scheme.lower(), b.netloc.lower()) and (a.path + "/").startswith(under) and ".." not in a.path.split("/")


def literal(value, edm: str | None = None, version: int = 4) -> str | None:
    """A value in the service's filter language, or None if it has no form there that Spark's comparison shares."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | decimal.Decimal):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo is None else value.astimezone(dt.UTC).replace(tzinfo=None)
        return (DATES[edm or "Edm.DateTime"] if version < 4 else ISO).format(at)
    return None


class PageRange(InputPartition):
    """Rows skip to end (None: to the last there is); linked: one sequence of pages that name the next."""

    def __init__(self, skip: int, end: int | None, linked: bool = False):
        self.skip, self.end, self.linked = skip, end, linked


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        get_list = lambda name: [x for x in options.get(name, "").split(",") if x]
        self.schema = schema
        self.base, self.path = options["base"] if options["base"].endswith("/") else options["base"] + "/", options["path"]
        self.columns = get_list("select") or [f.name for f in schema.fields if f.name != "raw"]
        self.order, self.conditions = get_list("order"), [c for c in [options.get("static") and f"({options['static']})", options.get("window")] if c]
        self.size = int(options.get("page_size", "500"))
        self.pages = int(options.get("pages_per_partition", "50"))
        self.paging = options.get("paging", "auto")
        self.retries, self.wait, self.seconds = int(options.get("retries", "3")), float(options.get("wait_ms", "500")) / 1000, float(options.get("timeout_seconds", "100"))
        self.page_bytes, self.row_bytes = int(options.get("page_bytes", str(PAGE_BYTES))), int(options.get("row_bytes", str(ROW_BYTES)))
        self.version, self.edm = int(options.get("odata_version", "4")), options.get("edm")
        self.headers = {"OData-Version": str(self.version)} | ({"Authorization": options["authorization"]} if "authorization" in options else {})
        if self.paging not in ("auto", "ranges", "links"):
            raise ValueError("paging is auto, ranges or links")
        if not 1 <= self.size <= 10_000 or self.pages < 1:
            raise ValueError("page size is 1 to 10000, and a partition has a page or more")

    # --- planning ---

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            said = self.condition(f)
            if said:
                self.conditions.append(said)
            # order and equality of texts may be others there than here, so Spark looks at these again
            if not said or isinstance(self._values(f)[0], str):
                yield f

    @staticmethod
    def _values(f: Filter) -> Sequence:
        return list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]

    def condition(self, f: Filter) -> str | None:
        """A conjunct of $filter that holds wherever f does, or None."""
        if not isinstance(f, (*OPERATORS, In)) or len(f.attribute) != 1 or f.attribute[0] not in self.columns:
            return None
        values = self._values(f)
        texts = [literal(v, self.edm, self.version) for v in values]
        if not texts or None in texts or (isinstance(values[0], str) and not isinstance(f, (EqualTo, In))):
            return None
        name = f.attribute[0]
        if isinstance(f, In):
            return "(" + " or ".join(f"{name} eq {t}" for t in texts) + ")"
        return f"{name} {OPERATORS[type(f)]} {texts[0]}"

    def address(self, skip: int, top: int) -> str:
        options = {"$select": ",".join(sorted(set(self.columns))), "$top": str(top), "$skip": str(skip), "$orderby": ",".join(self.order), "$filter": " and ".join(self.conditions)}
        return urljoin(self.base, self.path + "?" + "&".join(f"{k}={quote(v, safe='')}" for k, v in options.items() if v))

    def count(self) -> int:
        said = f"?$filter={quote(' and '.join(self.conditions), safe='')}" if self.conditions else ""
        return count_of(self.fetch(urljoin(self.base, f"{self.path}/$count{said}")))

    def partitions(self) -> list[InputPartition]:
        if self.paging == "links":
            return [PageRange(0, None, True)]
        n, step = self.count(), self.size * self.pages
        if self.paging == "auto" and next_link(parse(self.fetch(self.address(0, self.size)))):
            return [PageRange(0, None, True)]
        starts = list(range(0, max(n, 1), step))
        return [PageRange(s, s + step if s != starts[-1] else None) for s in starts]

    # --- reading ---

    def fetch(self, address: str) -> str:
        return tried(lambda: get(address, self.headers, self.seconds, self.page_bytes), self.retries, self.wait)

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for rows in self.linked() if partition.linked else self.ranged(partition):
            if rows:
                yield self.batch(rows, schema)

    def ranged(self, partition: PageRange) -> Iterator[list[str]]:
        skip = partition.skip
        while partition.end is None or skip < partition.end:
            top = self.size if partition.end is None else min(self.size, partition.end - skip)
            body = self.fetch(self.address(skip, top))
            if next_link(parse(body)):
                raise PageError("ODATA_READ", "the service pages by links: read it with paging=links")
            rows = raw_rows(body, self.page_bytes, self.row_bytes)
            yield rows
            if len(rows) < top:
                return
            skip += len(rows)

    def linked(self) -> Iterator[list[str]]:
        """Pages by links once there was one, whose absence then ends the scan; until then by $skip."""
        address, skip, followed = self.address(0, self.size), 0, False
        seen = {address}
        while True:
            body = self.fetch(address)
            rows = raw_rows(body, self.page_bytes, self.row_bytes)
            yield rows
            link = next_link(parse(body))
            if link and link.strip():
                address, followed = urljoin(address, link), True
                if not inside(self.base, address):
                    raise PageError("ODATA_READ", "a link leaves the service")
                if address in seen:
                    raise PageError("ODATA_READ", "a link came twice")
                seen.add(address)
            elif followed or len(rows) < self.size:
                return
            else:
                skip += len(rows)
                address = self.address(skip, self.size)

    def batch(self, rows: list[str], schema: pa.Schema) -> pa.RecordBatch:
        parsed = [json.loads(r, parse_float=decimal.Decimal) for r in rows]
        columns = [pa.array(rows, pa.string()) if f.name == "raw" else pa.array([_value(p.get(f.name), f.type) for p in parsed], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _value(x, kind: pa.DataType):
    """A member of a row as a value of a column; what does not fit it fails the scan."""
    if x is None:
        return None
    if pa.types.is_string(kind):
        return x if isinstance(x, str) else json.dumps(x, default=str)
    if pa.types.is_timestamp(kind):
        at = dt.datetime.fromisoformat(x)
        return at if kind.tz else at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at
    if pa.types.is_date(kind):
        return dt.datetime.fromisoformat(x).date()
    if pa.types.is_boolean(kind) != isinstance(x, bool):
        raise PageError("ODATA_JSON", f"{x!r} is no {kind}")
    if pa.types.is_floating(kind):
        return float(x)
    if pa.types.is_integer(kind):
        whole = int(x)
        if isinstance(x, str) or whole != x:
            raise PageError("ODATA_JSON", f"{x!r} is no {kind}")
        return whole
    return decimal.Decimal(x) if pa.types.is_decimal(kind) else x


class PageSource(DataSource):
    """Options: base, path; select, order, window, static (a part of the address each); page_size, pages_per_partition,
    paging (auto, ranges, links); retries, wait_ms, timeout_seconds; page_bytes, row_bytes; odata_version, edm; authorization.
    A column `raw` has a row's own JSON text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    ship(spark).dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def options(entity: Entity, base: str, committed: dt.datetime | None = None, upper: dt.datetime | None = None, full: bool = False, keys_only: bool = False, odata_version: int = 4, edm: str = "Edm.DateTime", **more: str) -> dict[str, str]:
    """Options that read a declared entity: its columns, order, window (as extraction.scan has it) and static filter."""
    if entity.problems():
        raise ValueError("; ".join(entity.problems()))
    date = None if keys_only else entity.updated_at
    bounds = []
    if date and committed is not None and not full:
        bounds.append(f"{date} ge {literal(committed - dt.timedelta(minutes=entity.overlap_minutes), edm, odata_version)}")
    if date and upper is not None:
        bounds.append(f"{date} le {literal(upper, edm, odata_version)}")
    found = {
        "base": base,
        "path": entity.path,
        "select": ",".join(sorted(entity.keys) if keys_only else entity.columns()),
        "order": ",".join([*filter(None, [date]), *[k for k in entity.keys if k != date]]),
        "static": entity.filter or "",
        "window": " and ".join(bounds),
        "page_size": str(entity.page_size),
        "odata_version": str(odata_version),
        "edm": edm,
    }
    return {k: v for k, v in found.items() if v} | more
