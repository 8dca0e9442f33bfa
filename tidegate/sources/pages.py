"""Pages of an OData service as JSON text: rows out of the shapes that services answer with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import canonical, parse
from ..shipping import ship

# HTTP statuses that are worth another try; members that name the next page.
TRANSIENT = (408, 429, 500, 502, 503, 504)
NEXT = ("@odata.nextLink", "odata.nextLink", "__next")
PAGE_BYTES, ROW_BYTES = 64 << 20, 8 << 20


class PageError(ValueError):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def members(page) -> dict:
    return dict(page[1]) if isinstance(page, tuple) and page[0] == "o" else {}


def rows(page) -> list:
    """Rows of a parsed page: an array, `value`, `d` as an array, or `d.results`."""
    top = members(page)
    for found in (page, top.get("value"), top.get("d"), members(top.get("d")).get("results")):
        if isinstance(found, tuple) and found[0] == "a":
            return found[1]
    raise PageError("ODATA_JSON", "no rows in the page")


def next_link(page) -> str | None:
    top = members(page)
    for holder in (top, members(top.get("d"))):
        for name in NEXT:
            if isinstance(holder.get(name), str):
                return str(holder[name])
    return None


def raw_rows(text: str, page_bytes: int = PAGE_BYTES, row_bytes: int = ROW_BYTES) -> list[str]:
    """JSON text of each row of a page; a page or row beyond its limit, or a row that is no object, is an error."""
    if len(text.encode()) > page_bytes:
        raise PageError("ODATA_LIMIT", "page too large")
    try:
        found = rows(parse(text.removeprefix("﻿")))
    except PageError:
        raise
    except ValueError as e:
        raise PageError("ODATA_JSON", str(e)) from e
    out = []
    for row in found:
        if not isinstance(row, tuple) or row[0] != "o":
            raise PageError("ODATA_JSON", "a row is not an object")
        raw = canonical(row)
        if len(raw.encode()) > row_bytes:
            raise PageError("ODATA_LIMIT", "row too large")
        out.append(raw)
    return out


def explode_pages(pages: DataFrame) -> DataFrame:
    """page_no, raw: a row for each row of each page (page_no, body)."""
    ship(pages.sparkSession)

    @F.pandas_udf("array<string>")
    def split(s):
        return s.map(raw_rows)

    return pages.select("page_no", F.explode(split("body")).alias("raw"))


def count_of(body: str) -> int:
    """A $count answer: a whole number of at most 20 characters, a byte-order mark allowed."""
    text = body.removeprefix("﻿").strip()
    if not text.isascii() or not text.isdigit() or len(text) > 20:
        raise PageError("COUNT_FAILED", "no count")
    return int(text)
