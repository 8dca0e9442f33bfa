"""The page source against a small service of its own."""

import datetime as dt
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pytest

from tidegate.operators import extraction as ex
from tidegate.sources import pages, service

ROWS = [{"k": i, "name": f"n'{i % 7}", "at": f"2024-01-{1 + i % 28:02d}T00:00:00", "price": i / 4 if i % 5 else None, "open": i % 3 == 0} for i in range(1000)]
SCHEMA = "k long, name string, at timestamp_ntz, price decimal(10,2), open boolean"


def holds(row, text):
    """Whether a row meets a $filter of comparisons, `and`, and one `or` in parentheses."""
    for part in re.split(r" and (?![^()]*\))", text):
        part = part.strip()
        if part.startswith("(") and part.endswith(")"):
            if not any(holds(row, x) for x in part[1:-1].split(" or ")):
                return False
            continue
        name, op, value = part.split(" ", 2)
        value = value[1:-1].replace("''", "'") if value.startswith("'") else value.startswith("2") and "T" in value and value[:19] or json.loads(value)
        x = row[name]
        if x is None or not {"eq": x == value, "ge": x >= value, "gt": x > value, "le": x <= value, "lt": x < value}[op]:
            return False
    return True


class Service:
    def __init__(self):
        self.asked, self.trouble, self.link, self.shape, self.limit = [], [], None, 0, None
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *a):
                pass

            def do_GET(self):
                outer.answer(self)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}/odata/"

    def answer(self, h):
        self.asked.append(unquote(h.path))
        if self.trouble:
            code = self.trouble.pop(0)
            if code == "cut":
                h.send_response(200)
                h.send_header("Content-Length", "100")
                h.end_headers()
                h.wfile.write(b"[")
                h.close_connection = True
                return
            if code == "drop":
                h.connection.close()
                return
            h.send_response(code)
            if code == 302:
                h.send_header("Location", "http://127.0.0.1:1/")
            h.end_headers()
            return
        query = {k: v[0] for k, v in parse_qs(urlsplit(h.path).query).items()}
        rows = [r for r in ROWS if not query.get("$filter") or holds(r, query["$filter"])]
        if urlsplit(h.path).path.endswith("$count"):
            body = "﻿" + str(len(rows))
        else:
            skip, top = int(query.get("$skip", 0)), int(query.get("$top", 10**6))
            n = min(top, self.limit or top)
            page = [{c: r[c] for c in query["$select"].split(",")} for r in rows[skip : skip + n]]
            more = self.limit and skip + n < len(rows)
            link = self.link or f"items?$select={query['$select']}&$skip={skip + n}&$top={top}"
            shape = self.shape % 4
            body = json.dumps(page if shape == 0 and not more else {"value": page, **({"@odata.nextLink": link} if more else {})} if shape < 2 else {"d": page} if shape == 2 and not more else {"d": {"results": page, **({"__next": link} if more else {})}})
        data = body.encode()
        h.send_response(200)
        h.send_header("Content-Length", str(len(data)))
        h.end_headers()
        h.wfile.write(data)


@pytest.fixture
def served(spark):
    service.register(spark)
    s = Service()
    yield s
    s.server.shutdown()


def read(spark, s, schema=SCHEMA, **more):
    return spark.read.format(service.NAME).schema(schema).options(**{"base": s.base, "path": "items", "order": "k", "page_size": "100", "pages_per_partition": "2", "wait_ms": "1"} | more).load()


def test_ranges_give_the_table(spark, served):
    for shape in range(4):
        served.shape = shape
        df = read(spark, served)
        assert df.rdd.getNumPartitions() == 5
        got = {r.k: r for r in df.collect()}
        assert len(got) == 1000 and got[7].name == "n'0" and got[1].at == dt.datetime(2024, 1, 2) and str(got[3].price) == "0.75" and got[5].price is None and got[6].open is True
    assert json.loads(read(spark, served, "raw string", select="k,name").first().raw) == {"k": 0, "name": "n'0"}


def test_filters_reach_the_address(spark, served):
    df = read(spark, served).filter("k >= 10 and k < 500 and name = \"n'3\" and at <= timestamp_ntz'2024-01-09' and open")
    assert sorted(r.k for r in df.collect()) == [r["k"] for r in ROWS if 10 <= r["k"] < 500 and r["name"] == "n'3" and r["at"] <= "2024-01-09T00:00:00" and r["open"]]
    said = [p for p in served.asked if "$filter" in p]
    assert said and all("k ge 10" in p and "k lt 500" in p and "name eq 'n''3'" in p and "at le 2024-01-09T00:00:00.0000000Z" in p for p in said)
    assert any("/$count?$filter=" in p for p in said)
    served.asked.clear()
    df = read(spark, served).filter("k in (3, 999) and price > 0.5 and upper(name) <> 'X' and name > 'n'")
    assert [r.k for r in df.collect()] == [3, 999]
    assert all("(k eq 3 or k eq 999)" in p and "price gt 0.5" in p and "upper" not in p and "name gt" not in p for p in served.asked)


def test_links_are_followed(spark, served):
    served.limit, served.shape = 60, 3
    df = read(spark, served)
    assert df.rdd.getNumPartitions() == 1 and sorted(r.k for r in df.collect()) == list(range(1000))
    served.link = served.base + "items?$select=k,name,at,price,open&$skip=60&$top=100"
    with pytest.raises(Exception, match="came twice"):
        read(spark, served).collect()
    for link in ("http://elsewhere/odata/items", "/other/items", "/odata/../x", "https://127.0.0.1/odata/items"):
        served.link = link
        with pytest.raises(Exception, match="leaves the service"):
            read(spark, served, paging="links").collect()
    with pytest.raises(Exception, match="paging=links"):
        read(spark, served, paging="ranges").collect()


def test_what_may_pass_is_tried_again(spark, served):
    served.trouble = [503, "drop", "cut", 429]
    assert read(spark, served, paging="ranges", retries="4", pages_per_partition="50").count() == 1000
    for trouble, code in (([500] * 9, "ODATA_HTTP_500"), ([404], "ODATA_HTTP_404"), ([302], "ODATA_HTTP_302"), (["drop"] * 9, "ODATA_TRANSPORT")):
        served.trouble = list(trouble)
        with pytest.raises(Exception, match=code):
            read(spark, served, retries="2").collect()
        served.trouble = []


def test_limits(spark, served):
    with pytest.raises(Exception, match="page too large"):
        read(spark, served, page_bytes="1000").collect()
    with pytest.raises(Exception, match="row too large"):
        read(spark, served, row_bytes="20").collect()
    with pytest.raises(Exception, match="is no int64"):
        read(spark, served, "k long, price long").collect()


def test_an_entity_as_options(spark, served):
    e = ex.Entity("items", "items", ("k",), ("name", "price"), updated_at="at", page_size=300, filter="k lt 900 or k gt 950")
    given = service.options(e, served.base, dt.datetime(2024, 1, 10, 0, 5), dt.datetime(2024, 1, 20))
    df = spark.read.format(service.NAME).schema("k long, name string, at timestamp_ntz").options(**given).load()
    want = [r["k"] for r in ROWS if "2024-01-09T23:55:00" <= r["at"] <= "2024-01-20T00:00:00" and (r["k"] < 900 or r["k"] > 950)]
    assert sorted(r.k for r in df.collect()) == want
    assert all("(k lt 900 or k gt 950) and at ge 2024-01-09T23:55:00.0000000Z and at le" in p for p in served.asked) and "$orderby=at,k" in served.asked[-1]
    keys = service.options(e, served.base, upper=dt.datetime(2024, 1, 2), keys_only=True)
    assert keys["select"] == "k" and "window" not in keys and keys["order"] == "k"
    assert service.literal(dt.datetime(2024, 1, 2, 3, 4, 5, 6), "Edm.DateTime", 3) == "datetime'2024-01-02T03:04:05.0000060'"
    assert service.literal(dt.datetime(2024, 1, 2, tzinfo=dt.UTC), "Edm.DateTimeOffset", 3) == "datetimeoffset'2024-01-02T00:00:00.0000000Z'"
    with pytest.raises(ValueError, match="not allowed"):
        service.options(ex.Entity("x", "a/../b", ("k",), ("k",)), served.base)


def test_waits_double_up_to_a_minute():
    waits = []

    def fails():
        raise TimeoutError("slow")

    with pytest.raises(pages.PageError, match="ODATA_TIMEOUT"):
        service.tried(fails, 9, 0.5, waits.append)
    assert waits == [0.5, 1, 2, 4, 8, 16, 32, 60, 60]
