import hashlib

import pytest

from tidegate.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nhttp://x 1 2 3 4\n"
    data = warc.arc_file(version, "f.arc", [("http://h/a b", "19990102030405", "text/html", body), ("dns:h", "1999", "text/dns", b"")])
    block, page, dns = warc.parse_arc(data)
    assert block.version == version and page.body == body and page.fields["url"] == "http://h/a b" and dns.body == b""
    w = warc.convert(page)
    assert w.headers["WARC-Type"] == "response" and w.headers["WARC-Date"] == "1999-01-02T03:04:05Z" and w.payload == b"body\nhttp://x 1 2 3 4\n"
    assert w.headers == warc.convert(page).headers
    assert [warc.convert(x).headers["WARC-Type"] for x in (block, dns)] == ["warcinfo", "resource"]
    assert warc.convert(dns).headers["WARC-Date"] == "1999-01-01T00:00:00Z"
    assert list(warc.parse_warc(warc.serialize(w) + b"\r\n\r\n")) == [w]


@pytest.mark.parametrize("data", [b"http://x 0.0.0.0 1 t 0\n\n", b"filedesc://x 0.0.0.0 1 text/plain 99\n1 0 x\n", b"filedesc://x 0.0.0.0 1 text/plain 6\n7 0 x\n\n", b"filedesc"])
def test_broken_arc_is_an_error(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_archive(spark):
    big = "<p>é</p>" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "u r l", "small"), (5, "http://c", "small"), (6, "http://d", None), (7, "http://d", ""), (8, "http://e", "a\r\n\r\nWARC/1.0\r\n\r\n" * 100), (9, "http://e", "y" * 300_000), (None, "http://f", big), (10, "http://g", "z" * 1000), (10, "http://g", "z" * 1000), (11, "http://h", "q" * 999), (12, "http://h", "q" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, head string")
    got = warc.read_back(spark, warc.archive(pages)).collect()
    assert len(got) == len(rows)
    html = {}
    for p, _, h in rows:
        html.setdefault(p, (h or "").encode())
    for r in got:
        data = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        want = 3 if data == big.encode() and r.page_id != 3 else None
        assert (r.record_type, r.refers_to) == ("revisit" if want else "response", want)
        assert r.payload == (None if want else data)
    empty = warc.archive(pages.limit(0))
    assert warc.read_back(spark, empty).count() == 0


def test_archives_as_they_are(spark, tmp_path):
    """Images, Latin-1, heads with bare LF, no head's end, gzip members: bytes go through whole."""
    import gzip

    png = b"\x89PNG\r\n\x1a\n\x00\xff\xfe" + bytes(range(256)) * 8
    bodies = [
        b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\n\r\n" + png,
        b"HTTP/1.0 200 OK\nX-Page-Id: 2\n\n" + "caf\xe9 \xfcber".encode("latin-1") + b"\r\n\r\n" + b"\xff" * 1200,
        b"HTTP/1.0 200 OK\r\nX-Page-Id: 3\r\n\r\n" + png,
        b"HTTP/1.0 304 Not Modified\r\nX-Page-Id: 4\r\n",
    ]
    whole = warc.arc_file(1, "x.arc", [(f"http://h/{i}", "19990102030405", "image/png", b) for i, b in enumerate(bodies)])
    at = len(whole) // 2
    packed = gzip.compress(whole[:at]) + gzip.compress(whole[at:])
    assert list(warc.parse_arc(packed)) == list(warc.parse_arc(whole))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_arc(packed[:-20]))
    arcs = spark.createDataFrame([(bytearray(packed),)], "arc binary")
    path = str(tmp_path / "warc")
    warc.write(warc.revisits(warc.from_arc(arcs)), path, largest=warc.FILE_BYTES)  # one record a file
    got = {r.page_id: r for r in warc.read_back(spark, path).collect()}
    payloads = {1: png, 2: bodies[1].split(b"\n\n", 1)[1], 3: png, 4: b""}
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in got.items()} == {k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in payloads.items()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 3 and got[1].payload is None
    assert all(got[k].payload == payloads[k] for k in (2, 3, 4))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    records = {r.headers["X-Page-Id"]: r for f in files for r in warc.parse_warc(warc.plain(bytes(f.content)))}
    again = records["1"]
    assert again.headers["WARC-Refers-To"] == records["3"].headers["WARC-Record-ID"]
    assert again.headers["WARC-Block-Digest"] == warc.sha1(again.block) and again.block == bodies[0][: -len(png)]
