"""Secret scans: patterns over whole texts, and over what is encoded in them, layer by layer, by a worklist.

A text's first layer is itself. A layer gives further ones: its percent escapes decoded, its Unicode escapes decoded, each
base64 run that holds a text, and each that holds compressed bytes, unpacked. Every layer that was not seen before (its
digest, and the place that it came from) is scanned and opened in turn, until nothing new comes: layers that lead to
themselves end there. Escapes of escapes (%2525.., \\u005cu005c..) are decoded in one step, so that depth costs no passes.
Each layer knows where its characters come from, and a match is reported at the span of the document that it was decoded
from: escapes and base64 to the characters, compressed bytes as a whole.

A layer of more than LAYER characters or unpacked bytes is not opened, but counted in n_refused; the text itself is always
scanned, whatever its length. Documents are read one at a time.

Defined results: null and empty texts have no spans: counts 0, the digest of an empty text, spans ''. Repeated rows give
repeated rows. Spans are in code points, the end exclusive, each once. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, read

LAYER = 1 << 26
KINDS = ("assign", "access", "hex")
# The patterns. Lengths are tested on what a pattern has taken, which for runs is the same as in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

Span = tuple[int, int, int]  # start, number of the kind, end


def scan(text: str) -> list[Span]:
    """Matches of a text, leftmost and not overlapping within a kind, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text, or bytes of which it is not yet known what they are, and the way back to the document."""

    def __init__(self, data: str | bytes, back: Callable[[int, int], tuple[int, int]]):
        self.data, self.back = data, back

    def key(self) -> tuple[bytes, tuple[int, int]]:
        raw = self.data if isinstance(self.data, bytes) else self.data.encode("utf-8", "surrogatepass")
        return hashlib.sha256(raw).digest(), self.back(0, len(self.data))


class Rewritten:
    """A text put together from pieces of another: plain ones, and escapes that became a character each."""

    def __init__(self, source: str):
        self.source, self.out = source, []
        self.at, self.pieces, self.size, self.done = [], [], 0, 0  # where each piece begins; (from, to, whether plain)

    def _add(self, text: str, start: int, end: int, plain: bool) -> None:
        if text:
            self.at.append(self.size)
            self.pieces.append((start, end, plain))
            self.out.append(text)
            self.size += len(text)

    def escape(self, start: int, end: int, char: str) -> None:
        self._add(self.source[self.done : start], self.done, start, True)
        self._add(char, start, end, False)
        self.done = end

    def layer(self, back: Callable[[int, int], tuple[int, int]]) -> Layer:
        self._add(self.source[self.done :], self.done, len(self.source), True)
        at, pieces = self.at, self.pieces

        def local(a: int, b: int) -> tuple[int, int]:
            i, j = bisect.bisect_right(at, a) - 1, bisect.bisect_right(at, max(a, b - 1)) - 1
            start = pieces[i][0] + (a - at[i] if pieces[i][2] else 0)
            end = pieces[j][0] + (b - at[j]) if pieces[j][2] else pieces[j][1]
            return back(start, end)

        return Layer("".join(self.out), local)


_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"\\(?:u005[cC])*(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&(?:#38;|amp;)*#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")


def unpercent(layer: Layer) -> Layer | None:
    """Percent escapes as the UTF-8 that they spell; bytes that spell none stay as they are written."""
    text, out, run = layer.data, Rewritten(layer.data), []

    def close():
        i = 0
        while i < len(run):
            byte = run[i][2]
            n = 1 if byte < 0x80 else 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
            try:
                char = bytes(x[2] for x in run[i : i + n]).decode() if n and i + n <= len(run) else ""
            except UnicodeDecodeError:
                char = ""
            if char:
                out.escape(run[i][0], run[i + n - 1][1], char)
            i += n if char else 1
        run.clear()

    for m in _PERCENT.finditer(text):
        if run and run[-1][1] != m.start():
            close()
        run.append((m.start(), m.end(), int(m[1], 16)))
    close()
    return out.layer(layer.back) if out.pieces else None


def unescape(layer: Layer) -> Layer | None:
    """\\uXXXX (two surrogates as one character), \\u{X}, \\UXXXXXXXX, \\xXX, &#D; and &#xX; as their characters."""
    out, high = Rewritten(layer.data), None  # a first surrogate that waits for the second
    for m in _UNICODE.finditer(layer.data):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if high and high[1] == m.start() and 0xDC00 <= code < 0xE000:
            out.escape(high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00))
            high = None
            continue
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if not 0xD800 <= code < 0xE000 and code <= 0x10FFFF:
            out.escape(m.start(), m.end(), chr(code))
    return out.layer(layer.back) if out.pieces else None


_RUNS = (
    re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"),
    re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"),
    re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}"),
)
_URL_SAFE = str.maketrans("-_", "+/")
_TEXT = re.compile(r"[\t\n\r\x20-\x7e\x80-\U0010ffff]{6,}")


def unbase64(layer: Layer) -> Iterator[Layer]:
    """What base64 runs hold, where it is text or compressed. Letters before a run may seem to be of it: four beginnings are tried."""
    seen = set()
    for pattern in _RUNS:
        for m in pattern.finditer(layer.data):
            if m.span() in seen:
                continue
            seen.add(m.span())
            places = [i for i in range(*m.span()) if layer.data[i] not in "=\r\n"] if "\n" in m[0] else None
            body = re.sub(r"[=\r\n]", "", m[0]).translate(_URL_SAFE)
            for skip in range(4):
                rest = body[skip:]
                rest = rest[: len(rest) - 1] if len(rest) % 4 == 1 else rest
                if len(rest) < 8:
                    break
                try:
                    data = base64.b64decode(rest + "=" * (-len(rest) % 4))
                except (binascii.Error, ValueError):
                    continue
                packed = compression(data) is not None
                try:
                    held = data if packed else data.decode()
                except UnicodeDecodeError:
                    continue
                if packed or _TEXT.fullmatch(held):
                    yield Layer(held, _from_base64(layer.back, m.start() + skip, len(rest), places[skip:] if places else None, held))
                    break


def _from_base64(back, start: int, length: int, places: list[int] | None, held: str | bytes) -> Callable[[int, int], tuple[int, int]]:
    def local(a: int, b: int) -> tuple[int, int]:
        if isinstance(held, str) and not held.isascii():
            a, b = len(held[:a].encode()), len(held[:b].encode())
        first, last = a // 3 * 4, min(length, -(-b // 3) * 4)
        return back(places[first], places[last - 1] + 1) if places else back(start + first, start + last)

    return local


def compression(data: bytes) -> Callable | None:
    """What unpacks these bytes, by how they begin."""
    if data[:3] == b"\x1f\x8b\x08":
        return lambda: zlib.decompressobj(31)
    if len(data) > 6 and data[0] & 0x8F == 8 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


class TooLarge(Exception):
    pass


def unpack(layer: Layer) -> Layer | None:
    """Compressed bytes unpacked, as bytes if these are compressed again, else as text. All of it maps to all of the bytes."""
    try:
        data = compression(layer.data)().decompress(layer.data, LAYER + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    if len(data) > LAYER:
        raise TooLarge
    whole = layer.back(0, len(layer.data))
    return Layer(data if compression(data) else data.decode("utf-8", "replace"), lambda a, b: whole) if data else None


def layers(text: str) -> Iterator[Layer | None]:
    """Every layer of a text once, itself first; None for one that is too large to be opened."""
    work, seen = deque([Layer(text, lambda a, b: (a, b))]), set()
    first = True
    while work:
        layer = work.popleft()
        if not first:
            key = layer.key()
            if key in seen:
                continue
            seen.add(key)
        if isinstance(layer.data, bytes):
            try:
                inner = unpack(layer)
            except TooLarge:
                yield None
                continue
            if inner:
                work.append(inner)
            continue
        yield layer
        if not first and len(layer.data) > LAYER:
            yield None
            continue
        first = False
        if "%" in layer.data and (found := unpercent(layer)):
            work.append(found)
        if ("\\" in layer.data or "&" in layer.data) and (found := unescape(layer)):
            work.append(found)
        work.extend(unbase64(layer))


def report(text: str | None) -> tuple[list[Span], list[Span], int, int]:
    """Spans of the text itself; all spans; layers that were opened beyond the text; layers that were refused."""
    own, all_spans, opened, refused = [], set(), -1, 0
    for layer in layers(text or ""):
        if layer is None:
            refused += 1
            continue
        opened += 1
        found = scan(layer.data)
        if not opened:
            own = found
        for a, kind, b in found:
            start, end = layer.back(a, b)
            all_spans.add((start, kind, end))
    return own, sorted(all_spans), opened, refused


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans and all_spans (kind, start, end), n_layers, n_refused of each row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda spans: [(KINDS[k], a, b) for a, k, b in spans]
        for b in batches:
            for j in range(0, b.num_rows, 256):
                part = b.slice(j, 256)
                found = [report(t.as_py()) for t in part.column("text")]
                own, every, opened, refused = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array([[dict(zip(("kind", "start", "end"), r, strict=True)) for r in as_rows(s)] for s in spans], kind) for spans in (own, every)], pa.array(opened, pa.int64()), pa.array(refused, pa.int64())],
                    names=["doc_id", "spans", "all_spans", "n_layers", "n_refused"],
                )

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {span}, all_spans {span}, n_layers long, n_refused long")


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    text = lambda column: f"array_join(transform({column}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS],
        f"sha2({text('spans')}, 256) AS base_sha256",
        f"{text('all_spans')} AS spans",
        "n_layers",
        "n_refused",
    )
