"""Line dedup: an exact set-similarity join of lines, in which later matches go.

A line (of a text split at \\n) is the set of its tokens, which are shingles of five words, lower-cased A-Z (a line of
fewer words is one token). Two lines match if their words are the same in the same order, or the Jaccard similarity of
their sets is at least 0.8. A line is removed if any line before it matches, before meaning: in a row of smaller doc_id,
or earlier in the same text. So of equal lines the first stays, whatever their number. Lines without words stay.

1. Rarity: tokens are ordered by a sketch of how many lines have them (2^SKETCH counters of fixed size), ties by hash.
   The order is one and the same for all lines, which is all that exactness needs.
2. Prefixes: of n tokens, the n - ceil(0.8 n) + 1 rarest. They are written once, packed, with each line's place.
3. Tokens that two lines share are found first, by a shuffle of bare tokens; a filter of fixed size then spares all
   others. What is left is dealt into buckets by token, with place, size, position and a parity sketch of the line's set.
4. Length, positional and parity filters leave candidates; each line keeps only its best candidate among those before
   it, so a bucket of n lines makes n candidates at most. Verification computes the similarity of the sets. Lines whose
   best candidate fails get all the candidates that remain, and these are verified too.
5. The decision for each line hash: the first place where the line occurs, and whether even that goes.

Buckets are worked through in tiles, so memory stays bounded at any size. Lines are known by 64-bit hashes.

Defined results: null text stays null; empty text stays empty. Null doc_id sorts before all others. Rows that repeat
an id are ordered by their text's hash; where even their texts are the same, all of them count as one row and stay
alike. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, materialize, pack, partitions, ranges, read, unpack

SHINGLE = 5
SKETCH = 18
FILTER = (24, 29)  # sizes of filters, as powers of two: from 2 MB to 32 MB
TILE = 1024
KEEP = 8  # candidates of a line verified in the first round, the best of them first
SLICES = 8  # for each partition of a shuffle
HOT = 20_000  # rows of a token that are one block
DEALT = 16 << 20  # bytes that a task holds before it sends them
SENT = 100_000  # lines that a task remembers having sent
NO_ID = -(1 << 63)
LONG = 16  # letters of a word, words of a line, from which on XXH64 hashes it


def needed(a, b):
    """Least overlap of sets of sizes a and b that match: ceil(0.8 / 1.8 (a + b)), in whole numbers."""
    return -(-4 * (a + b) // 9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # bases of the rolling hashes, odd: they have inverses mod 2^64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64, at least n of them. Up to 2^19 are kept; longer texts make their own."""
    if len(_powers.get(base, ())) >= n:
        return _powers[base]
    x = np.full(max(n, 1 << 19), base, np.uint64)
    x[0] = 1
    x = np.multiply.accumulate(x)
    if n <= 1 << 19:
        _powers[base] = x
    return x


def spans(values: np.ndarray, base: int):
    """A function of arrays (start, end) that gives a hash of each span of values, from sums of values times powers."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return lambda start, end: mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def settle(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """hashes, with those of long spans by XXH64: sums of powers mod 2^64 are alike for some fixed pairs of a thousand values,
    whatever the base."""
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(values[start[i] : end[i]].tobytes())
    return hashes


class Lines:
    """Lines with words of some texts: row, number in the row's text, and hash of each. All by array operations."""

    def __init__(self, texts: list, base: int = 0):
        """texts: UTF-8. Lines of the texts are numbered from base."""
        joined = b"\n".join(texts).lower()
        raw = np.frombuffer(joined, np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = _SPACE[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edge[::2], edge[1::2]
        word = settle(spans(raw.astype(np.uint64) + np.uint64(1), _ODD[0])(start, end), start, end, raw)
        breaks = np.flatnonzero(raw == 10)
        bound = np.concatenate([[0], np.searchsorted(start, breaks), [len(start)]])  # words before each line
        line = np.flatnonzero(bound[1:] > bound[:-1])
        self.start, self.size = bound[line], (bound[1:] - bound[:-1])[line]
        self.span = spans(word, _ODD[1])
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.searchsorted(breaks, np.cumsum(length) - length)  # line in which each text begins
        self.row = np.searchsorted(first, line, side="right") - 1
        self.number = line - first[self.row] + base
        last = self.start + self.size
        self.hash = settle(self.span(self.start, last), self.start, last, word).view(np.int64)

    def pick(self, index: np.ndarray) -> None:
        self.start, self.size, self.row, self.number, self.hash = (x[index] for x in (self.start, self.size, self.row, self.number, self.hash))

    def tokens(self, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(line, token) of every shingle of the lines at `at`, with repeats; lines in order, from 0."""
        start, size = self.start[at], self.size[at]
        many = np.maximum(size - SHINGLE + 1, 1)
        here = ranges(start, many)
        return np.repeat(np.arange(len(many)), many), self.span(here, np.minimum(here + SHINGLE, np.repeat(start + size, many)))

    def pieces(self, most: int = 1 << 17) -> Iterator[slice]:
        """Lines in runs of some `most` words, or one: bounds what tokens() gives at once."""
        total, k = np.cumsum(self.size), 0
        while k < len(total):
            n = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + most)))
            yield slice(k, n)
            k = n


def _texts(column: pa.Array) -> list:
    """UTF-8 of each text, without a copy; null is empty."""
    if not len(column):
        return []
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    empty = column.is_null().to_pylist() if column.null_count else [False] * len(column)
    return [b"" if e else data[s:t] for s, t, e in zip(at[:-1], at[1:], empty, strict=True)]


def _lines(batches: Iterator[pa.RecordBatch], at: int, most: int = 192 << 10) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Some rows at a time: of some `most` bytes, or one, and of a longer text some lines at a time."""
    for b in batches:
        texts = _texts(b.column(at))
        k = 0
        while k < len(texts):
            n, size = k + 1, len(texts[k])
            while n < len(texts) and size + len(texts[n]) <= most:
                size += len(texts[n])
                n += 1
            part = b.slice(k, n - k)
            if size <= most:
                yield part, Lines(texts[k:n])
            else:
                data, s, number = bytes(texts[k]), 0, 0
                while s < len(data):
                    e = len(data) if s + most >= len(data) else data.rfind(b"\n", s, s + most)
                    e = e if e >= 0 else data.find(b"\n", s + most)
                    e = e if e >= 0 else len(data)
                    yield part, Lines([data[s:e]], number)
                    number += data.count(b"\n", s, e) + 1
                    s = e + 1
            k = n


def _fresh(x: Lines, sent: set) -> None:
    """Keep lines that the task has not met before; which one of equal lines is of no matter to their tokens."""
    new = [i for i, h in enumerate(x.hash.tolist()) if h not in sent and not sent.add(h)]
    x.pick(np.array(new, np.int64))
    if len(sent) > SENT:
        sent.clear()


def bits_for(n: int) -> int | None:
    """Size, as a power of two, of a filter for n numbers: 8 places a number or more; none where that is too much to broadcast."""
    return next((b for b in range(*FILTER) if 1 << b >= 8 * n), None)


def _spot(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix(x.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def spots(df: DataFrame) -> np.ndarray | None:
    """Bits of a filter that holds every number in df's columns; None (everything may be in it) where they are too many."""
    bits = bits_for(df.count() * len(df.columns))
    if bits is None:
        return None
    block = 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, bool)
        for b in batches:
            for c in b.columns:
                found[_spot(c.to_numpy(zero_copy_only=False), bits)] = True
        packed = np.packbits(found)
        for k in np.flatnonzero(packed.reshape(-1, block).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed[k * block : (k + 1) * block].tobytes()], pa.binary())], ["k", "v"])

    def either(pdf):
        import pandas as pd

        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in pdf["v"]]).tobytes()]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in map_arrow(df, run, "k int, v binary").groupBy("k").applyInPandas(either, "k int, v binary").collect():
        out[r.k * block : (r.k + 1) * block] = np.frombuffer(r.v, np.uint8)
    return out


def _set(bits: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(x), bool)
    at = _spot(x, len(bits).bit_length() + 2)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


PLACES = "line long, doc long, tie long, number int, k int, v binary"
STORE = "tokens binary, many binary, size binary, line binary, sign binary, doc binary, tie binary, number binary"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))


def _places(b: pa.RecordBatch, x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """doc and tie of each line."""
    return tuple(b.column(k).to_numpy(zero_copy_only=False)[x.row] if len(x.row) else np.empty(0, np.int64) for k in (0, 2))


def at_row(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """A hash of a row's key."""
    return mix(mix(doc.view(np.uint64)) + tie.view(np.uint64)).view(np.int64)


def places(docs: DataFrame) -> DataFrame:
    """PLACES: a row for each line (k null); and what each task counted of tokens, in blocks k of a sketch v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PLACES.split(", ")]
        total, sent, block = np.zeros(1 << SKETCH, np.int64), set(), 1 << 12
        for b, x in _lines(batches, 1):
            doc, tie = _places(b, x)
            yield pa.RecordBatch.from_arrays([pa.array(x.hash, pa.int64()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(x.number.astype(np.int32), pa.int32()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary())], names)
            _fresh(x, sent)
            for at in x.pieces():
                total += np.bincount((x.tokens(at)[1] & np.uint64((1 << SKETCH) - 1)).astype(np.int64), minlength=1 << SKETCH)
        for k in np.flatnonzero(total.reshape(-1, block).any(axis=1)).tolist():
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k], pa.int32()), pa.array([total[k * block : (k + 1) * block].astype("<i8").tobytes()], pa.binary())], names)

    return map_arrow(keyed(docs), run, PLACES)


def rarity(blocks: DataFrame) -> np.ndarray:
    """Sum of the sketches (k, v); a block has the same few bytes whatever the corpus."""

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(v, "<i8") for v in pdf["v"])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [total.astype("<i8").tobytes()]})

    out, block = np.zeros(1 << SKETCH, np.int64), 1 << 12
    for r in blocks.groupBy("k").applyInPandas(add, "k int, v binary").collect():
        out[r.k * block : (r.k + 1) * block] = np.frombuffer(r.v, "<i8")
    return out


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """STORE: packed prefixes of the distinct lines of some texts at a time."""
    # rarity in 255 steps of a logarithm: it comes first in the order of tokens
    steps = docs.sparkSession.sparkContext.broadcast(np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8))  # 2^SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sent, ready = steps.value, {}, []

        def flush():
            columns = [np.concatenate(v, axis=-1) for v in zip(*ready, strict=True)]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array([pack(v.reshape(-1))], pa.binary()) for v in columns], [c.split()[0] for c in STORE.split(", ")])

        for b, x in _lines(batches, 1):
            doc, tie = _places(b, x)
            # the first of equal lines of these texts, unless the task has sent an earlier one
            order = np.lexsort((x.number, tie, doc, x.hash))
            new = []
            for i, h, at in zip(order.tolist(), x.hash[order].tolist(), zip(doc[order].tolist(), tie[order].tolist(), x.number[order].tolist(), strict=True), strict=True):
                if h not in sent or at < sent[h]:
                    sent[h] = at
                    new.append(i)
            if len(sent) > SENT:
                sent.clear()
            if not new:
                continue
            new = np.array(new)
            x.pick(new)
            doc, tie = doc[new], tie[new]
            for at in x.pieces():
                of, token = x.tokens(at)
                # one sort by line (in a piece, less than 2^18), rarity, token; equal tokens of a line fall together
                key = (of.astype(np.uint64) << np.uint64(46)) | (seen[(token & np.uint64((1 << SKETCH) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(38)) | (token >> np.uint64(26))
                order = np.argsort(key)
                of, token = of[order], token[order]
                first = np.ones(len(of), bool)
                first[1:] = (of[1:] != of[:-1]) | (token[1:] != token[:-1])
                of, token = of[first], token[first]
                n = np.bincount(of, minlength=len(x.hash[at]))
                start = np.cumsum(n) - n
                spot = token >> np.uint64(56)
                bit = np.uint64(1) << (spot & np.uint64(63))
                sign = np.stack([np.bitwise_xor.reduceat(np.where(spot >> np.uint64(6) == k, bit, np.uint64(0)), start) for k in range(4)])
                many = n - -(-4 * n // 5) + 1  # a match of n has at least ceil(0.8 n) of its tokens
                pick = ranges(start, many)
                ready.append((token[pick], many.astype(np.int32), n.astype(np.int32), x.hash[at], sign, doc[at], tie[at], x.number[at]))
                if sum(len(r[0]) for r in ready) > 1 << 15:
                    yield flush()
        if ready:
            yield flush()

    return map_arrow(keyed(docs), run, STORE)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for row in b.to_pylist():
            yield unpack(row["tokens"], np.uint64), row


def shared_tokens(store: DataFrame) -> DataFrame:
    """token, n: those that prefixes of two different lines have, and how many rows have them.

    Tasks send tokens with 32 bits of a hash of token and line: rows of equal lines, which copies of a text make, then
    show as such, and are not dealt. Two different lines agree in these bits with a probability of 2^-32.
    """
    n = partitions(store.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for token, row in _unpacked(batches):
            line = np.repeat(unpack(row["line"], np.uint64), unpack(row["many"], np.int32))
            got.append({"to": _slice(mix(token), SLICES * n), "token": token, "mark": (mix(token ^ line) >> np.uint64(32)).astype(np.uint32)})
            if _bytes(got) > DEALT:
                yield from _dealt(got)
                got = []
        yield from _dealt(got)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, {"token": np.uint64, "mark": np.uint32}):
            order = np.argsort(rows["token"])
            token, mark = rows["token"][order], rows["mark"][order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            two = np.minimum.reduceat(mark, first) != np.maximum.reduceat(mark, first)
            count = np.diff(np.append(first, len(token)))
            yield pa.RecordBatch.from_arrays([pa.array(token[first[two]].view(np.int64)), pa.array(count[two])], ["token", "n"])

    sent = map_arrow(store.select("tokens", "many", "line"), send, "slice int, token binary, mark binary")
    return map_arrow(sent.repartition(n, "slice").sortWithinPartitions("slice"), add, "token long, n long")


def _slice(x: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each hash, from its upper half."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.int32)


def _bytes(got: list[dict]) -> int:
    return sum(v.nbytes for g in got for v in g.values())


def _dealt(got: list[dict]) -> Iterator[pa.RecordBatch]:
    """Rows, by the slice they go to (column to), packed."""
    if not got:
        return
    to = np.concatenate([g["to"] for g in got])
    order = np.argsort(to, kind="stable")
    to = to[order]
    names = [k for k in got[0] if k != "to"]
    columns = [np.concatenate([g[k] for g in got])[order] for k in names]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() if len(to) else []
    ends = [*first[1:], len(to)]
    for k in range(0, len(first), 64):
        rows = [pa.array([pack(v[s:e]) for s, e in zip(first[k : k + 64], ends[k : k + 64], strict=True)], pa.binary()) for v in columns]
        yield pa.RecordBatch.from_arrays([pa.array(to[first[k : k + 64]], pa.int32()), *rows], ["slice", *names])


def _slices(batches: Iterator[pa.RecordBatch], kinds: dict) -> Iterator[dict]:
    """Arrays of each slice: rows come in the order of slices, so one slice at a time is held."""
    now, got = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["slice"] != now and got:
                yield {k: np.concatenate([g[k] for g in got]) for k in kinds}
                got = []
            now = row["slice"]
            got.append({k: unpack(row[k], t) for k, t in kinds.items()})
    if got:
        yield {k: np.concatenate([g[k] for g in got]) for k in kinds}


ROW = {"token": np.uint64, "block": np.int32, "line": np.int64, "doc": np.int64, "tie": np.int64, "number": np.int64, "size": np.int32, "place": np.int32, "s0": np.uint64, "s1": np.uint64, "s2": np.uint64, "s3": np.uint64, "open": np.uint8}


def open_tokens(store: DataFrame, shared: np.ndarray | None, lines: np.ndarray | None) -> DataFrame:
    """token: those that open lines share."""
    sent = store.sparkSession.sparkContext.broadcast((shared, lines))  # filters of checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, still = sent.value
        for row in (r for b in batches for r in b.to_pylist()):
            line = unpack(row["line"], np.int64)
            if not _set(still, line).any():
                continue
            line, token = np.repeat(line, unpack(row["many"], np.int32)), unpack(row["tokens"], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(token[_set(still, line) & _set(shared, token)]).view(np.int64))], ["token"])

    out, _ = materialize(map_arrow(store.select("tokens", "many", "line"), run, "token long"), "open-tokens")
    return out


def deal(store: DataFrame, tokens: tuple, hot: dict[int, int], lines: np.ndarray | None) -> DataFrame:
    """Rows of the tokens that all filters have, by slices. A hot token has blocks, dealt by line; an open line then goes to all of them.

    open: 0 a row that others may match, 1 one that also looks for matches, 2 a copy that only looks.
    """
    spark = store.sparkSession
    n = partitions(spark)
    sent = spark.sparkContext.broadcast((tokens, hot, lines))  # filters of checked size, and hot tokens: SLICES for each partition at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hot, still = sent.value
        hot_tokens = np.array(sorted(hot), np.uint64)
        hot_blocks = np.array([hot[k] for k in sorted(hot)], np.int64)
        got = []
        for token, row in _unpacked(batches):
            keep = np.flatnonzero(np.logical_and.reduce([_set(w, token) for w in wanted]))
            if not len(keep):
                continue
            many = unpack(row["many"], np.int32).astype(np.int64)
            of = np.repeat(np.arange(len(many)), many)[keep]
            c = {k: unpack(row[k], t)[of] for k, t in (("line", np.int64), ("doc", np.int64), ("tie", np.int64), ("number", np.int64), ("size", np.int32))}
            c |= {"token": token[keep], "place": (keep - (np.cumsum(many) - many)[of]).astype(np.int32), "block": np.zeros(len(keep), np.int32)}
            c |= {f"s{k}": v for k, v in enumerate(unpack(row["sign"], np.uint64).reshape(4, -1)[:, of])}
            c["open"] = np.ones(len(keep), np.uint8) if still is None else _set(still, c["line"]).astype(np.uint8)
            if len(hot_tokens):
                at = np.minimum(np.searchsorted(hot_tokens, c["token"]), len(hot_tokens) - 1)
                blocks = np.where(hot_tokens[at] == c["token"], hot_blocks[at], 1)
                c["block"] = (mix(c["line"].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
                if still is not None:  # copies of open rows for the other blocks
                    more = np.where(c["open"] == 1, blocks - 1, 0)
                    at = np.repeat(np.arange(len(keep)), more)
                    copies = {k: v[at] for k, v in c.items()}
                    copies["block"] = ((copies["block"] + 1 + ranges(np.zeros(len(more), np.int64), more)) % blocks[at]).astype(np.int32)
                    copies["open"] = np.full(len(at), 2, np.uint8)
                    c = {k: np.concatenate([v, copies[k]]) for k, v in c.items()}
            to = _slice(mix(c["token"] + c["block"].astype(np.uint64) * np.uint64(_ODD[0])), SLICES * n)
            got.append({"to": to} | {k: c[k].astype(t, copy=False) for k, t in ROW.items()})
            if _bytes(got) > DEALT:
                yield from _dealt(got)
                got = []
        yield from _dealt(got)

    return map_arrow(store, run, "slice int, " + ", ".join(f"{k} binary" for k in ROW)).repartition(n, "slice").sortWithinPartitions("slice")


def overlap_bound(a, b, sa, sb):
    """Most tokens that sets of sizes a, b and parity sketches (256 bits) sa, sb can share: bits that differ are tokens that do."""
    return (a + b - sum(np.bitwise_count(x ^ y).astype(np.int64) for x, y in zip(sa, sb, strict=True))) // 2


FOUND = "line long, other long, rank long, line_at long, other_at long"


def _best(x, y, r, line, keep: int):
    """Of pairs (x looks, y is before), the best `keep` of each line that looks, each other line once; and lines that had more."""
    order = np.lexsort((y, -r, line[y], line[x]))
    x, y, r = x[order], y[order], r[order]
    once = np.concatenate([[True], (line[x][1:] != line[x][:-1]) | (line[y][1:] != line[y][:-1])]) if len(x) else np.zeros(0, bool)
    x, y, r = x[once], y[once], r[once]
    order = np.lexsort((line[y], -r, line[x]))
    x, y, r = x[order], y[order], r[order]
    first = np.flatnonzero(np.concatenate([[True], line[x][1:] != line[x][:-1]])) if len(x) else np.empty(0, np.int64)
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x[place < keep], y[place < keep], r[place < keep], np.unique(line[x[place >= keep]])


def candidates(keep: int, whole: bool, hot: frozenset):
    """Of each bucket: FOUND, pairs that pass the filters, other before line; the best `keep` of each line in a slice.

    A row without other says that the line may have more: it had more than `keep`, or was not held against all rows of a
    bucket. Unless `whole`, a line that has found `keep` candidates looks no further.
    """

    def passes(a, b, place_a, place_b, sign_a, sign_b):
        least = needed(a, b)
        ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (np.minimum(a - place_a, b - place_b) + np.minimum(place_a, place_b) >= least)
        bound = overlap_bound(a, b, sign_a, sign_b)
        return ok & (bound >= least), bound

    def work(rows: dict) -> pa.RecordBatch:
        # equal lines of several tasks: only the first is the line's place
        order = np.lexsort((rows["open"], rows["number"], rows["tie"], rows["doc"], rows["line"], rows["block"], rows["token"]))
        token, block, line = (rows[k][order] for k in ("token", "block", "line"))
        order = order[np.concatenate([[True], (token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (line[1:] != line[:-1])])]
        order = order[np.lexsort((rows["number"][order], rows["tie"][order], rows["doc"][order], rows["block"][order], rows["token"][order]))]
        c = {k: v[order] for k, v in rows.items()}
        token, block, line, size, place = c["token"], c["block"], c["line"], c["size"].astype(np.int64), c["place"].astype(np.int64)
        looks, home = c["open"] > 0, c["open"] < 2
        sign = [c[f"s{k}"] for k in range(4)]
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (block[1:] != block[:-1])]))
        count = np.diff(np.append(first, len(token)))
        out, more = [], []
        if hot and not whole:  # other blocks have not been seen
            more.append(line[np.isin(token, np.array(sorted(hot), np.uint64))])
        # buckets of up to 64: all at once, by distance in the bucket
        small = (count > 1) & (count <= 64)
        at_end = np.repeat(np.where(small, first + count, 0), count)
        for d in range(1, int(count[small].max()) if small.any() else 0):
            y = np.flatnonzero(np.arange(len(token)) + d < at_end)
            x = y + d
            ok = looks[x] & home[y]
            x, y = x[ok], y[ok]
            ok, bound = passes(size[x], size[y], place[x], place[y], [v[x] for v in sign], [v[y] for v in sign])
            out.append((x[ok], y[ok], 1000 * bound[ok] // (size[x] + size[y])[ok]))
        # others: tiles of lines that look, against tiles of those before, the earliest first
        for s, n in zip(first[count > 64].tolist(), count[count > 64].tolist(), strict=True):
            for lo in range(s, s + n, TILE):
                i = np.arange(lo, min(lo + TILE, s + n))
                i = i[looks[i]]
                has, kept = np.zeros(len(i), np.int64), []
                for lo2 in range(s, min(lo + TILE, s + n), TILE):
                    if not whole and (full := has >= keep).any():
                        more.append(line[i[full]])
                        i, has = i[~full], has[~full]
                    if not len(i):
                        break
                    j = np.arange(lo2, min(lo2 + TILE, s + n))
                    j = j[home[j]]
                    ok, bound = passes(size[i, None], size[None, j], place[i, None], place[None, j], [v[i, None] for v in sign], [v[None, j] for v in sign])
                    x, y = np.nonzero(ok & (i[:, None] > j[None, :]) & (line[i, None] != line[None, j]))
                    has += np.bincount(x, minlength=len(i))
                    kept.append((i[x], j[y], 1000 * bound[x, y] // (size[i[x]] + size[j[y]])))
                    if sum(len(k[0]) for k in kept) > 1 << 18:  # bounds what is held
                        *best, rest = _best(*map(np.concatenate, zip(*kept, strict=True)), line, keep)
                        kept = [tuple(best)]
                        more.append(rest)
                out += kept
        x, y, r = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        x, y, r, rest = _best(x, y, r, line, keep)
        rest = np.unique(np.concatenate([rest, *more]))
        at = at_row(c["doc"], c["tie"])
        columns = [np.concatenate([line[x], rest]), np.concatenate([line[y], rest]), np.concatenate([r, np.full(len(rest), -1)]), np.concatenate([at[x], rest]), np.concatenate([at[y], rest])]
        arrays = [pa.array(v, pa.int64()) for v in columns]
        return pa.RecordBatch.from_arrays(arrays, [k.split()[0] for k in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, ROW):
            yield work(rows)

    return run


def token_sets(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """h, tokens: the set of each line in pairs (line, other, and rows that have them)."""
    bits = spots(pairs.select("line", "other"))
    wanted = docs.sparkSession.sparkContext.broadcast((bits, spots(pairs.select("line_at", "other_at"))))  # two filters of checked size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, rows = wanted.value
        sent = set()

        def some():
            for b in batches:
                keep = _set(rows, at_row(*(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))))
                if keep.any():
                    yield b.filter(pa.array(keep))

        for _, x in _lines(some(), 1):
            x.pick(np.flatnonzero(_set(lines, x.hash)))
            _fresh(x, sent)
            for at in x.pieces():
                of, token = x.tokens(at)
                order = np.lexsort((token, of))
                of, token = of[order], token[order]
                first = np.ones(len(of), bool)
                first[1:] = (of[1:] != of[:-1]) | (token[1:] != token[:-1])
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=len(x.hash[at])))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.hash[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(token[first].view(np.int64)))], ["h", "tokens"])

    out = map_arrow(keyed(docs), sets, "h long, tokens array<long>")
    if bits is None:
        out = out.join(pairs.select(F.col("line").alias("h")).union(pairs.select(F.col("other").alias("h"))).distinct(), "h", "left_semi")
    # equal hashes are equal lines: any of a hash's rows will do
    return out.dropDuplicates(["h"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (line, other) those that match: (line)."""
    both = pairs.join(sets.select(F.col("h").alias("line"), F.col("tokens").alias("a")), "line").join(sets.select(F.col("h").alias("other"), F.col("tokens").alias("b")), "other")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(5 * shared >= 4 * (F.size("a") + F.size("b") - shared)).select("line").distinct()


def similar(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """line (hash): distinct lines that match another line whose first occurrence is before theirs.

    Rounds: each line has its best KEEP candidates verified, then those that had more and failed have 16 times as many,
    until no line is open. Each round is linear in the rows it deals, and the rounds end when all candidates are through.
    """
    spark = docs.sparkSession
    store, store_path = materialize(prefixes(docs, counts), "prefixes")
    shared, shared_path = materialize(shared_tokens(store), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    most = max(HOT, total // (SLICES * partitions(spark)))
    hot = {r.token % (1 << 64): -(-r.n // most) for r in shared.filter(F.col("n") > most).collect()}  # SLICES for each partition at most
    shared_bits = spots(shared.select("token"))
    wanted, still, keep, hits = (shared_bits,), None, KEEP, []
    while True:
        found, found_path = materialize(map_arrow(deal(store, wanted, hot, still), candidates(keep, still is not None, frozenset(hot)), FOUND), "candidates")
        real = found.filter("rank >= 0").groupBy("line", "other").agg(F.max("rank").alias("rank"), F.first("line_at").alias("line_at"), F.first("other_at").alias("other_at"))
        # a line has `keep` others in each of its slices at most, and no more than its prefix has tokens
        best = real.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "line_at", "other_at")), asc=False).alias("c"))
        top, top_path = materialize(best.select("line", F.posexplode(F.slice("c", 1, keep)).alias("place", "c"), (F.size("c") > keep).alias("more")).select("line", "place", "c.other", "c.line_at", "c.other_at", "more"), "top")
        sets, sets_path = materialize(token_sets(top, docs), "sets")
        hit, _ = materialize(verify(top.filter("place = 0"), sets), "similar")
        again, _ = materialize(verify(top.filter("place > 0").join(hit, "line", "left_anti"), sets), "similar")
        hit = hit.union(again)
        hits.append(hit)
        left = found.filter("rank < 0").select("line").union(top.filter("more").select("line")).distinct()
        rest, rest_path = materialize(left.join(hit, "line", "left_anti"), "open")
        done = rest.isEmpty()
        if not done:
            still, keep = spots(rest), 16 * keep
            wanted = (shared_bits, spots(open_tokens(store, shared_bits, still)))
        drop(spark, found_path, top_path, sets_path, rest_path)
        if done:
            break
    drop(spark, store_path, shared_path)
    out = hits[0]
    for more in hits[1:]:
        out = out.union(more)
    return out.distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc, tie (which row), gone (array of line numbers): the lines to remove of each row that loses any."""
    spark = docs.sparkSession
    seen, _ = materialize(places(docs), "places")
    counts = rarity(seen.filter("k is not null").select("k", "v"))
    seen = seen.filter("line is not null").select("line", "doc", "tie", "number")
    late = similar(docs, counts).withColumn("late", F.lit(True))
    # only lines that occur twice or have a match can lose anything
    first = seen.groupBy("line").agg(F.min(F.struct("doc", "tie", "number")).alias("first"), F.count("*").alias("n"))
    decided, path = materialize(first.join(late, "line", "left").filter("n > 1 or late").select("line", "first", "n", F.coalesce("late", F.lit(False)).alias("late")), "decided")
    # lines with more than a thousandth of all places: a thousand at most, broadcast; the rest meet by hash
    many = (decided.agg(F.sum("n")).first()[0] or 0) // 1000
    hot = F.broadcast(decided.filter(F.col("n") > many))
    cold = decided.filter(F.col("n") <= many)
    met = seen.join(hot, "line").union(seen.join(hot.select("line"), "line", "left_anti").join(cold, "line"))
    gone = met.filter(F.col("late") | (F.struct("doc", "tie", "number") != F.col("first")))
    return gone.groupBy("doc", "tie").agg(F.collect_set("number").alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text rewritten, and n_removed (long)."""
    gone = removals(docs)
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(docs["text"]).alias("tie"))
    joined = named.join(gone, ["doc", "tie"], "left")
    before = F.col("row.text")
    # the lines between those that go, a slice each: linear in the text, however many go
    one = F.array(F.struct(F.split(before, "\n").alias("l"), F.sort_array("gone").alias("g")))

    def between(s, i):
        first = F.when(i == 0, 0).otherwise(F.get(s["g"], i - 1) + 1)
        return F.slice(s["l"], first + 1, F.coalesce(F.get(s["g"], i), F.size(s["l"])) - first)

    kept = F.transform(one, lambda s: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["g"])), lambda i: between(s, i))), "\n"))[0]
    text = F.when(F.col("gone").isNull(), before).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.{c}") for c in docs.columns], F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))
