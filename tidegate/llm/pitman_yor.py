"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants, from the top: the root serves words over the uniform base distribution 1 / (V + 1); below it, sharing it as
parent, one restaurant for each class of the token before (its last byte; one more class for the start of a text); below
these, sharing their class as parent, one restaurant for each word that stands before another. The words' restaurants
grow with the corpus. Gibbs sweeps take the customers of a word out of a restaurant, with their tables and what these are
in its parents, and seat them again, given all others, by the Chinese-restaurant rule, from the bottom up: a table of a
restaurant is a customer of its parent. Seats are kept from sweep to sweep. Predictive probabilities are averaged over the
sweeps after the burn-in. All words of a sweep are seated given the totals of the sweep before, so that they are in no order.

What one word does in all restaurants (customers and tables by context, by class and in the root) lies in the part of its
hash, so that a sweep is local to words but for the totals of restaurants: those of classes and root are 516 numbers, and
those of words' restaurants are summed in the parts of the contexts' hashes, and come back to the words' parts, each sweep.

Data flow, with counts gathered over all training texts:
  chunks   texts are numbered in tasks: a chunk of some `chunk` tokens keeps its tokens as indexes of its distinct
           (word, context) pairs; these pairs, with counts, go to the word's part
  state    each part merges its pairs; of a chunk's pairs it keeps their places among the merged ones
  routes   each part of contexts numbers its contexts, and knows the places that each part of words asked for
  sweeps   parts are seated from where the last sweep left them, their tables summed by context; a draw is a hash of word,
           context, sweep and customer, so that neither a lost executor nor the number of parts changes anything
  answers  each part answers each chunk's pairs with probabilities and counts, which meet the chunk's tokens again
Parts are as many as the texts need, since each part of words exchanges a row with each part of contexts.
Words are known by their 64-bit hash; as contexts, by 39 bits of it and their class: of 10^9 words in contexts, less than
one in 10,000 would share its restaurant with another.

Seating is drawn customer by customer up to STEP customers of a word in a restaurant; beyond, in blocks of a tenth of
the customers already there, with a binomial number of new tables (the chance of a new table hardly changes within), by
inversion up to a mean of 30 and from a normal distribution beyond.

Defined results: null text counts as empty; an empty text is the one token end. Null doc_id is hashed as the empty text.
Repeated rows are scored, and learned from, once each. Without training rows N and V are 0 and every probability is
that of the base distribution. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, bucket_of, drop, map_arrow, materialize, pack, partitions, read, unpack
from .lines import mix

CHUNK = 1_500_000
PART_BYTES = 4 << 20  # of text, for each part; there are three parts for each shuffle partition at most
CLASSES = 257
START = 256
STEP = 48
DISCOUNT, STRENGTH = 0.8, 20.0  # of words as contexts
CLASS_DISCOUNT, CLASS_STRENGTH = 0.2, 200.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 20.0
SWEEPS, BURN_IN = 4, 1
BLOBS = "part int, chunk long, a binary, b binary, c binary, d binary, e binary, kind int"
#: Kinds of rows; those of sweep i are REPLY + i, and SEATS + i.
OWN, ASKED, STATE, ROUTE, REPLY, SEATS = 0, 1, 2, 3, 4, 100


def _batch(rows: list[tuple], kind: int) -> pa.RecordBatch:
    cols = [*zip(*rows, strict=True), [kind] * len(rows)]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "chunk", "a", "b", "c", "d", "e", "kind"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each part of a partition. They stay packed until their part's turn."""
    got: dict[int, list[dict]] = {}
    for b in batches:
        for row in b.to_pylist():
            got.setdefault(row["part"], []).append(row)
    for part in sorted(got):
        yield part, got.pop(part)


def context_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(9)) % np.uint64(parts)).astype(np.int64)


def slices(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of a sorted array."""
    edge = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else of
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(of[s]), s, e


class Chunk:
    """Texts of a task, as numbers."""

    def __init__(self):
        self.words = Vocabulary()
        self.words.encode([b""])  # the end token; as a context, the start
        self.tokens: list[np.ndarray] = []
        self.ids, self.held, self.size = [], [], []
        self.n = 0

    def add(self, doc_id, text, held) -> None:
        w = self.words.encode((text or "").encode("utf-8", "replace").lower().split())
        self.tokens.append(np.append(w, 0))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size.append(len(w) + 1)
        self.n += len(w) + 1

    def rows(self, number: int, parts: int) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known = np.array([xxh64_intdigest(w, 42) for w in self.words.words], np.uint64)
        last = np.array([w[-1] if w else START for w in self.words.words], np.uint64)
        keys, context = np.unique(known >> np.uint64(25) << np.uint64(9) | last, return_inverse=True)
        # pairs in the order of (part, word, part of the context, context)
        order = np.lexsort((keys, context_part(keys, parts)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys, context = keys[order], place[context]
        part = (known % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((known, part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        token = np.concatenate(self.tokens)
        before = np.empty(len(token), np.int64)
        before[1:], before[0] = token[:-1], 0
        trained = np.repeat(~np.array(self.held, bool), self.size)
        pair, index = np.unique(place[token] * len(keys) + context[before], return_inverse=True)
        count = np.bincount(index[trained], minlength=len(pair))
        word, context = order[pair // len(keys)], pair % len(keys)
        null = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        # the order of a text's tokens counts no more: sorted, their differences are small
        size = np.array(self.size, np.int64)
        ordered = np.sort(np.repeat(np.arange(len(size)), size) * len(pair) + index)
        step = np.diff(ordered, prepend=0)
        yield _batch([(-1 - number % parts, number, pack(step), b"", pack(ids), np.stack([null, np.array(self.held, bool)]).astype(np.uint8).tobytes(), pack(size))], OWN)
        for of, s, e in slices(part[word]):
            w = known[word[s:e]]
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            yield _batch([(of, number, pack(w[starts]), pack(np.diff(np.append(starts, e - s))), pack(keys[context[s:e]]), pack(count[s:e].astype(np.int64)), b"")], ASKED)


def _chunks(parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, now = TaskContext.get().partitionId() << 24, 0, Chunk()
        for b in batches:
            for i, t, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                now.add(i.as_py(), t.as_py(), h.as_py())
                if now.n >= size:
                    yield from now.rows(base + k, parts)
                    k, now = k + 1, Chunk()
        if now.n:
            yield from now.rows(base + k, parts)

    return run


def _merge(parts: int):
    """State of each part: its words and contexts, the pairs of both, their training counts; and each chunk's places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            if part < 0:
                yield from (_batch([(part, r["chunk"], r["a"], r["b"], r["c"], r["d"], r["e"])], OWN) for r in rows)
                continue
            words, w = np.unique(np.concatenate([np.repeat(unpack(r["a"], np.uint64), unpack(r["b"], np.int64)) for r in rows]), return_inverse=True)
            got = [unpack(r["c"], np.uint64) for r in rows]
            keys, u = np.unique(np.concatenate(got), return_inverse=True)
            order = np.lexsort((keys, context_part(keys, parts)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pair, at = np.unique(w * len(keys) + place[u], return_inverse=True)
            n = np.bincount(at, np.concatenate([unpack(r["d"], np.int64) for r in rows]), len(pair)).astype(np.int64)
            known = len(np.unique((pair // len(keys))[n > 0]))
            yield _batch([(part, known, pack(np.bincount(pair // len(keys), minlength=len(words)).astype(np.int64)), pack((pair % len(keys)).astype(np.int32)), pack(n), pack(keys[order]), pack(words))], STATE)
            end = np.cumsum([len(x) for x in got])
            for r, x, e in zip(rows, got, end.tolist(), strict=True):
                yield _batch([(part, r["chunk"], pack(np.diff(at[e - len(x) : e], prepend=0)), b"", b"", b"", b"")], ASKED)

    return run


def uniform(keys: np.ndarray, *at: int) -> np.ndarray:
    """A number from 0 to 1 for each key, and place in the course of draws."""
    for n in at:
        keys = mix(keys + np.uint64((n * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    return (keys >> np.uint64(11)).astype(np.float64) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, *at: int) -> np.ndarray:
    u, mean = uniform(keys, *at, 1), n * p
    out = np.zeros(len(n), np.int64)
    wide = mean > 30
    if wide.any():
        z = np.sqrt(-2 * np.log(1 - u[wide])) * np.cos(2 * np.pi * uniform(keys[wide], *at, 2))
        out[wide] = np.clip(np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - p[wide]))), 0, n[wide])
    live = np.flatnonzero(~wide)
    chance = (1 - p[live]) ** n[live]
    below, x = chance.copy(), 0
    while len(live):
        more = (u[live] > below) & (x < n[live])
        live, chance, below = live[more], chance[more], below[more]
        chance *= (n[live] - x) / (x + 1) * p[live] / (1 - p[live])
        x += 1
        out[live] = x
        below = below + chance
        if x > 200:  # what is left of u is rounding
            break
    return out


def seat(customers: np.ndarray, pull: np.ndarray, own: np.ndarray, discount: float, keys: np.ndarray, number: int) -> np.ndarray:
    """Tables drawn for each dish: the customer after k, at t tables, opens one with a / (a + k - discount t), a = pull + own t.

    pull is what others' tables do for a new one, own what each of the dish's own adds to it."""
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    k = 1
    while len(live) and k < STEP:
        t = tables[live]
        a = pull[live] + own[live] * t
        tables[live] = t + (uniform(keys[live], number, k) * (a + k - discount * t) < a)
        k += 1
        live = live[customers[live] > k]
    while len(live):
        block = np.minimum(max(1, k // 10), customers[live] - k)
        t, middle = tables[live], k + block / 2
        a = pull[live] + own[live] * t
        tables[live] = t + binomial(block, a / (a + middle - discount * t), keys[live], number, k)
        k += max(1, k // 10)
        live = live[customers[live] > k]
    return tables


class Part:
    """Words of a part, seated."""

    def __init__(self, row: dict, n_words: int, parts: int):
        self.part, self.parts = row["part"], parts
        contexts = unpack(row["a"], np.int64)
        self.n_here = len(contexts)
        self.of = np.repeat(np.arange(self.n_here), contexts)
        self.context = unpack(row["b"], np.int32).astype(np.int64)
        self.count = unpack(row["c"], np.int64)
        self.keys = unpack(row["d"], np.uint64)
        words = unpack(row["e"], np.uint64)
        self.base = 1.0 / (n_words + 1)
        # a word in a class
        dish, self.dish = np.unique(self.of * CLASSES + (self.keys[self.context] & np.uint64(511)).astype(np.int64), return_inverse=True)
        self.word, self.class_ = dish // CLASSES, dish % CLASSES
        # what draws are made of: the same whatever part a word is in
        self.root_key = mix(words)
        self.class_key = mix(self.root_key[self.word] + self.class_.astype(np.uint64))
        self.pair_key = mix(self.root_key[self.of] ^ mix(self.keys)[self.context])
        # one table for each dish, to begin with
        self.tables = (self.count > 0).astype(np.int64)
        self.class_tables = (self.class_customers() > 0).astype(np.int64)
        self.root_tables = (self.root_customers() > 0).astype(np.int64)

    def class_customers(self) -> np.ndarray:
        return np.bincount(self.dish, self.tables, len(self.word)).astype(np.int64)

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.word, self.class_tables, self.n_here).astype(np.int64)

    def root(self, totals: dict) -> np.ndarray:
        return (self.root_customers() - ROOT_DISCOUNT * self.root_tables) / (ROOT_STRENGTH + totals["root"]) + unseen(totals) * self.base

    def classes(self, totals: dict) -> np.ndarray:
        """Probability of each word in each class it occurs in."""
        new = (CLASS_STRENGTH + CLASS_DISCOUNT * totals["tables"][self.class_]) * self.root(totals)[self.word]
        return (self.class_customers() - CLASS_DISCOUNT * self.class_tables + new) / (CLASS_STRENGTH + totals["customers"][self.class_])

    def words(self, totals: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of each pair; customers and tables are totals of the contexts."""
        new = (STRENGTH + DISCOUNT * tables[self.context]) * self.classes(totals)[self.dish]
        return (self.count - DISCOUNT * self.tables + new) / (STRENGTH + customers[self.context])

    def sweep(self, totals: dict, tables: np.ndarray, number: int) -> None:
        """Seat every dish anew, given all others: its own tables, and what they are in the parents, are taken out of the totals."""
        # a word in a context, its class without what the word's tables in the context are there
        served = self.class_customers()[self.dish] - self.tables
        own_root = self.root(totals)[self.word][self.dish]
        parent = served - CLASS_DISCOUNT * np.minimum(self.class_tables[self.dish], served) + (CLASS_STRENGTH + CLASS_DISCOUNT * totals["tables"][self.class_[self.dish]]) * own_root
        parent = parent / (CLASS_STRENGTH + totals["customers"][self.class_[self.dish]] - self.tables)
        seats = seat(self.count, (STRENGTH + DISCOUNT * (tables[self.context] - self.tables)) * parent, DISCOUNT * parent, DISCOUNT, self.pair_key, 3 * number)
        # a word in a class, the root without what the word's tables in the class are there
        served = self.root_customers()[self.word] - self.class_tables
        parent = served - ROOT_DISCOUNT * np.minimum(self.root_tables[self.word], served) + (ROOT_STRENGTH + ROOT_DISCOUNT * totals["root_tables"]) * self.base
        parent = parent / (ROOT_STRENGTH + totals["root"] - self.class_tables)
        self.tables = seats
        class_seats = seat(self.class_customers(), (CLASS_STRENGTH + CLASS_DISCOUNT * (totals["tables"][self.class_] - self.class_tables)) * parent, CLASS_DISCOUNT * parent, CLASS_DISCOUNT, self.class_key, 3 * number + 1)
        self.class_tables = class_seats
        # a word in the root
        others = (ROOT_STRENGTH + ROOT_DISCOUNT * (totals["root_tables"] - self.root_tables)) * self.base
        self.root_tables = seat(self.root_customers(), others, np.full(self.n_here, ROOT_DISCOUNT * self.base), ROOT_DISCOUNT, self.root_key, 3 * number + 2)

    def seats(self) -> tuple[bytes, bytes, bytes]:
        return tuple(pack(x.astype(np.int32)) for x in (self.tables, self.class_tables, self.root_tables))

    def sit(self, rows: list[dict], number: int) -> None:
        """The seats that a sweep left."""
        row = next(r for r in rows if r["kind"] == SEATS + number)
        self.tables, self.class_tables, self.root_tables = (unpack(row[c], np.int32).astype(np.int64) for c in "abc")

    def sums(self) -> np.ndarray:
        """By class: customers and tables; then the root's customers and tables, and the tokens of all words."""
        own = [self.class_tables.sum(), self.root_tables.sum(), self.count.sum()]
        return np.concatenate([np.bincount(self.class_, self.class_customers(), CLASSES), np.bincount(self.class_, self.class_tables, CLASSES), own]).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.keys)).astype(np.int64)


def unseen(totals: dict) -> float:
    """What the root leaves to the base distribution."""
    return (ROOT_STRENGTH + ROOT_DISCOUNT * totals["root_tables"]) / (ROOT_STRENGTH + totals["root"])


def totals_of(sums: np.ndarray) -> dict:
    return {"customers": sums[:CLASSES], "tables": sums[CLASSES : 2 * CLASSES], "root": int(sums[-3]), "root_tables": int(sums[-2]), "tokens": int(sums[-1])}


def _replies(rows: list[dict], number: int, column: str) -> np.ndarray:
    """Totals of a part's contexts at a sweep: the parts of contexts answer in their order, which is that of the state's keys."""
    got = sorted((r["chunk"], r[column]) for r in rows if r["kind"] == REPLY + number)
    return np.concatenate([unpack(x, np.int64) for _, x in got]) if got else np.empty(0, np.int64)


def _ask(parts: int):
    """The contexts of each part of words, for the parts of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            for row in rows:
                keys = unpack(row["d"], np.uint64)
                for of, s, e in slices(context_part(keys, parts)):
                    yield _batch([(of, part, pack(keys[s:e]), b"", b"", b"", b"")], ROUTE)

    return run


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a part as numbers: for each part of words, those that it has."""
    for part, rows in _by_part(batches):
        got = [unpack(r["a"], np.uint64) for r in rows]
        at = np.unique(np.concatenate(got), return_inverse=True)[1].astype(np.int32)
        for r, x, e in zip(rows, got, np.cumsum([len(x) for x in got]).tolist(), strict=True):
            yield _batch([(part, r["chunk"], pack(at[e - len(x) : e]), b"", b"", b"", b"")], ROUTE)


def _send(n_words: int, parts: int, past: list[dict]):
    """One sweep more: seats, and tables of each context (before any sweep, customers too) for the parts of contexts; sums as part -1."""
    now = len(past)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CLASSES + 3, np.int64)
        for part, rows in _by_part(batches):
            p = Part(next(r for r in rows if r["kind"] == STATE), n_words, parts)
            if past:
                p.sit(rows, now - 1)
                p.sweep(past[-1], _replies(rows, now - 1, "a"), now - 1)
            total += p.sums()
            yield _batch([(part, -1, *p.seats(), b"", b"")], SEATS + now)
            tables, customers = p.by_context(p.tables), p.by_context(p.count)
            for of, s, e in slices(context_part(p.keys, parts)):
                yield _batch([(of, part, pack(tables[s:e]), b"" if past else pack(customers[s:e]), b"", b"", b"")], REPLY + now)
        yield _batch([(-1, -1, pack(total), b"", b"", b"", b"")], REPLY + now)

    return run


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of contexts, for each part of words that has them. Seats pass through."""
    for part, rows in _by_part(batches):
        if part < 0:
            yield _batch([(-1, -1, pack(sum(unpack(r["a"], np.int64) for r in rows)), b"", b"", b"", b"")], rows[0]["kind"])
            continue
        for r in rows:
            if r["kind"] >= SEATS:
                yield _batch([(part, -1, r["a"], r["b"], r["c"], b"", b"")], r["kind"])
        at = {r["chunk"]: unpack(r["a"], np.int32) for r in rows if r["kind"] == ROUTE}
        sent = [r for r in rows if REPLY <= r["kind"] < SEATS]
        if not sent:
            continue
        n = 1 + max(int(x.max()) for x in at.values())
        total = {}
        for column in "ab"[: 2 if sent[0]["b"] else 1]:
            total[column] = np.zeros(n, np.int64)
            for r in sent:
                total[column][at[r["chunk"]]] += unpack(r[column], np.int64)  # a part has a context once
        for of, x in at.items():
            yield _batch([(of, part, pack(total["a"][x]), pack(total["b"][x]) if "b" in total else b"", b"", b"", b"")], sent[0]["kind"])


def _answers(n_words: int, parts: int, past: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            customers = _replies(rows, 0, "b")
            p = Part(next(r for r in rows if r["kind"] == STATE), n_words, parts)
            mean = 0.0
            for i in range(BURN_IN + 1, len(past)):
                p.sit(rows, i)
                mean = mean + p.words(past[i], customers, _replies(rows, i, "a"))
            log = np.log10(mean / (len(past) - BURN_IN - 1)).astype(np.float32)
            count = np.bincount(p.of, p.count, p.n_here).astype(np.int64)[p.of]
            for r in rows:
                if r["kind"] == ASKED:
                    at = np.cumsum(unpack(r["a"], np.int64))
                    yield _batch([(part, r["chunk"], pack(log[at]), pack(count[at]), b"", b"", b"")], ASKED)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(n_tokens: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, dict[int, tuple]] = {}
        for b in batches:
            for row in b.to_pylist():
                got.setdefault(row["chunk"], {})[-1 if row["kind"] == OWN else row["part"]] = row
        for rows in got.values():
            own = rows.pop(-1)
            log = np.concatenate([unpack(rows[p]["a"], np.float32) for p in sorted(rows)]).astype(np.float64)
            count = np.concatenate([unpack(rows[p]["b"], np.int64) for p in sorted(rows)])
            base = np.log10((count + 1) / (n_tokens + n_words + 1))
            size = unpack(own["e"], np.int64)
            start = np.cumsum(size) - size
            at = np.cumsum(unpack(own["a"], np.int64)) - np.repeat(np.arange(len(size)), size) * len(log)
            null, held = np.frombuffer(own["d"], np.uint8).reshape(2, -1).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unpack(own["c"], np.int64), mask=null),
                    pa.array(held),
                    pa.array(size),
                    pa.array(np.add.reduceat((count > 0)[at].astype(np.int64), start)),
                    pa.array(np.full(len(size), n_tokens)),
                    pa.array(np.add.reduceat(base[at], start)),
                    pa.array(np.add.reduceat(log[at], start)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held_out, chunk: int = CHUNK) -> DataFrame:
    """RESULT for each row of docs, learning from those for which the column held_out is false."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(3 * partitions(spark), size // PART_BYTES))

    def parted(df: DataFrame, run) -> DataFrame:
        return map_arrow(df.repartition("part"), run, BLOBS)

    chunks = map_arrow(docs.select("doc_id", "text", held_out.alias("held")), _chunks(parts, chunk), BLOBS)
    table, path = materialize(parted(chunks, _merge(parts)), "seats", "kind")
    own, asked, state = (table.filter(F.col("kind") == k) for k in (OWN, ASKED, STATE))
    n_words = state.select(F.sum("chunk")).first()[0] or 0  # each part tells the number of its words
    routes, routes_path = materialize(parted(map_arrow(state, _ask(parts), BLOBS), _route), "routes")
    past, before, after, paths = [], state, state, []
    for i in range(SWEEPS + 1):
        replies, at = materialize(parted(parted(before, _send(n_words, parts, past)).unionByName(routes), _reply), "totals")
        sums = replies.filter("part < 0").select("a").first()
        past.append(totals_of(unpack(bytes(sums.a), np.int64) if sums else np.zeros(2 * CLASSES + 3, np.int64)))
        given = replies.filter("part >= 0")
        before = state.unionByName(given)
        if i > BURN_IN or not i:
            after = after.unionByName(given)
        paths.append(at)
    answers, _ = materialize(parted(after.unionByName(asked), _answers(n_words, parts, past)), "answers")
    drop(spark, routes_path, *paths, f"{path}/kind={ASKED}", f"{path}/kind={STATE}")
    return map_arrow(answers.unionByName(own).repartition("chunk"), _scores(past[0]["tokens"], n_words), RESULT)


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), bucket_of("doc_id", 7) == 2)
