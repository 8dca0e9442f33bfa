import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegate.llm import search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return [x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def slow(docs, items, k=10):
    tokens = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in tokens), sum(len(w) for _, w in tokens)
    df = Counter(x for _, w in tokens for x in set(w))
    merged = {}
    for i, t in items:
        merged.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in merged.items():
        found = []
        for d, w in tokens:
            tf, m = Counter(w), 10 + 90 * len(w) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(heapq.nsmallest(k, found, key=lambda x: x[:3]), 1)]
    return out


def tables(seed=1):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "été", "x_y", "A1", "b-c", "日本", "key", "zz", "q"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[200] + [5] * (len(vocabulary) - 1), k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 60]))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(200, 230)] + [(300, None), (301, ""), (302, "--"), (None, docs[7][1]), (None, "w1"), (7, docs[7][1]), (303, "q " * 5000 + "\x00w1\x7fw2")]
    items = [(i, text(rng.choice([1, 4, 12, 30]))) for i in range(30)] + [(40, None), (41, "!"), (42, "nowhere"), (3, "w5 w6"), (None, "zz"), (43, "the"), (44, "été 日本")]
    return docs, items


def key(r):
    return tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("pairs", [search.RANGE_PAIRS, 40])
def test_against_brute_force(spark, pairs):
    """In one range of items and in many; copies that tie, more of them than places."""
    docs, items = tables()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, terms string").repartition(5)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, term string")
    out = search.rank(d, b, range_pairs=pairs)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(slow(docs, items), key=key)


def test_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search.rank(d.limit(0), b).count() == 0 and search.rank(d, b.limit(0)).count() == 0
    assert search.rank(d.filter("text = ''"), b).count() == 0


def test_blocks_and_pieces(monkeypatch):
    data = ("Word one-two été " * 1000).encode()
    assert [w for p in search.pieces(data, 50) for w in p] == [w for p in search.pieces(data) for w in p] == [t.encode() for t in terms(data.decode())]
    assert [w for p in search.pieces(b"x" * 1000, 10) for w in p] == [b"x" * 1000]
    rng = np.random.default_rng(0)
    items, docs, x = rng.integers(0, 70_000, 5000), rng.integers(0, 3, 5000), rng.integers(0, 9, 5000)
    want = Counter()
    for i, d, v in zip(items, docs, x, strict=True):
        want[int(i), int(d)] += int(v)
    got = search.sums(items, docs, x)
    assert {(int(i), int(d)): int(v) for i, d, v in zip(*got, strict=True)} == want
    keys = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    assert (keys[search.radix_order(keys)] == np.sort(keys)).all()


def test_length_norm_of_any_size():
    assert search.length_norm(10**9, 10**12, 10**15) == 10 + 90 * 10**6
