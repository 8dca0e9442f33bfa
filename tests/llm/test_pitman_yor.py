import math
import zlib
from collections import Counter

import numpy as np

from tidegate.llm import pitman_yor as py
from tidegate.llm.common import bucket_of, pack


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(1)
    for c, a, own, d in ((2, 1.5, 0.0, 0.3), (30, 5.0, 0.4, 0.5), (4000, 40.0, 0.1, 0.2), (200, 0.05, 0.0, 0.8)):
        got = py.seat(np.full(3000, c), np.full(3000, a), np.full(3000, own), d, np.arange(3000, dtype=np.uint64), 5).mean()
        want = []
        for _ in range(300):
            t = 1
            for k in range(1, c):
                t += rng.random() < (a + own * t) / (a + own * t + k - d * t)
            want.append(t)
        assert abs(got - np.mean(want)) < 4 * np.std(want) / math.sqrt(300) + 0.02 * np.mean(want)
    assert py.seat(np.array([0, 1]), np.ones(2), np.ones(2), 0.5, np.arange(2, dtype=np.uint64), 0).tolist() == [0, 1]


def test_draws():
    keys = np.arange(40_000, dtype=np.uint64)
    u = py.uniform(keys, 1, 2)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, py.uniform(keys, 1, 3))[0, 1]) < 0.02 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
    for n, p in ((3, 0.4), (50, 0.02), (1000, 0.02), (5000, 0.3)):
        x = py.binomial(np.full(len(keys), n), np.full(len(keys), p), keys, 7, n)
        assert abs(x.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / len(keys)) + 1e-9 and abs(x.var() / (n * p * (1 - p)) - 1) < 0.06 and 0 <= x.min() and x.max() <= n


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    """One part or many, few shuffle partitions or more: the same draws."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(x, 300)}" for x in rng.zipf(1.3, 60)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, h boolean")
    found = []
    for size, shuffles in ((4 << 20, "4"), (1 << 10, "3"), (1 << 11, "13")):
        monkeypatch.setattr(py, "PART_BYTES", size)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found.append({r.doc_id: r.score for r in py.score(docs, docs.h, chunk=500).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(abs(found[0][i] - f[i]) < 1e-4 for f in found[1:] for i in range(120))


def test_a_sweep_is_a_sweep_of_a_plain_sampler():
    """One dish after the other, its customers taken out of every restaurant and seated again one by one, with the same draws."""
    keys = np.array([700 << 9 | 97, 701 << 9 | 97, 702 << 9 | 98], np.uint64)
    count = np.array([9, 1, 3, 4, 0, 2, 17, 5, 1, 1, 1, 1])
    words = np.array([11, 12, 13, 14], np.uint64)
    row = {"part": 0, "kind": py.STATE, "a": pack(np.full(4, 3)), "b": pack(np.tile(np.arange(3, dtype=np.int32), 4)), "c": pack(count), "d": pack(keys), "e": pack(words)}
    p = py.Part(row, 4, 1)
    klass = [97, 97, 98]

    def draw(key, number, k):
        return float(py.uniform(np.array([key], np.uint64), number, k)[0])

    def reseat(customers, others, grow, discount, key, number):
        t = int(customers > 0)
        for k in range(1, customers):
            a = others + grow * t
            t += draw(key, number, k) * (a + k - discount * t) < a
        return t

    for number in range(3):
        t, tables = py.totals_of(p.sums()), p.by_context(p.tables)
        pairs = {(w, u): int(x) for (w, u), x in zip(((w, u) for w in range(4) for u in range(3)), p.tables, strict=True)}
        classes = {(int(w), int(c)): int(x) for w, c, x in zip(p.word, p.class_, p.class_tables, strict=True)}
        roots = [int(x) for x in p.root_tables]
        in_class = {d: sum(x for (w, u), x in pairs.items() if (w, klass[u]) == d) for d in classes}
        base = 1 / 5
        root = lambda w, out: (sum(x for (v, _), x in classes.items() if v == w) - out - py.ROOT_DISCOUNT * min(roots[w], sum(x for (v, _), x in classes.items() if v == w) - out) + (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * t["root_tables"]) * base) / (py.ROOT_STRENGTH + t["root"] - out)  # noqa: E731, B023
        new_pairs, new_classes, new_roots = {}, {}, []
        for i, ((w, u), own) in enumerate(pairs.items()):
            c = klass[u]
            served = in_class[w, c] - own
            parent = (served - py.CLASS_DISCOUNT * min(classes[w, c], served) + (py.CLASS_STRENGTH + py.CLASS_DISCOUNT * t["tables"][c]) * root(w, 0)) / (py.CLASS_STRENGTH + t["customers"][c] - own)
            new_pairs[w, u] = reseat(int(count[i]), (py.STRENGTH + py.DISCOUNT * (tables[u] - own)) * parent, py.DISCOUNT * parent, py.DISCOUNT, p.pair_key[i], 3 * number)
        for i, ((w, c), own) in enumerate(classes.items()):
            customers = sum(x for (v, u), x in new_pairs.items() if (v, klass[u]) == (w, c))
            parent = root(w, own)
            new_classes[w, c] = reseat(customers, (py.CLASS_STRENGTH + py.CLASS_DISCOUNT * (t["tables"][c] - own)) * parent, py.CLASS_DISCOUNT * parent, py.CLASS_DISCOUNT, p.class_key[i], 3 * number + 1)
        for w in range(4):
            customers = sum(x for (v, _), x in new_classes.items() if v == w)
            new_roots.append(reseat(customers, (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * (t["root_tables"] - roots[w])) * base, py.ROOT_DISCOUNT * base, py.ROOT_DISCOUNT, p.root_key[w], 3 * number + 2))
        p.sweep(t, tables, number)
        assert p.tables.tolist() == list(new_pairs.values()) and p.class_tables.tolist() == list(new_classes.values()) and p.root_tables.tolist() == new_roots


def test_counts_base_and_probabilities(spark):
    texts = ["the cat sat on the mat", "The dog sat", "", None, "a a a a b", "zebra quux", "x " * 500] * 6
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "the null", None), (7, "the dog sat", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = py.score(docs, bucket_of("doc_id", 7) == 2, chunk=50).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert py.score(docs.limit(0), bucket_of("doc_id", 7) == 2).count() == 0


def test_predictive_probabilities_sum_to_one():
    keys = np.array([700 << 9 | 97, 701 << 9 | 97, 702 << 9 | 98, py.START], np.uint64)
    count = np.array([9, 1, 0, 4, 4, 1, 1, 2, 7, 30, 2, 60, 5, 5, 0, 1, 1, 1, 3, 2])
    row = {"part": 0, "kind": py.STATE, "a": pack(np.full(5, 4)), "b": pack(np.tile(np.arange(4, dtype=np.int32), 5)), "c": pack(count), "d": pack(keys), "e": pack(np.arange(5, dtype=np.uint64))}
    p = py.Part(row, 5, 3)
    customers = p.by_context(p.count)
    assert customers.tolist() == count.reshape(5, 4).sum(0).tolist()
    for i in range(4):
        t, tables = py.totals_of(p.sums()), p.by_context(p.tables)
        assert t["tokens"] == count.sum() and t["root"] == p.class_tables.sum() and t["customers"].sum() == p.tables.sum()
        assert ((p.tables >= (p.count > 0)) & (p.tables <= p.count)).all() and (p.class_tables <= p.class_customers()).all()
        # V words and one unknown, in every restaurant
        assert abs(p.root(t).sum() + py.unseen(t) / 6 - 1) < 1e-9
        rest = {}
        for c in (97, 98, py.START):
            rest[c] = (py.CLASS_STRENGTH + py.CLASS_DISCOUNT * t["tables"][c]) * py.unseen(t) / 6 / (py.CLASS_STRENGTH + t["customers"][c])
            assert abs(p.classes(t)[p.class_ == c].sum() + rest[c] - 1) < 1e-9
        for u, c in enumerate((97, 97, 98, py.START)):
            unknown = (py.STRENGTH + py.DISCOUNT * tables[u]) * rest[c] / (py.STRENGTH + customers[u])
            assert abs(p.words(t, customers, tables)[p.context == u].sum() + unknown - 1) < 1e-9
        p.sweep(t, tables, i)


def test_scores_of_the_model_without_draws(spark):
    """Each word once: no seat is left to chance, and scores are those of a plain version of the three levels."""
    train, held = "ab cd ef gb ij kf lm", ["cd ef gb", "zz ij kf lm", "kf zz cd ab", "", "ab cd ef gb ij kf lm"]
    docs = spark.createDataFrame([(0, train, False)] + [(1 + i, t, True) for i, t in enumerate(held)], "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in py.score(docs, docs.h, chunk=4).collect()}
    follows = list(zip([b"", *tokens(train)], tokens(train), strict=False))
    v = len(follows)
    of = lambda u: u[-1] if u else py.START

    def p(u, w):
        root = ((1 - py.ROOT_DISCOUNT) * (w in tokens(train)) + (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * v) / (v + 1)) / (py.ROOT_STRENGTH + v)
        k = sum(of(x) == of(u) for x, _ in follows)
        here = any(of(x) == of(u) and y == w for x, y in follows)
        parent = ((1 - py.CLASS_DISCOUNT) * here + (py.CLASS_STRENGTH + py.CLASS_DISCOUNT * k) * root) / (py.CLASS_STRENGTH + k)
        n = sum(x == u for x, _ in follows)
        return ((1 - py.DISCOUNT) * ((u, w) in follows) + (py.STRENGTH + py.DISCOUNT * n) * parent) / (py.STRENGTH + n)

    for i, t in enumerate([train, *held]):
        assert abs(got[i] - sum(math.log10(p(u, w)) for u, w in zip([b"", *tokens(t)], tokens(t), strict=False))) < 1e-5
