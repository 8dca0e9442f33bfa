import itertools
import random

import xxhash
from pyspark.sql import functions as F

from tidegate.llm import simhash


def slow_print(text):
    w = [x for x in (text or "").encode().lower().split()]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(x, 42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_groups(rows):
    prints = [(d, slow_print(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, _), g in zip(prints, group):
        least[g] = min(x for x in (least.get(g), d) if x is not None) if d is not None or least.get(g) is not None else None
    return sorted((d if d is not None else -1, f"{p:016x}", least[g]) for (d, p), g in zip(prints, group))


def test_every_link_within_the_radius_meets():
    rng = random.Random(1)
    kept = simhash.variants()
    assert len(kept) == 131
    emit = lambda x: {((x & (k % 2**64)) ^ (f % 2**64)) for k, f in kept}
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        assert emit(x) & emit(y)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 40])))) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace("W1", "w1 x", 1)) for i in range(60)]
    long = " ".join(rng.choices(words, k=9000))
    rows += [(400, long), (401, long + " tail"), (402, None), (403, ""), (404, " \n"), (None, long), (401, long + " tail"), (405, "É é\xa0x")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, _x int, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == slow_groups(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_dense_cluster_is_one_component(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        x = rng.choice(sorted(prints))
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(simhash._signed(x) for x in prints)
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, _fp long")
    assert {r.component_id for r in simhash.groups(df).collect()} == {0}


def test_keep_first(spark):
    t = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(3, t, "a"), (1, t, "b"), (1, t, "b"), (2, "other text of its own kind", "c"), (None, t, "d")], "doc_id long, text string, lang string").withColumn("_fp", F.lit(1))
    assert simhash.keep_first(docs).columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang) for r in simhash.keep_first(docs).collect()) == [(0, "d"), (1, "b"), (2, "c")]
