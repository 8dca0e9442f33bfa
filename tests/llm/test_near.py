import itertools
import random

import corpus_pipeline
from tidegate.llm import near, simhash


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def slow(rows):
    sets = [five(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if (not union or 5 * len(sets[i] & sets[j]) >= 4 * union) and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return sorted(min(d for (d, _), g in zip(rows, group) if g == k) for k in set(group))


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 9, 40, 200, 700])))) for i in range(150)]
    for i in range(150, 450):  # similarities on both sides of 0.8
        w = rows[rng.randrange(i)][1].split()
        for _ in range(rng.randint(0, 1 + len(w) // 30)):
            w[rng.randrange(len(w)) if w else 0 : 0] = [rng.choice(words)] if w else []
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    return rows + [(500, None), (501, " \n")]


def test_every_pair_at_the_threshold_links(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == slow(rows)
    assert 150 < len(got) < 400


def test_rows(spark):
    t = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(3, t, 5), (1, t, 6), (1, t, 6), (1, t + " x", 6), (2, "other text of its own kind", 7)], "doc_id int, text string, _text int")
    got = near.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r._text) for r in got.collect()) == [(1, 6), (2, 7)]


def test_rows_without_id(spark):
    t, u, v = (" ".join(f"{k}{i}" for i in range(80)) for k in "tuv")
    rows = [(None, t), (7, t), (None, t + " x"), (None, u), (None, u), (None, u + " x"), (None, v), (8, "else")]
    got = [(r.doc_id, r.text[0]) for r in near.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i or 0, k) for i, k in got) == [(0, "u"), (0, "v"), (7, "t"), (8, "e")]


def test_fingerprints_link_by_op3(spark):
    """A passage many times over and few other words: the sets are far from 0.8, the fingerprints within 3 bits."""
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    spam = " ".join([words("s", 30)] * 200)
    rows = [(1, f"{spam} {words('a', 40)}"), (2, f"{spam} {words('b', 40)}"), (3, words("c", 80))]
    assert not any(5 * len(five(a) & five(b)) >= 4 * len(five(a) | five(b)) for (_, a), (_, b) in itertools.combinations(rows, 2))
    assert (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
