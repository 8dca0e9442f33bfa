import hashlib
import random
import re

import pytest

from tidegate.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def slow(docs, items):
    wins = [(i, w[s : s + 10]) for i, t in items for w in [words(t)] if w for s in range(max(len(w) - 9, 1))]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, k in wins:
            for s in range(len(w) - len(k) + 1):
                if w[s : s + len(k)] == k:
                    hit.update(range(s, s + len(k)))
                    if i is not None:
                        ids.add(str(i))
        out.append((-1 if d is None else d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gamma", "Éclair", "d4", "e", "f", "it", "of", "the"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 6, 10, 14, 30])))) for i in range(4, 26)]
    items += [(1, "unique"), (2, "two words"), (3, "x y z"), (30, None), (31, "--"), (None, "nameless item words here"), (10, items[0][1]), (3, "x y z")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 9, 60])))) for i in range(40)]
    for i in range(40, 70):
        a, b = rng.choices(vocabulary, k=5), rng.choices(vocabulary, k=5)
        docs.append((i, " ".join(a) + ", " + rng.choice(items)[1].__str__().upper() + "! " + " ".join(b)))
    docs += [(70, None), (71, ""), (72, "a UNIQUE thing, two  words; x/y/z"), (None, "nameless item words here"), (73, "x y z " * 3000), (45, docs[45][1]), (45, "the other text")]
    return docs, items


@pytest.mark.parametrize("bound", [10**6, 0])
def test_against_brute_force(spark, bound):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, row string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, win string")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in dc.contamination(d, b, broadcast_windows=bound).collect())
    assert got == slow(docs, items)


def test_empty_tables_and_clean(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in dc.contamination(d, b.limit(0)).collect()} == {0}
    d = d.selectExpr("*", "1 as whole", "2 as h")
    kept = dc.clean(d, b)
    bad = [r for r in slow(docs, items) if r[2]]
    assert kept.count() == len(docs) - len(bad) and kept.columns == d.columns
