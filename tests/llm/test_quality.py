import random
import re
from collections import Counter

from tidegate.llm import quality


def slow(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def cases():
    rng = random.Random(6)
    vocabulary = ["a", "bb", "Ünï", "c#", "d|", "EE", "\xa0", "\U0001f600"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \x0b"]) for _ in range(rng.choice([0, 3, 5, 9, 40, 400])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n\t "), (None, "a b c d e a b c d e"), (103, "x " * 20000), (104, "q\nq\n\n q\nq"), (104, "q\nq\n\n q\nq")]


def test_statistics(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = quality.statistics(docs).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(key((r.doc_id, *(r[c] for c in quality.COUNTS))) for r in got) == sorted(key((i, *slow(t))) for i, t in rows)


def test_rules_are_learned_and_take_effect(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["good", "good", "good", "symbols", "upper"])
        t = good()
        t = t.replace(" ", "%% ") if kind == "symbols" else t.upper() if kind == "upper" else t
        rows.append((i, t, kind))
        if i % 2:
            labels.append((i, int(kind == "good"), 0))
    labels += [(None, 0, 0), (1, None, None), (9999, 0, 0)]
    docs = spark.createDataFrame(rows + [(700, None, "good"), (701, rows[0][1], "good"), (701, rows[0][1], "good")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = quality.learn(quality.labelled(quality.statistics(docs), marks))
    assert 1 <= len(learned) <= 4 and all(r.good == 0 for r in learned)
    got = quality.judge(docs, marks).collect()
    assert len(got) == len(rows) + 3
    kind = {r[0]: r[2] for r in rows}
    assert all(r.kept == (kind[r.doc_id] == "good") for r in got if r.doc_id in kind)
    assert [r.kept for r in got if r.doc_id == 700] == [False]
    kept = quality.keep(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(docs.limit(0), marks).count() == 0
    assert all(r.kept for r in quality.judge(docs, marks.limit(0)).collect() if r.doc_id in kind)
