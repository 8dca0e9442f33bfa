import random

import pytest

from tidegate.llm import lines


def slow(rows):
    """rows: (doc_id, text) of distinct ids; the texts that remain."""
    out, before = [], []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        keep = []
        for x in (t if t is not None else "").split("\n"):
            u = tuple(x.encode().lower().split())
            w = frozenset(u[i : i + 5] for i in range(max(1, len(u) - 4))) if u else frozenset()
            hit = w and any(5 * len(w & o) >= 4 * len(w | o) for o in before)
            if w:
                before.append(w)
            if not hit:
                keep.append(x)
        out.append((d, None if t is None else "\n".join(keep)))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)] + ["the", "of", "É", "a"] * 40
    pool = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 60]))) for _ in range(60)]

    def line():
        x = rng.choice(pool).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        return "  ".join(x).upper() if rng.random() < 0.1 else " ".join(x)

    rows = [(i, "\n".join(rng.choice([line(), line(), "", " \t"]) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    hot = " ".join(f"h{i}" for i in range(30))
    for i in range(200, 330):  # a large group of near copies
        x = hot.split()
        x[rng.choice([0, 1, 29, 28, 15])] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(x) + "\n" + hot + "\nown line of " + str(i)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, " ".join(f"long{i}" for i in range(9000)) + "\nshort"), (None, "the null line\nW1 W2")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = cases(seed)
    docs = spark.createDataFrame([(*r, "g") for r in rows], "doc_id long, text string, gone string")
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "text", "gone", "n_removed"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == dict(slow(rows))


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (2, "c\na b\nd")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_removed) for r in lines.dedup(docs).collect()) == [(1, "a b\nc", 0), (1, "a b\nc", 0), (2, "d", 2)]
    assert lines.dedup(docs.limit(0)).count() == 0


def test_hot_tokens_and_rounds(spark, monkeypatch):
    """Blocks of a few rows and one candidate a round: lines stay open, and are held against all blocks."""
    monkeypatch.setattr(lines, "HOT", 12)
    monkeypatch.setattr(lines, "SLICES", 1)
    monkeypatch.setattr(lines, "KEEP", 1)
    rows = cases(3)
    # a hot group in which most pairs fail: all share a rare prefix, few match
    rng = random.Random(5)
    rows += [(600 + i, " ".join([f"p{k}" for k in range(6)] + [f"q{rng.randrange(3)}{k}" for k in range(14)] + [f"z{rng.randrange(40)}"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == dict(slow(rows))


def test_a_text_of_more_than_a_million_lines(spark):
    words = [f"c{i}" for i in range(60)]
    near = words[:59] + ["other"]
    long = "\n".join(map(str, range(1_150_000))) + "\n" + " ".join(near)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, long), (3, "17\n" + " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, len(r.text)) for r in lines.dedup(docs).collect()}
    assert got == {1: (0, len(docs.first().text)), 2: (1, len(long) - len(" ".join(near)) - 1), 3: (2, 0)}


def thue_morse(n, a, b):
    return [a if i.bit_count() % 2 == 0 else b for i in range(n)]


def test_words_and_lines_that_sums_of_powers_confuse(spark):
    """Words of 1,024 letters, and lines of 1,024 words, whose polynomials mod 2^64 are equal for any odd base."""
    words = ["".join(thue_morse(1024, *x)) for x in ("ab", "ba")]
    texts = [" ".join(thue_morse(2048, *x)) for x in (("one", "two"), ("two", "one"))]
    twins = [f"{words[0]} {i}" for i in range(3)]
    rows = [(1, words[0]), (2, words[1]), (3, texts[0]), (4, texts[1]), (5, "\n".join(twins)), (6, f"{words[1]} 1"), (7, words[0])]
    got = {r.doc_id: r.n_removed for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # shingles of texts 3 and 4 are the same ten sets of words, so that Jaccard is 1: compare with the model
    want = {d: (dict(rows)[d].count("\n") + 1 if not t else dict(rows)[d].count("\n") - t.count("\n")) for d, t in slow(rows)}
    assert got == want and got[2] == 0 and got[6] == 0 and got[7] == 1


def test_a_text_of_equal_lines(spark):
    """All but the first of 400,000 go, in time that is linear in their number."""
    rows = [(1, "\n".join(["the very same line"] * 400_000)), (2, "\n".join(["x y z", "the very same line", "last", ""]))]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (399_999, "the very same line"), 2: (1, "x y z\nlast\n")}
