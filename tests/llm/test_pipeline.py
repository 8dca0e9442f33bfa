import random

import corpus_pipeline
from tests.llm import test_decontaminate, test_lines
from tidegate.llm import pieces, quality


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choices(vocabulary, k=n // 3)) for _ in range(3))
    items = [(i, " ".join(rng.choices(vocabulary, k=24))) for i in range(6)]
    rows = [(i, text(60)) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # copies: their lines go, and what is left are empty texts
    rows += [(200 + i, text(30) + "\n" + items[i % 6][1] + "\n" + text(30)) for i in range(8)]
    for i in range(12):  # one line, and the same words in other lines: one of them changed (0.84), or two (0.70)
        w = rng.sample(vocabulary, 62)
        one, two = [*w[:20], w[60], *w[21:60]], [*w[:12], w[60], *w[13:40], w[61], *w[41:60]]
        rows += [(230 + i, " ".join(w[:60])), (250 + i, " ".join(one[:30]) + "\n" + " ".join(one[30:])), (270 + i, "\n".join(" ".join(two[k : k + 20]) for k in (0, 20, 40)))]
    rows += [(300 + i, " ".join(f"{w}%%" for w in text(60).split())) for i in range(20)]
    rows += [(400, None), (401, "a b c")]
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 0, 0) for i in range(14)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    marks = spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, marks).collect() if r.kept}
    assert kept == {i for i, t in rows if i < 300}
    now = test_lines.slow([(i, t) for i, t in rows if i in kept])
    prints = [(i, t, shingles(t)) for i, t in now]
    group = {i: i for i, _, _ in prints}
    for a, _, x in prints:
        for b, _, y in prints:
            if 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    now = [(i, t) for i, t, _ in prints if group[i] == i]
    bad = {r[0] for r in test_decontaminate.slow(now, items) if r[2]}
    c = pieces.codec(pieces.public_model())
    want = sorted((i, len(c.encode(t)[0])) for i, t in now if i not in bad)
    got = corpus_pipeline.run(spark, d)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert 94 < len(want) < 114
    assert {i for i, _ in want if 230 <= i < 290} == {*range(230, 242), *range(270, 282)}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edges_through_all_stages(spark, tmp_path):
    """Empty tables; nulls, repeated rows, a very long text and extra columns with names that operators use themselves."""
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    names = ["_text", "row", "gone", "whole", "hit_row", "line", "_set"]
    good = " ".join(f"w{i}" for i in range(40))
    long = "\n".join(" ".join(f"v{i * 7 + k}" for k in range(7)) for i in range(9000))
    rows = [(1, good), (1, good), (2, long), (3, None), (4, ""), (None, " ".join(f"u{i}" for i in range(40)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *names) for i, t in rows], schema)
    for start, want in ((docs, {1: 1, 2: 1, None: 1}), (docs.limit(0), {})):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, d)
            assert now.columns == docs.columns
            path = f"{d}/{len(want)}-{stage.__name__}"
            now.write.parquet(path)
            now = spark.read.parquet(path)
        left = now.collect()
        assert {r.doc_id: sum(x.doc_id == r.doc_id for x in left) for r in left} == want
        assert all(r[n] == n for r in left for n in names)
        assert corpus_pipeline.STAGES[-1][1](spark, now, d).count() == len(left)
