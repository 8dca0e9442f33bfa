import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidegate.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root, and for each leaf the digests of its run to the left and to the right, level by level."""
    level, under, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, over = [], []
        for s in range(0, len(level), 3):
            run = level[s : s + 3]
            for k in range(len(run)):
                for i in under[s + k]:
                    paths[i] += ["".join(run[:k]), "".join(run[k + 1 :])]
            above.append(h(*run))
            over.append([i for u in under[s : s + 3] for i in u])
        level, under = above, over
    return level[0], paths


def slow(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        d, text, lang, source, n = r
        bent = text if text is None or zlib.crc32(b"" if d is None else str(d).encode()) % 2 else text.replace("\n", "")
        groups.setdefault(source, []).append((-1 if d is None else d, leaf(d, source, lang, n, text), leaf(d, source, lang, n, bent)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        groups[s].sort()
        subs[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([subs[s][0] for s in names])
    out = []
    for s, high in zip(names, tops, strict=True):
        for (d, a, b), low in zip(groups[s], subs[s][1], strict=True):
            path, folded = low + high, b
            for k in range(0, len(path), 2):
                folded = h(path[k], folded, path[k + 1])
            out.append((d, a, subs[s][0], root, h(*path), folded, folded == root))
    return sorted(out)


def cases(sizes, seed=3):
    rng = random.Random(seed)
    rows, d = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            d += rng.choice([1, 1, 5])
            rows.append((d, rng.choice(["a\nb", "é", "", None, "x" * 50, "no ends", "\n"]), rng.choice(["en", None]), s, rng.choice([3, None])))
    rng.shuffle(rows)
    return rows


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def answers(spark, rows, levels=merkle.LEVELS):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as g", "1 as leaf", "2 as key", "3 as i", "'p' as path")
    out = merkle.proofs(merkle.document_leaves(df), levels=levels)
    out = out.select(F.col("key"), "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256), merkle.fold(F.col("bent"), F.col("path")).alias("folded"))
    return sorted((-1 if r[0] is None else r[0], *r[1:], r.folded == r.root) for r in out.collect())


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_brute_force(spark, levels):
    """Peaks and merging steps of one, two and seven levels; sizes around powers of three; one group has a third of all rows."""
    sizes = {"hot": 130, "one": 1, "two": 2, "three": 3, "four": 4, "nine": 9, "ten": 10, "é": 27, "": 28, "Z": 81, None: 82, "src10": 5, "src9": 7}
    rows = cases(sizes)
    assert answers(spark, rows, levels) == slow(rows)


def test_repeats_nulls_and_empty_tables(spark):
    rows = cases({"a": 5, None: 3}) + [(1, "t", "en", "a", 1)] * 40 + [(None, "t\n", None, "a", None), (None, None, None, None, None), (7, "y" * 3_000_000, "en", "b", 3)]
    assert answers(spark, rows) == slow(rows)
    assert answers(spark, []) == []
    assert answers(spark, rows[:1]) == slow(rows[:1])


def test_runs_cut_anywhere_give_one_tree(spark):
    """A stack sees any pieces of the order; what it emits covers its leaves, in order, with aligned peaks."""
    digests = [h(str(i)) for i in range(200)]
    for a, b in [(0, 200), (1, 200), (5, 6), (7, 80), (26, 28), (81, 162)]:
        stack, seen = merkle.Mountains(), []
        for i in range(a, b):
            stack.push(i, digests[i])
            seen += stack.take()
        stack.end()
        seen += stack.take()
        assert len(seen) == b - a
        for i, (level, place, _, path) in zip(range(a, b), seen, strict=True):
            assert i // 3**level == place and len(path) == 2 * level
            x = digests[i]
            for k in range(0, len(path), 2):
                x = h(path[k], x, path[k + 1])
            assert x == next(p for (lv, pl, p, _) in seen if (lv, pl) == (level, place) and p)


def test_nodes(spark):
    rows = cases({"a": 14, "b": 1, "c": 9})
    df = spark.createDataFrame(rows, KIND)
    proved = merkle.proofs(merkle.document_leaves(df))
    got = {(r.group, r.level, r.place): r.digest for r in merkle.nodes(proved).collect()}
    assert {k: sum(1 for x in got if x[0] == k) for k in "abc"} == {"a": 14 + 5 + 2 + 1, "b": 1, "c": 9 + 3 + 1}
    for (g, level, place), d in got.items():
        if level:
            assert d == h(*[got[g, level - 1, c] for c in range(3 * place, 3 * place + 3) if (g, level - 1, c) in got])
