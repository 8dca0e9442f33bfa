import random
from collections import defaultdict

from tidegate.llm import chat


def slow(rows):
    convs = defaultdict(set)
    for c, t, who, text in rows:
        convs[c].add((t is not None, t, who or "unknown", text or ""))
    out = []
    for c, turns in convs.items():
        for me in {w for _, _, w, _ in turns} - {"system"}:
            at = 0
            for _, t, who, text in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3])):
                head = "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == me else f"<|user name={who}|>\n"
                s = head + text + "<|end|>\n"
                out.append((c, me, t, s, at, (at + len(head), at + len(s)) if who == me else (None, None)))
                at += len(s)
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "zoë", None]), rng.choice(["hi", "", None, "é\n\U0001f600"])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, t, rng.choice(["a", "b", "c"]), f"t{t}") for t in range(3000)]  # a hot conversation of several blocks
    rows += [(51, 0, "system", "alone"), (None, 1, "user", "no id"), (None, None, "bot", "x"), (52, 1, "u", "x"), (52, 1, "u", "x"), (52, 1, "u", "w"), (53, -700, "u", "early"), (53, 2, "v", "z" * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, speaker string")
    got = chat.rotate(df).collect()
    assert sorted(((r.conv_id, r.speaker, r.turn, r.segment, r.start, (r.mask_start, r.mask_end)) for r in got), key=str) == slow(rows)
    assert all(r.n_chars == len(r.segment) for r in got)
    assert chat.rotate(df.limit(0)).count() == 0
