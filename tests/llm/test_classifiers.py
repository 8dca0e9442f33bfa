import random
import zlib

import numpy as np

from tidegate.llm import language, toxicity
from tidegate.llm.common import bucket_of

LANGS = {"aa": "lorem dolor sitam consec tetur", "bb": "wiegen schoen strasse über grüßen", "cc": "kota beli nasi goreng ayam"}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, lang, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(1, 40)))) for i, lang in ((i, rng.choice(sorted(LANGS))) for i in range(n))]


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def test_kernel_is_the_blended_spectrum():
    m = language.fit([t for _, _, t in texts(30)], [lang for _, lang, _ in texts(30)])

    def grams(t):
        x = m.numbers(t)
        return set(m.codes(x).tolist()), {tuple(x[i : i + n].tolist()) for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    codes, want = grams("Lorem, ipsum!! Ωmega")
    assert len(codes) == len(want)
    k, letter = m.kernel(["lorem dolor", "12 !?"])
    assert letter.tolist() == [True, False]
    both = grams("lorem dolor")[0]
    j = 3
    column = set(m.grams[m.landmarks[:, j] > 0].tolist())
    assert abs(k[0, j] - len(both & column) / np.sqrt(len(both) * len(column))) < 1e-5


def test_language_query(spark):
    rows = [(i, t, lang, 0.5) for i, lang, t in texts(300)] + [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "123 --", "bb", 0.0), (None, "wiegen grüßen", None, 0.0), (903, "kota beli " * 5000, "cc", 0.0), (903, "kota beli " * 5000, "cc", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    held = bucket_of("doc_id", 5) == 0
    got = language.identify(docs, language.train(docs, ~held), held).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    judged = [r.lang_pred == want[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean(judged) > 0.95
    empty = docs.limit(0)
    assert language.identify(empty, language.train(empty, ~held), held).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None, held).collect()} == {"und"}


def test_toxicity_query(spark):
    rng = random.Random(4)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        words = rng.choices(common, k=rng.randint(5, 60)) + (rng.sample(["Scoundrel,", "rascal", "villain!"], k=2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        if rng.random() < 0.6:
            labels.append((i, int(bad), int(bad)))
    truth = {r[0]: any(w.strip(",!").lower() in ("scoundrel", "rascal", "villain") for w in r[1].split()) for r in rows}
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "rascal villain", "x"), (5002, "word1 " * 20000, "x"), (3, rows[3][1], "x")]
    labels += [(None, 1, 1), (0, None, None), (7, 1, int(truth[7])), (7, 1, int(truth[7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = bucket_of("doc_id", 3) == 1
    got = toxicity.detect(docs, toxicity.train(docs, marks, ~held), held).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) for r in got)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, t in judged if t]) > 0.9 and np.mean([p for p, t in judged if not t]) < 0.05
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001, 5002))
    none = toxicity.train(docs, marks.filter("toxic = 0"), ~held)
    assert none is None and {r.score for r in toxicity.detect(docs, none, held).collect()} == {0.0}
    assert toxicity.detect(docs.limit(0), None, held).count() == 0
