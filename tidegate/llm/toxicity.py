"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words and word beginnings is fitted in numpy from confirmed toxic texts (P) and texts of unknown kind
(U). With prior p of toxic texts, the risk of calling a text clean can't be read off U, which holds toxic texts; it is
estimated as R_U(clean) - p R_P(clean), and kept from going negative: the objective is
p R_P(toxic) + max(0, R_U(clean) - p R_P(clean)), and where the second term falls below zero the step goes up its
gradient instead. Labels of clean texts only enter the estimate of p, the share of toxic texts among labelled ones.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. The fit takes a bounded sample: at most
POSITIVES toxic and UNLABELLED other training texts (those of the smallest id hashes), and of their words those
that occur in LEAST texts or more and in shares of P and U that lie ERRORS standard errors apart. Every text is scored whole.

Defined results: null text counts as empty; a text without known words gets the score of the bias alone. Without toxic
training texts every score is 0. An id with several labels is toxic if one of them says so. Rows without id are not
learned from. Repeated rows give repeated rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, bucket_of, drop, map_arrow, materialize, read
from .language import sample

POSITIVES, UNLABELLED = 3000, 12000
LEAST, ERRORS = 12, 5.0
EPOCHS, STEPS, BATCH, RATE, DECAY = 30, 600, 256, 0.5, 1e-4
CUT = 0.7
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Words, and their beginnings of 4, 5 and 6 bytes with a mark: forms of one stem share them."""
    words = set((text or "").encode("utf-8", "replace").translate(_KEEP).split())
    long = [w for w in words if len(w) > 4]
    words.update(w[:4] + b"*" for w in long)
    words.update(w[:5] + b"*" for w in long)
    words.update(w[:6] + b"*" for w in long)
    return words


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *rows]), np.cumsum([0, *map(len, rows)])


def calibrated(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[bytes], prior: float) -> tuple[dict[bytes, float], float]:
    """fit() on three quarters of the rows; the bias is then moved so that the cut which serves the last quarter
    best becomes CUT. Rows: word numbers."""
    w, bias = fit([x for i, x in enumerate(positive) if i % 4], [x for i, x in enumerate(unlabelled) if i % 4], len(names), prior)
    z = [np.sort([bias + w[x].sum() for x in rows[::4]]) for rows in (positive, unlabelled)]
    above = [1 - np.searchsorted(x, z[0], "left") / len(x) for x in z]
    # F with precision weighted twice, from the shares of P and U above each cut; no clean texts are needed
    cut = z[0][np.argmax(1.25 * prior * above[0] / (0.25 * prior + above[1]))]
    below = [x[x < cut - 1e-9].max() for x in z if (x < cut - 1e-9).any()]
    cut = (cut + max(below)) / 2 if below else cut - 1e-6
    weights = {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-4)}
    return weights, float(bias - cut + np.log(CUT / (1 - CUT)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the `size` words, and the bias. Rows: numbers of the words present."""
    in_p, in_u = (np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=size) for rows in (positive, unlabelled))
    share = (in_p + in_u + 1) / (len(positive) + len(unlabelled) + 2)
    error = np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)))
    chosen = np.flatnonzero((in_p + in_u >= LEAST) & (np.abs(in_p / len(positive) - in_u / len(unlabelled)) > ERRORS * error))
    n = len(chosen)
    number = np.full(size, -1)
    number[chosen] = np.arange(n)
    sets = [[x[x >= 0] for x in (number[r] for r in rows)] for rows in (positive, unlabelled)]
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rounds = max(EPOCHS, -(-STEPS * BATCH // len(sets[1])))
    total = rounds * -(-len(sets[1]) // BATCH)
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(sets[1]))
        for at in range(0, len(order), BATCH):
            picked = [[sets[0][i] for i in rng.integers(len(sets[0]), size=BATCH)], [sets[1][i] for i in order[at : at + BATCH]]]
            grads, risks = [], []
            for rows in picked:
                idx, ptr = _csr(rows)
                z = np.add.reduceat(np.append(w[idx], 0.0), ptr[:-1]) * (np.diff(ptr) > 0) + w[n]
                p = sigmoid(z)
                # logistic losses: gradient of calling these toxic, and clean; the risk of the latter
                grads.append([np.append(np.bincount(idx, np.repeat(g, np.diff(ptr)), n), g.sum()) / len(rows) for g in (p - 1, p)])
                risks.append(np.logaddexp(0, z).mean())
            clean = risks[1] - prior * risks[0]
            down = grads[1][1] - prior * grads[0][1]
            g = prior * grads[0][0] + down if clean >= 0 else -down
            g[:n] += DECAY * w[:n]
            v = 0.9 * v + g
            w -= RATE * (1 - step / total) * v
            step += 1
    out = np.zeros(size)
    out[chosen] = w[:n]
    return out, float(w[n])


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[dict[bytes, float], float] | None:
    marks = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("bad")).first()
    if not got.bad:
        return None
    prior = min(0.9, max(1e-4, got.bad / got.n))
    known = docs.filter("doc_id is not null")
    # ids of at most some POSITIVES texts: a bounded broadcast
    bad = sample(marks.filter("toxic = 1"), F.lit(True), POSITIVES).select("doc_id").limit(2 * POSITIVES)
    toxic = known.filter(learn).join(F.broadcast(bad), "doc_id", "left_semi").select(F.lit(True).alias("bad"), "doc_id", "text")
    other = sample(known, learn, UNLABELLED).select(F.lit(False).alias("bad"), "doc_id", "text").limit(2 * UNLABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b" ".join(sorted(words_of(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("bad"), b.column("doc_id"), pa.array(rows, pa.binary())], ["bad", "doc_id", "words"])

    rows, path = materialize(map_arrow(toxic.union(other), run, "bad boolean, doc_id long, words binary"), "toxicity-sample")
    words = Vocabulary()
    sets: dict[bool, list] = {True: [], False: []}
    # one partition at a time, each row at once turned into numbers
    for r in rows.orderBy("doc_id", "bad", "words").toLocalIterator():
        sets[r.bad].append(words.encode(bytes(r.words).split()).astype(np.int32))
    drop(docs.sparkSession, path)
    return calibrated(sets[True], sets[False], words.words, prior) if all(sets.values()) else None


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def detect(docs: DataFrame, model: tuple[dict[bytes, float], float] | None, held_out: Column) -> DataFrame:
    """SCHEMA for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model or ({}, None)
        known = weights.keys()
        for b in batches:
            if bias is None:
                score = np.zeros(b.num_rows)
            else:
                z = np.array([bias + sum(map(weights.__getitem__, sorted(words_of(t.as_py()) & known))) for t in b.column("text")], np.float64)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select("doc_id", held_out.alias("held_out"), "text"), run, SCHEMA)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 3) == 1
    return detect(docs, train(docs, read(spark, sf_dir, "labels"), ~held), held)
