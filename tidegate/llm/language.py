"""Language identification by string kernels.

Kernel: the blended spectrum of character 1-, 2- and 3-grams by presence, K(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).
Nystroem: K is taken against LANDMARKS training texts, and features are K(x, L) K(L, L)^(-1/2). On these a one-versus-
rest kernel ridge regression is solved for each language. A text is scored by its presence vector over the landmarks'
n-grams times the presence matrix of the landmarks, times the coefficients: two products for a batch of texts.

Letters are lower-cased; anything that is no letter is one separator. Letters beyond the ALPHABET most frequent of the
training texts count as one and the same letter.

The classifier is fitted on a bounded sample, at most SAMPLE training rows: LEAST of each language, the rest by its
share, those of the smallest id hashes. Every text is scored whole.

Defined results: null text, or one without a letter: lang_pred 'und', score 0. Null lang: the row is not learned from.
Without training rows every text is 'und'. Repeated rows give repeated rows. Extra columns of the input are ignored.
Ties between languages go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, map_arrow, read

SAMPLE = 2400
LEAST = 40  # rows of a rare language in the sample
LANDMARKS = 160
ALPHABET = 90
RIDGE = 1e-3
ROWS = 128  # texts of a matrix product


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def alphabet(texts: list[str]) -> dict[int, int]:
    """Number, from 1, of each of the most frequent letters."""
    seen: dict[int, int] = {}
    for t in texts:
        code, n = np.unique(codes_of(t), return_counts=True)
        for c, k in zip(code.tolist(), n.tolist(), strict=True):
            if chr(c).isalpha():
                seen[c] = seen.get(c, 0) + k
    return {c: i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))[:ALPHABET])}


@dataclass
class Model:
    letters: dict[int, int]
    grams: np.ndarray  # code of each column of the presence matrix
    landmarks: np.ndarray  # columns x landmarks, presence over the root of the landmark's size
    weights: np.ndarray  # landmarks x languages
    names: list[str]

    def __post_init__(self):
        self.base = ALPHABET + 2
        self.small = np.zeros(0x250, np.int64)
        for c, i in self.letters.items():
            if c < len(self.small):
                self.small[c] = i
        for c in range(len(self.small)):
            if chr(c).isalpha() and c not in self.letters:
                self.small[c] = ALPHABET + 1
        self.columns = np.full(self.base**3 + self.base**2 + self.base, -1, np.int32)
        self.columns[self.grams] = np.arange(len(self.grams))

    def numbers(self, text: str) -> np.ndarray:
        """The text as letter numbers, separators between runs of letters and around them."""
        code = codes_of(text)
        low = code < len(self.small)
        out = self.small[np.where(low, code, 0)]
        if not low.all():
            kinds, back = np.unique(code[~low], return_inverse=True)
            out[~low] = np.array([self.letters.get(c, ALPHABET + 1) if c < 0x110000 and chr(c).isalpha() else 0 for c in kinds.tolist()], np.int64)[back]
        out = np.concatenate([[0], out, [0]])
        return out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes of all n-grams, n = 1, 2, 3, of a text of numbers, with repeats."""
        b = self.base
        return np.concatenate([x[1:-1], b + x[:-1] * b + x[1:], b + b * b + (x[:-2] * b + x[1:-1]) * b + x[2:]])

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of presence over the columns; number of distinct n-grams of each text; whether it has a letter."""
        out = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        size, letter = np.ones(len(texts)), np.zeros(len(texts), bool)
        flags = np.zeros(len(self.columns), bool)
        for i, t in enumerate(texts):
            x = self.numbers(t)
            if len(x) < 3:
                continue
            letter[i] = True
            code = self.codes(x)
            out[i, self.columns[code]] = 1  # code -1, the last column: in no landmark
            flags[code] = True
            size[i] = np.count_nonzero(flags)
            flags[code] = False
        return out[:, :-1], size, letter

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, size, letter = self.presence(texts)
        return (rows @ self.landmarks) / np.sqrt(size)[:, None], letter

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k, letter = self.kernel(texts)
        return k @ self.weights, letter


def fit(texts: list[str], langs: list[str]) -> Model | None:
    if not texts:
        return None
    names = sorted(set(langs))
    letters = alphabet(texts)
    model = Model(letters, np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32), names)
    # landmarks by turns from each language, in the order given
    by = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    turns = [by[n][k] for k in range(max(map(len, by.values()))) for n in names if k < len(by[n])]
    marks = [np.unique(model.codes(x)) for x in (model.numbers(texts[i]) for i in turns[: 3 * LANDMARKS]) if len(x) >= 3][:LANDMARKS]
    if not marks:
        return None
    grams = np.unique(np.concatenate(marks))
    matrix = np.zeros((len(grams), len(marks)), np.float32)
    for j, m in enumerate(marks):
        matrix[np.searchsorted(grams, m), j] = 1 / np.sqrt(len(m))
    model = Model(letters, grams, matrix, np.empty((len(marks), 0), np.float32), names)
    got = [model.kernel(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
    k, use = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    inner = (matrix.T @ matrix).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K(L, L)^(-1/2), up to a rotation
    phi = k[use] @ root
    y = np.where(np.array(langs)[use, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
    model.weights = (root @ solved).astype(np.float32)
    return model


def sample(docs: DataFrame, learn: Column, bound: int) -> DataFrame:
    """At most some `bound` rows for which learn holds, the same ones at any partitioning: those of small id hashes."""
    n = docs.filter(learn).count()
    cut = int(min(1.0, bound / max(n, 1)) * (1 << 32))
    return docs.filter(learn & (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 32)) < cut))


def quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """Rows of each language, `bound` at most in all: LEAST of it (fewer if there are many languages), then by its share."""
    least = {n: min(c, LEAST, max(1, bound // (2 * len(counts)))) for n, c in counts.items()}
    rest, left = sum(counts.values()) - sum(least.values()), bound - sum(least.values())
    return {n: least[n] + (min(c - least[n], left * (c - least[n]) // rest) if rest else 0) for n, c in counts.items()}


def by_language(docs: DataFrame, learn: Column, bound: int) -> DataFrame:
    """At most `bound` rows for which learn holds, some of each lang, the same ones at any partitioning: those of small id hashes.

    Beyond `bound` languages those of most rows count.
    """
    spark = docs.sparkSession
    counts = docs.filter(learn).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(bound).collect()
    if not counts:
        return docs.filter(F.lit(False))
    counts = {r.lang: r["count"] for r in counts}
    # a cut that leaves few more rows than the quota, so that little is sorted
    cuts = [(n, q, int(min(1.0, (q + 6 * q**0.5 + 12) / counts[n]) * (1 << 32))) for n, q in quotas(counts, bound).items()]
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 32))
    rows = docs.filter(learn).withColumn("_place", place).join(F.broadcast(spark.createDataFrame(cuts, "lang string, _quota int, _cut long")), "lang").filter("_place < _cut")  # `bound` rows at most
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id", "text")))
    return ranked.filter("_rank <= _quota").select(docs.columns)


def train(docs: DataFrame, learn: Column) -> Model | None:
    rows = by_language(docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang", learn.alias("_learn")), F.col("_learn"), SAMPLE).select("doc_id", "text", "lang").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """SCHEMA for each row of docs."""
    parts = None if model is None else (model.letters, model.grams, model.landmarks, model.weights, model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if parts is None else Model(*parts)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if m is None:
                    names, best = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    f, letter = m.scores(texts)
                    which = f.argmax(axis=1)
                    names = [m.names[w] if ok else "und" for w, ok in zip(which, letter, strict=True)]
                    best = np.where(letter, np.clip((1 + f[np.arange(len(f)), which]) / 2, 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", held_out.alias("held_out"), "text"), run, SCHEMA)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = bucket_of("doc_id", 5) == 0
    return identify(docs, train(docs, ~held), held)
