"""Ranked lexical search: every document is scored against every item by sort-based accumulation.

Items are cut into ranges of a bounded number of (item, term) pairs, and each range goes over all documents in blocks. A
document's matched terms are kept once, as postings (term, occurrences, length of the document). To score a block, the
arrays of its matched items, documents and impacts are concatenated, the keys (item and document packed into one number)
are radix sorted, and runs of equal keys are summed by reduceat. A block's sums pass through a heap for each item, and the
heaps of the tasks meet in a ranking by item. A document is scored within one task, so the heaps lose nothing; no row is
made for a pair, and a term that all documents have is never gathered anywhere.

Defined results: null and wordless texts have no terms and no score, and are not counted. Items of one id are one item with the
terms of all; a null id is an id. Rows are documents, also if they share a doc_id; one without comes last among its equals. An
item without terms, or without a document that scores, has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, drop, map_arrow, materialize, ranges, read

#: Pairs of item and term in one range of items: what the driver and each task hold of the items.
RANGE_PAIRS = 400_000
#: Matched (item, document) pairs that are sorted at a time, and bytes of a text that are cut into words at a time.
BLOCK, PIECE = 1 << 21, 1 << 22
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SPACED = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms(text: Column) -> Column:
    """Terms of a text, lower-cased A-Z only, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    data = data.translate(_SPACED)
    at = 0
    while at < len(data):
        end = len(data) if at + size >= len(data) else data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def impact(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def length_norm(n: int, documents: int, total: int) -> int:
    """The norm of a document of n terms, in hundredths of an average document's; in whole numbers of any size."""
    return 100 - 90 + 90 * n * documents // total


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by 16 bits at a time from the lowest; digits that all keys share cost nothing."""
    order = None
    for shift in (0, 16, 32, 48):
        digits = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digits) and digits.min() == digits.max():
            continue
        step = np.argsort(digits if order is None else digits[order], kind="stable")  # of 16-bit numbers, numpy's stable sort is a radix sort
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


def sums(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, doc, sum of the impacts of each pair that occurs, by sorting packed keys."""
    if not len(items):
        return items, docs, impacts
    keys = (items.astype(np.uint64) << np.uint64(32)) | docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(impacts[order], first)


class Best:
    """The k best of each item so far: by score, then the smallest id, ids that are null last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below it cannot enter

    def add(self, items: np.ndarray, ids: list, scores: np.ndarray, docs: np.ndarray) -> None:
        for j in np.flatnonzero(scores >= self.least[items]):
            item, doc = int(items[j]), ids[docs[j]]
            entry = (int(scores[j]), doc is not None, 0 if doc is None else -doc)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, doc in heap:
                yield item, -doc if known else None, score


def _postings(numbers: dict[bytes, int]):
    """doc_id, n, terms, counts of each document that has terms of the items; last, of the task: documents, terms, and how many documents have each term."""

    def run(batches):
        documents, total, held = 0, 0, np.zeros(len(numbers), np.int64)
        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            keep, lengths, found, counts = [], [], [], []
            for j, text in enumerate(b.column("text").cast(pa.binary())):
                n, seen = 0, Counter()
                if text.is_valid:
                    for words in pieces(text.as_py()):
                        n += len(words)
                        seen.update(words)
                if not n:
                    continue
                documents, total = documents + 1, total + n
                hits = [(numbers[w], c) for w, c in seen.items() if w in numbers]
                if hits:
                    which, times = zip(*hits, strict=True)
                    held[list(which)] += 1
                    keep.append(j)
                    lengths.append(n)
                    found.append(which)
                    counts.append(times)
            if keep:
                yield _batch(b.column("doc_id").take(pa.array(keep)), lengths, found, counts, False)
        if documents:
            some = np.flatnonzero(held)
            yield _batch(pa.array([None], kind), [documents], [some.tolist()], [held[some].tolist()], True, total)

    return run


def _batch(ids, lengths, found, counts, of_task: bool, total: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())), pa.array([total] * len(ids), pa.int64()), pa.array([of_task] * len(ids), pa.bool_())],
        names=["doc_id", "n", "terms", "counts", "total", "of_task"],
    )


def _score(starts: np.ndarray, members: np.ndarray, weights: np.ndarray, names: list, documents: int, total: int, k: int, kind, name_kind):
    """Best k documents of each item in a task. Items of term t: members[starts[t]:starts[t + 1]]."""

    def run(batches):
        best = Best(len(names), k)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            lists = b.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy()
            norms = np.array([length_norm(n, documents, total) for n in b.column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            value = impact(weights[term], tf, norms[doc])
            fan = starts[term + 1] - starts[term]
            ends = np.cumsum(np.concatenate([[0], fan]))[np.concatenate([[0], np.cumsum(sizes)])]  # pairs before each document
            first, at = 0, np.concatenate([[0], np.cumsum(sizes)])
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
                s = slice(at[first], at[last])
                each = ranges(starts[term[s]], fan[s])
                item, d, x = sums(members[each], np.repeat(doc[s], fan[s]), np.repeat(value[s], fan[s]))
                best.add(item, ids, x, d)
                first = last
        rows = list(best.rows())
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item], name_kind), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id: a whole number, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    pairs, _ = materialize(items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct(), "terms")
    parts = max(1, math.ceil(2 * pairs.count() / range_pairs))  # by hash, so each has half as many at the mean
    out = None
    for part in range(parts):
        own = pairs if parts == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        found = _rank_range(docs, own, k, items.schema["item_id"].dataType, docs.schema["doc_id"].dataType)
        if found is not None:
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _rank_range(docs: DataFrame, pairs: DataFrame, k: int, item_type, doc_type) -> DataFrame | None:
    held = pairs.toArrow()  # at most range_pairs rows or so
    if not held.num_rows:
        return None
    item_ids, texts = held.column("item_id").to_pylist(), [t.encode() for t in held.column("term").to_pylist()]
    names = list(dict.fromkeys(item_ids))
    name_at = {x: i for i, x in enumerate(names)}
    numbers = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    term = np.array([numbers[t] for t in texts])
    by_term = np.argsort(term, kind="stable")
    members = np.array([name_at[x] for x in item_ids])[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(numbers) + 1))
    matched = map_arrow(docs.select("doc_id", "text"), _postings(numbers), f"doc_id {doc_type.simpleString()}, n long, terms array<int>, counts array<long>, total long, of_task boolean")
    matched, path = materialize(matched, "postings", "of_task")
    tasks = matched.filter("of_task")
    documents, total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not documents:
        drop(docs.sparkSession, path)
        return None
    holding = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toArrow()  # a row for each term of the range
    df = np.zeros(len(numbers))
    df[holding.column(0).to_numpy()] = holding.column(1).to_numpy()
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    run = _score(starts, members, weights, names, documents, total, k, to_arrow_type(doc_type), to_arrow_type(item_type))
    return map_arrow(matched.filter("not of_task").select("doc_id", "n", "terms", "counts"), run, f"item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score long")


def op13_search(spark, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
size AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) x GROUP BY r, t),
i AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS t FROM benchmark),
weight AS (SELECT t, floor(1000 * ln((2 * size.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t) x, size),
norm AS (SELECT r, doc_id, 100 - 90 + (90 * len(d.w) * size.n) // size.l AS m FROM d, size WHERE len(d.w) > 0),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN weight USING (t) JOIN p USING (t) JOIN norm USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0) x WHERE rank <= 10
"""
