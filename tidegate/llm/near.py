"""Near copies of documents: SimHash fingerprints within op3's radius, and Jaccard similarity of word shingles of 0.8 or more.

A document is the set of its shingles of five words, lower-cased A-Z (one of fewer words is one shingle); documents
without words have the empty set and equal each other. Two documents link if their fingerprints, of all shingles with
repeats, differ in 3 bits or fewer, as op3 links them (balls of half the radius, verified on all 64 bits), or if the sets'
similarity is at least 0.8: such pairs differ in 7 to 10 bits on average, which no ball that can be emitted reaches, so
that they are found beside the fingerprints, by MinHash, and verified exactly:

1. Documents of the same set count as one from here on.
2. Each set makes 32 keys of four minima each. A pair at similarity 0.8 shares no key with a probability of
   (1 - 0.8^4)^32 = 4.7e-8, a more similar one less; nothing else is lost.
3. Sets with the same key make a bucket; a bucket that many keys give is kept once. Sets of buckets (few, found through
   a filter of fixed size) are joined to them, and a bucket emits a spanning forest of its verified links.

Repeated rows give repeated rows up to the last step, where one row of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, drop, map_arrow, materialize, partitions
from .lines import _set, mix, needed, spots

SHINGLE = 5
BANDS, ROWS = 32, 4
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate([[0], stop[:-1]])
    return np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(start[: len(words) - size + 1].tolist(), (stop[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of shingles: distinct XXH64, ascending."""
    return np.unique(hashes(text))


def digest(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 42)).view(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band, of the least values of its hash functions; none for the empty set."""
    if not len(s):
        return np.empty(0, np.int64)
    least = np.full(len(SEEDS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 512):  # bounds the table of values
        least = np.minimum(least, mix(s[at : at + 512] ^ SEEDS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, names, keys = [], [], []
        for t in b.column(1):
            raw = hashes(t.as_py())
            distinct = np.unique(raw)
            prints.append(simhash.majority(raw))
            names.append(digest(distinct))
            keys.append(bands(distinct))
        columns = [b.column(0), b.column(2), pa.array(prints, pa.int64()), pa.array(names, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text", "_fp", "_set", "_bands"])


def alike(prints: DataFrame) -> DataFrame:
    """(a, b): links of sets whose documents' fingerprints lie in one of op3's components: each set to the least there, or
    to the least of its fingerprint where that links to no other."""
    of = prints.select("_fp", "_set").distinct()
    roots = components(simhash.links(prints), "near-simhash").select(F.col("node").alias("_fp"), "root")
    whole = of.join(roots, "_fp", "left").select("_set", F.coalesce("root", "_fp").alias("root"))
    first = whole.groupBy("root").agg(F.min("_set").alias("a"), F.max("_set").alias("most")).filter("a <> most")
    return whole.join(first, "root").filter("_set <> a").select("a", F.col("_set").alias("b")).distinct()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (key, set) of a partition, which has whole keys: members of keys with two sets, by a name their members make."""
    keys, sets = [], []
    for b in batches:
        keys.append(b.column(0).to_numpy(zero_copy_only=False))
        sets.append(b.column(1).to_numpy(zero_copy_only=False))
    if not keys:
        return
    key, member = np.concatenate(keys), np.concatenate(sets)
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    name = np.repeat(mix(np.add.reduceat(mix(member.view(np.uint64)), first)).view(np.int64), count)
    many = np.repeat(count > 1, count)
    if many.any():
        yield pa.RecordBatch.from_arrays([pa.array(name[many]), pa.array(member[many])], ["bucket", "_set"])


def forest(names: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of the sets of a bucket: breadth-first, each search over those not yet reached."""
    size = np.array([len(s) for s in sets])
    tokens, ends = np.concatenate(sets), np.cumsum(size)
    left = np.arange(len(sets))
    out = []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            for_size = (5 * size[left] >= 4 * size[x]) & (4 * size[left] <= 5 * size[x])
            near = np.zeros(len(left), bool)
            for k in np.flatnonzero(for_size):
                y = left[k]
                other = tokens[ends[y] - size[y] : ends[y]]
                at = np.minimum(np.searchsorted(other, sets[x]), len(other) - 1)
                near[k] = np.count_nonzero(other[at] == sets[x]) >= needed(size[x], size[y])
            todo.extend(left[near].tolist())
            out += [(int(names[x]), int(names[y])) for y in left[near]]
            left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, set, tokens) in the order of buckets: verified links of each bucket, one at a time."""
    now, names, sets = None, [], []

    def done():
        found = forest(np.array(names), sets) if len(names) > 1 else []
        if found:
            x, y = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for b in batches:
        for bucket, name, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if bucket != now:
                yield from done()
                now, names, sets = bucket, [], []
            names.append(name)
            sets.append(np.frombuffer(tokens.as_py(), np.uint64))
    yield from done()


def links(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, str]:
    """(a, b): links that connect all distinct sets of prints as all pairs at 0.8 or more would; and where they lie."""
    spark = docs.sparkSession
    keyed = prints.select(F.explode("_bands").alias("key"), "_set").repartition(partitions(spark), "key")
    members, path = materialize(map_arrow(keyed, _buckets, "bucket long, _set long").distinct(), "near-buckets")
    text = prints.join(members.select("_set").distinct(), "_set", "left_semi").groupBy("_set").agg(F.min("_text").alias("_text"))
    wanted = spark.sparkContext.broadcast(spots(text.select("_text")))  # bits of a filter of fixed size

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(_set(wanted.value, b.column(1).to_numpy(zero_copy_only=False)))
            sets = [shingles(t.as_py()) for t in b.column(0).take(pa.array(keep))]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["_set", "tokens"])

    sets = map_arrow(docs.select("text", F.xxhash64("text").alias("_text")), tokens, "_set long, tokens binary").dropDuplicates(["_set"])
    whole = members.join(sets, "_set").select("bucket", "_set", "tokens").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    found, kept = materialize(map_arrow(whole, _links, "a long, b long"), "near-links")
    drop(spark, path)
    return found, kept


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, or one without doc_id where no row has one."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints, path = materialize(map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), _signed, f"doc_id {kind}, _text long, _fp long, _set long, _bands array<long>"), "near")
    found, links_path = links(docs, prints)
    same, alike_path = materialize(alike(prints), "near-alike")
    roots = components(found.union(same), "near")
    whole = prints.select("doc_id", "_text", "_set").join(roots.select(F.col("node").alias("_set"), "root"), "_set", "left").withColumn("root", F.coalesce("root", "_set"))
    best = whole.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "_text")).alias("best"))
    keep, _ = materialize(best.select("best.doc_id", "best._text"), "near-keep")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._text") == F.col("r._text"))
    again = not prints.alias("l").join(keep.alias("r"), same, "left_semi").groupBy("doc_id", "_text").count().filter("count > 1").isEmpty()
    drop(spark, path, links_path, alike_path)
    mark = "_text"
    while mark.lower() in map(str.lower, docs.columns):  # a column of the input may have any name
        mark += "_"
    rows = docs.withColumn(mark, F.xxhash64("text"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.{mark}") == F.col("r._text"))
    kept = rows.alias("l").join(keep.alias("r"), same, "left_semi").select(rows.columns)
    if again:
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)
