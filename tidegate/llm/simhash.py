"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 meet where balls around them overlap. A ball of radius 2 holds 2081 of the 64-bit
words, too many to shuffle for each document; and half of 3 is no whole number. So the 64 bits are dealt into three
blocks, and the meeting takes place three times, with one block left out each time: of 3 differing bits the fullest
block holds at least one, and without that block the radius is 2. Half of it is 1: every fingerprint emits, for each
block left out, itself and all its one-bit variants on the bits that remain: 42 + 1, 43 + 1 and 43 + 1, 131 in all.
Fingerprints are shuffled on these variants, deduplicated first (one row for each distinct fingerprint, whatever the
number of documents), and pairs that collide are verified on all 64 bits. A bucket emits a spanning forest of its
verified links, never all its pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other.
Null doc_id: the row gets its component, but gives it no name; a component of such rows only has a null component_id.
Repeated rows give repeated rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, map_arrow, materialize, partitions, read

RADIUS = 3
BLOCKS = ((0, 22), (22, 43), (43, 64))  # bit ranges


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash, as a signed integer, over the word shingles' XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        start = np.concatenate([[0], stop[:-1]])
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(start[: len(words) - size + 1].tolist(), (stop[size - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(raw: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):  # bounds the unpacked bits
        ones += np.unpackbits(raw[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, size: int = 3, name: str = "_fp") -> DataFrame:
    """docs and a column _fp (long); the columns pass through."""
    names = docs.columns
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            got = pa.array([fingerprint(t.as_py(), size) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*names, name])

    return map_arrow(docs, run, schema)


def variants() -> list[tuple[int, int]]:
    """(bits kept, bits flipped) of each variant; the block left out carries a mark of which block it is."""
    out = []
    for low, high in BLOCKS:
        kept = ((1 << 64) - 1) ^ ((1 << high) - (1 << low))
        out += [(_signed(kept), _signed((1 << low) | (0 if bit is None else 1 << bit))) for bit in [None, *(b for b in range(64) if not low <= b < high)]]
    return out


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the distinct fingerprints of one bucket: breadth-first, each search over those not yet reached."""
    left = prints.view(np.uint64)
    out = []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                todo.extend(found)
                out += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, which has whole buckets: verified links of each."""
    keys, prints = [], []
    for b in batches:
        keys.append(b.column(0).to_numpy(zero_copy_only=False))
        prints.append(b.column(1).to_numpy(zero_copy_only=False))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(prints)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    two = first[count == 2]
    a, b = fp[two], fp[two + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
    found = set(zip(a[near].tolist(), b[near].tolist(), strict=True))
    for at, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        found.update(forest(np.unique(fp[at : at + n])))
    if found:
        x, y = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column _fp) as all pairs within RADIUS would."""
    spark = prints.sparkSession
    masks = ", ".join(f"struct({k}L as k, {f}L as f)" if k != -(1 << 63) else "" for k, f in variants()).replace(f"{-(1 << 63)}L", "shiftleft(1L, 63)")
    emitted = prints.select("_fp").distinct().repartition(partitions(spark), "_fp").select(F.explode(F.expr(f"transform(array({masks}), m -> (_fp & m.k) ^ m.f)")).alias("v"), "_fp")
    return map_arrow(emitted.repartition(partitions(spark), "v"), _links, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(_fp, component_id) of each distinct fingerprint of prints (doc_id, _fp)."""
    first = prints.groupBy("_fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints), "simhash")
    whole = first.join(roots.select(F.col("node").alias("_fp"), "root"), "_fp", "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return whole.join(least, "root").select("_fp", "component_id")


def hexed(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs."""
    prints, _ = materialize(with_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "_fp"), "simhash")
    found, _ = materialize(groups(prints), "simhash-groups")
    return prints.join(found, "_fp").select("doc_id", hexed("_fp").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of each component: that of the smallest doc_id. Rows without doc_id stay."""
    spark = docs.sparkSession
    prints, path = materialize(with_fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "_fp"), "simhash")
    named = prints.filter("doc_id is not null")
    found = groups(named)
    keep, _ = materialize(named.join(found, "_fp").filter("doc_id = component_id").groupBy("component_id").agg(F.min("_fp").alias("_fp"), F.count("*").alias("rows")).select(F.col("component_id").alias("doc_id"), "_fp", "rows"), "simhash-keep")
    again = not keep.filter("rows > 1").isEmpty()
    drop(spark, path)
    mark = "_fp"
    while mark.lower() in map(str.lower, docs.columns):  # a column of the input may have any name
        mark += "_"
    rows = with_fingerprints(docs, size, mark)
    kept = rows.join(keep.select("doc_id", F.col("_fp").alias(mark)), ["doc_id", mark], "left_semi").select(rows.columns)
    if again:
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.union(rows.filter("doc_id is null")).drop(mark)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
