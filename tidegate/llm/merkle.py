"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups, and proofs.

Leaves are dealt out by ranges of (group, key) and numbered by the counts of the ranges before them. Each run of leaves
that follow one another goes through a mountain-range stack: a node whose run of FANOUT siblings is complete is hashed and
carried one level up, and what cannot be completed within the run is a peak. A run is cut wherever the order breaks, so
the layout of the files is of no matter, and a peak has at most FANOUT ** LEVELS leaves, which is all that a task holds.
Peaks are then merged LEVELS levels at a time, a task for each ancestor: unaligned edges of neighbouring runs meet there,
and a last run of fewer nodes, even one, is hashed as it is, without padding. The roots of the groups are leaves of one
more tree of the same kind.

Each leaf gets its path: for each level the digests to its left and to its right within its run. A path of a leaf is that
within its peak, then the peak's, then the group's; a proof is folded from it by Spark expressions.

Defined results: rows without a key come first in their group, rows without a group first of all groups; rows of one key
are ordered by their digests, and like rows are interchangeable. A null counts as `-`, an empty text as `0:`. An empty table has no
rows and no root. Extra columns, whatever their names, are ignored. Ids that are null count as '' where rows are bent for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bucket_of, map_arrow, materialize, read

FANOUT = 3
LEVELS = 7  # levels between merging steps: a task holds FANOUT ** LEVELS nodes at most
BROADCAST_BYTES = 32 << 20  # paths of peaks, and of groups, that are sent to all tasks; beyond it they meet the leaves in a shuffle
DIGEST_BYTES = 140  # two hexadecimal digests of a level, with what an array of texts needs besides


def digest(*columns: Column) -> Column:
    """Hexadecimal SHA-256 of the values one after the other, each as its UTF-8 length, a colon, and itself, or `-`."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    levels = F.when(F.size(path) > 0, F.sequence(F.lit(0), (F.size(path) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, leaf, lambda a, k: F.sha2(F.concat(F.get(path, 2 * k), a, F.get(path, 2 * k + 1)), 256))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes at a level above n leaves."""
    return -(-n // FANOUT**level)


class Mountains:
    """Stack of one run of leaves. Nodes are (place at their level, digest, places of their first leaf and of the one after their last)."""

    def __init__(self, levels: int = LEVELS):
        self.levels = levels
        self.open: list[list[tuple[int, str, int, int]]] = [[] for _ in range(levels + 1)]
        self.paths: list[list[str]] = []
        self.done: list[tuple[int, int, str, int, int]] = []

    def push(self, place: int, leaf: str) -> None:
        at = len(self.paths)
        self.paths.append([])
        level, node = 0, (place, leaf, at, at + 1)
        while True:
            run = self.open[level]
            run.append(node)
            if level == self.levels:
                return self._flush(level)
            if node[0] % FANOUT != FANOUT - 1:
                return None
            if len(run) < FANOUT:  # the run began before these leaves
                return self._flush(level)
            digests = [x[1] for x in run]
            for k, (_, _, a, b) in enumerate(run):
                sides = ["".join(digests[:k]), "".join(digests[k + 1 :])]
                for path in self.paths[a:b]:
                    path += sides
            node = (node[0] // FANOUT, _hash(digests), run[0][2], node[3])
            run.clear()
            level += 1

    def _flush(self, level: int) -> None:
        self.done += [(level, *x) for x in self.open[level]]
        self.open[level].clear()

    def end(self) -> None:
        for level in range(self.levels, -1, -1):
            self._flush(level)

    def take(self) -> Iterator[tuple[int, int, str | None, list[str]]]:
        """Level and place of its peak, the peak's digest (at the peak's first leaf only) and path of each leaf whose peak is known, in order."""
        if not self.done:
            return
        for level, place, peak, a, b in self.done:
            for j in range(a, b):
                yield level, place, peak if j == a else None, self.paths[j]
        end = self.done[-1][4]
        self.done.clear()
        del self.paths[:end]
        self.open = [[(p, d, a - end, b - end) for p, d, a, b in run] for run in self.open]


def _climb(batches, levels: int):
    """Leaves in order (g, i, leaf) to their paths within their peaks. Other columns stay at their leaves."""
    held: list[pa.RecordBatch] = []
    stack, last, out = Mountains(levels), None, []

    def give(rows):
        # the answers so far belong to the first rows held
        while rows and held:
            b = held[0]
            n = min(b.num_rows, len(rows))
            some, rows = rows[:n], rows[n:]
            head = b.slice(0, n)
            held[0] = b.slice(n)
            if not held[0].num_rows:
                held.pop(0)
            level, place, peak, path = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*head.columns, pa.array(level, pa.int32()), pa.array(place, pa.int64()), pa.array(peak, pa.string()), pa.array(path, pa.list_(pa.string()))],
                [*head.schema.names, "level", "place", "peak", "path"],
            )

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        for g, i, leaf in zip(b.column("g").to_pylist(), b.column("i").to_pylist(), b.column("leaf").to_pylist(), strict=True):
            if last != (g, i - 1):
                stack.end()
                out += stack.take()
                stack = Mountains(levels)
            last = (g, i)
            stack.push(i, leaf)
            if stack.done:
                out += stack.take()
        yield from give(out)
        out = []
    stack.end()
    out += stack.take()
    yield from give(out)


def numbered(leaves: DataFrame, label: str) -> DataFrame:
    """leaves (g, key, leaf, ...) in ranges of their order, with i, the place in the group from 0, and n, the group's size."""
    stored, _ = materialize(leaves, f"{label}-digests")  # the ranges are drawn from it, and no text is read twice
    order = [F.col("g"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ties = stored.withColumn("tie", F.monotonically_increasing_id())  # like rows need not be of one range
    dealt = ties.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranges, _ = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), f"{label}-ranges")
    ranges = ranges.withColumn("range", F.shiftrightunsigned("at", 33))
    counts = ranges.groupBy("g", "range").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("g", "range", "first", before.alias("before"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    return ranges.join(offsets, ["g", "range"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("range", "at", "before", "first")


MERGED = "g string, n long, level int, place long, path array<string>, top_level int, top_place long, top string"


def _merge(top_level: int):
    """Merges the nodes below one ancestor: each node's path up to it, or to the root of the group."""

    def run(t: pa.Table) -> pa.Table:
        g, n = t.column("g")[0].as_py(), t.column("n")[0].as_py()
        given = sorted(zip(t.column("level").to_pylist(), t.column("place").to_pylist(), t.column("peak").to_pylist(), strict=True))
        paths: list[list[str]] = [[] for _ in given]
        nodes: dict[int, tuple[str, list[int]]] = {}
        level, at = given[0][0], 0
        while True:
            while at < len(given) and given[at][0] == level:
                nodes[given[at][1]] = (given[at][2], [at])
                at += 1
            wide = width(n, level)
            if wide == 1 or level == top_level:
                break
            above: dict[int, tuple[str, list[int]]] = {}
            for p in {place // FANOUT for place in nodes}:
                run_of = [nodes[c] for c in range(FANOUT * p, min(FANOUT * p + FANOUT, wide))]
                digests = [d for d, _ in run_of]
                for k, (_, under) in enumerate(run_of):
                    for j in under:
                        paths[j] += ["".join(digests[:k]), "".join(digests[k + 1 :])]
                above[p] = (_hash(digests), [j for _, under in run_of for j in under])
            nodes = above
            level += 1
        rows = [(given[j][0], given[j][1], paths[j], place, d if j == under[0] else None) for place, (d, under) in nodes.items() for j in under]
        levels, places, path, top_place, top = zip(*rows, strict=True)
        m = len(rows)
        return pa.table(
            [pa.array([g] * m, pa.string()), pa.array([n] * m, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(path, pa.list_(pa.string())), pa.array([level] * m, pa.int32()), pa.array(top_place, pa.int64()), pa.array(top, pa.string())],
            names=["g", "n", "level", "place", "path", "top_level", "top_place", "top"],
        )

    return run


def _nodes_at(level: Column) -> Column:
    """Nodes of a group of n leaves at a level, as an expression."""
    power = F.pow(F.lit(float(FANOUT)), level).cast("long")
    return F.floor((F.col("n") + power - 1) / power).cast("long")


def forest(leaves: DataFrame, label: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The trees of all groups of leaves (g, key, leaf, ...; g is a text, not null; leaf a digest).

    Returns the leaves with i, n, level and place of their peaks and path within it, and a table of the peaks: g, level, place,
    path from there to the group's root, and root.
    """
    runs = map_arrow(
        numbered(leaves, label).sortWithinPartitions("g", "i"),
        lambda batches: _climb(batches, levels),
        ", ".join([f"{n} {t}" for n, t in leaves.dtypes] + ["n long", "i long", "level int", "place long", "peak string", "path array<string>"]),
    )
    climbed, _ = materialize(runs, f"{label}-climbed")
    peaks = climbed.filter("peak is not null").select("g", "n", "level", "place", "peak")
    most = climbed.agg(F.max("n")).first()[0] or 0
    steps, top, waiting = [], levels, peaks
    while width(most, top - levels) > 1:
        below = waiting.filter((F.col("level") < top) & (_nodes_at(F.col("level")) > 1))
        ancestor = F.floor(F.col("place") / F.pow(F.lit(float(FANOUT)), F.lit(top) - F.col("level")).cast("long")).cast("long")
        merged = below.withColumn("ancestor", ancestor).groupBy("g", "ancestor").applyInArrow(_merge(top), MERGED)
        step, _ = materialize(merged, f"{label}-merged")
        steps.append(step)
        new = step.filter("top is not null").select("g", "n", F.col("top_level").alias("level"), F.col("top_place").alias("place"), F.col("top").alias("peak"))
        waiting = waiting.filter(F.col("level") >= top).union(new)
        top += levels
    # paths from every node that was merged to its root, the last step first
    roots = peaks.filter(_nodes_at(F.col("level")) == 1)
    for step in steps:
        roots = roots.union(step.filter("top is not null").select("g", "n", F.col("top_level").alias("level"), F.col("top_place").alias("place"), F.col("top").alias("peak")).filter(_nodes_at(F.col("level")) == 1))
    known = roots.select("g", "level", "place", F.array().cast("array<string>").alias("path"), F.col("peak").alias("root"))
    for step in reversed(steps):
        over = known.select("g", F.col("level").alias("top_level"), F.col("place").alias("top_place"), F.col("path").alias("rest"), "root")
        here = step.join(over, ["g", "top_level", "top_place"]).select("g", "level", "place", F.concat("path", "rest").alias("path"), "root")
        known, _ = materialize(known.union(here), f"{label}-paths")
    return climbed, known.join(peaks.select("g", "level", "place"), ["g", "level", "place"])


def _small(df: DataFrame, levels: int) -> DataFrame:
    return F.broadcast(df) if df.count() * (levels + 1) * DIGEST_BYTES <= BROADCAST_BYTES else df


def proofs(rows: DataFrame, label: str = "merkle", levels: int = LEVELS) -> DataFrame:
    """The rows (group text, key, leaf, ...) with subroot, root and path, the siblings of each level from leaf to root.

    Columns of the input but `group` stay; `i` is the place of the row in its group, `n` the size of the group.
    """
    g = F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit(""))  # no group before all groups, which keep their order
    leaves, peaks = forest(rows.select(g.alias("g"), *[c for c in rows.columns if c != "group"]), label, levels)
    peaks, _ = materialize(peaks, f"{label}-peaks")
    groups = peaks.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("leaf")).distinct()
    tops, top_peaks = forest(groups, f"{label}-groups", levels)
    over = tops.select(F.col("key").alias("g"), "level", "place", F.col("path").alias("low")).join(top_peaks.select("level", "place", "path", "root"), ["level", "place"])
    over, _ = materialize(over.select("g", F.concat("low", "path").alias("high"), "root"), f"{label}-tops")
    size = peaks.agg(F.max(F.size("path"))).first()[0] or 0
    high = over.agg(F.max(F.size("high"))).first()[0] or 0
    way = peaks.withColumnRenamed("root", "subroot").join(_small(over, high // 2), "g").select("g", "level", "place", "subroot", "root", F.concat("path", "high").alias("rest"))
    kept = [c for c in rows.columns if c != "group"]
    whole = leaves.join(_small(way, (size + high) // 2), ["g", "level", "place"])
    return whole.select(F.expr("if(g = '', null, substring(g, 2))").alias("group"), *kept, "i", "n", "subroot", "root", F.concat("path", "rest").alias("path"))


def nodes(proved: DataFrame) -> DataFrame:
    """group, level, place, digest of every node of the groups' trees: each is told by the first leaf below it."""
    levels = F.sequence(F.lit(0), F.ceil(F.log(float(FANOUT), F.greatest(F.col("n"), F.lit(1))) + 2).cast("int"))
    each = proved.select("group", "leaf", "path", "i", "n", F.explode(levels).alias("level"))
    first = each.filter((F.col("i") % F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long") == 0) & ((F.col("level") == 0) | (_nodes_at(F.col("level") - 1) > 1)))
    place = F.floor(F.col("i") / F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")).cast("long")
    return first.select("group", "level", place.alias("place"), fold(F.col("leaf"), F.slice("path", F.lit(1), 2 * F.col("level"))).alias("digest"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """group (source), key (doc_id), leaf, and bent: the same leaf, but of a text without line ends in every second row or so."""
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(bucket_of(docs["doc_id"], 2) == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    return docs.select(docs["source"].alias("group"), docs["doc_id"].alias("key"), digest(*fields, docs["text"]).alias("leaf"), digest(*fields, changed).alias("bent"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    proved = proofs(document_leaves(read(spark, sf_dir, "documents")))
    out = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), fold(F.col("bent"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('+' || source, '') AS g, sha256({_FIELDS.format(text="text")}) AS leaf,
         CASE WHEN list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT),
                               lambda c, x: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, x)), 4294967295) % 2 = 1
              THEN sha256({_FIELDS.format(text="replace(text, chr(10), '')")}) ELSE sha256({_FIELDS.format(text="text")}) END AS bent
  FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (
  SELECT g, 0 AS level, i, leaf AS h FROM e
  UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS wide FROM t) x WHERE wide > 1 GROUP BY g, level, i // 3),
top AS (SELECT g, max(level) AS level FROM t GROUP BY g),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t JOIN top USING (g, level)),
u AS (
  SELECT 0 AS level, i, h FROM sub
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS wide FROM u) x WHERE wide > 1 GROUP BY level, i // 3),
n AS (
  SELECT g, level, i, h FROM t
  UNION ALL SELECT g, 1000 + u.level, u.i, u.h FROM u, (SELECT DISTINCT g FROM sub) s),
side AS (
  SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM n a JOIN n b ON b.g = a.g AND b.level = a.level AND b.i // 3 = a.i // 3
  WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.g = a.g AND top.level = a.level) AND a.level <> 1000 + (SELECT max(level) FROM u)
  GROUP BY ALL),
f AS (
  SELECT e.r, e.g, 0 AS level, e.i, e.bent AS h, '' AS proof FROM e
  UNION ALL
  SELECT f.r, f.g, CASE WHEN up THEN 1000 ELSE f.level + 1 END, CASE WHEN up THEN sub.i ELSE f.i // 3 END, CASE WHEN up THEN f.h ELSE sha256(s.l || f.h || s.r) END, CASE WHEN up THEN proof ELSE proof || s.l || s.r END
  FROM (SELECT f.*, top.level IS NOT NULL AS up FROM f LEFT JOIN top ON top.g = f.g AND top.level = f.level) f
  JOIN sub ON sub.g = f.g LEFT JOIN side s ON s.g = f.g AND s.level = f.level AND s.i = f.i
  WHERE up OR s.g IS NOT NULL),
last AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM f GROUP BY r)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, last.h AS folded_root, last.h = root.h AS verified
FROM e JOIN sub USING (g) JOIN last USING (r), (SELECT arg_max(h, level) AS h FROM u) root
"""
