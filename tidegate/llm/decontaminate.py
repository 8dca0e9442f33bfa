"""Benchmark decontamination: a prefix-filtered set join of document words against item-sized windows.

Tokens of the join are shingles of three words. A window (ten consecutive item words; a shorter item is one window) is
contained in a document only if all its shingles are, so one of them is a sufficient prefix, and the rarest gives the
fewest candidates. Shingles are ordered by how often the corpus, counted over all documents, has them. Document positions
join the windows' prefix shingles; a candidate must leave room for the window before and after (positional and length
bounds), and its words are then compared with the window's one by one. Items of one or two words make one shingle of
what they have, and such sizes are only looked for if an item has them.

All of it is DataFrame expressions. The windows are broadcast only if their count is at most BROADCAST_WINDOWS; beyond
that, positions are shuffled by shingle, with the words around them.

Defined results: null text has no words: counts 0, not contaminated; an item without words has no window. Null item_id
never counts as an item, though its windows hit words. Items repeated under one id count once. Repeated document rows
give repeated rows. Extra columns of the input are ignored. Without hits items_sha256 is that of the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop, materialize, read

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000
BROADCAST_ROWS = 100_000  # keys of contaminated rows; more meet the documents in a shuffle
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words of the whole text, lower-cased A-Z only; null or wordless text gives an empty array."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    split = F.split(lower, SEPARATORS)
    # a separator at either end leaves an empty string there, and only there
    return F.array_remove(split, "")


def _shingles(column: str, sizes: list[int]) -> Column:
    """(size, position from 0, hash) of every shingle of the given sizes."""

    def of(k: int) -> str:
        inside = ", ".join(f"{column}[i + {j}]" for j in range(k))
        return f"if(size({column}) >= {k}, transform(sequence(0, size({column}) - {k}), i -> xxhash64({k}, {inside})), array())"

    return F.array(*[F.expr(of(k)) for k in sizes])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, win (the words) of every window, each once for an item."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    every = F.expr(f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> slice(w, i, {size}))")
    return w.select("item_id", F.explode(every).alias("win")).distinct()


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """row, w, p (position), s (hash): a row for every shingle of every document."""
    d = docs.select("row", words(F.col("text")).alias("w"))
    d = d.select("row", "w", F.size("w").alias("n_w"), _shingles("w", sizes).alias("s"))
    parts = [d.select("row", "w", F.posexplode(F.col("s")[i]).alias("p", "s")) for i in range(len(sizes))]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """row, at (position from 0), n (words), item_id: every occurrence of every window in docs (row, text)."""
    spark = docs.sparkSession
    wins, wins_path = materialize(windows(items, size), "windows")
    number = wins.count()
    small = number <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    sizes = sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    if not sizes:
        drop(spark, wins_path)
        return docs.select("row", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)

    one = F.expr("case " + " ".join(f"when least(size(win), {SHINGLE}) = {k} then transform(sequence(0, size(win) - {k}), i -> xxhash64({k}, {', '.join(f'win[i + {j}]' for j in range(k))}))" for k in sizes) + " end")
    shingles = wins.select("win").distinct().select("win", F.posexplode(one).alias("offset", "s"))
    keys = shingles.select("s").distinct()
    positions = _positions(docs, sizes)
    # how often the corpus has each of the items' shingles
    counts = positions.select("s").join(hint(keys), "s").groupBy("s").agg(F.count("*").alias("c"))
    rare, rare_path = materialize(
        shingles.join(hint(counts), "s", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "s", "offset")).alias("least"), F.count("*").alias("all"), F.count("c").alias("found"))
        .filter("`all` = found")  # a shingle that no document has: nor the window
        .select(F.col("least.s").alias("s"), F.struct("win", F.col("least.offset").alias("offset")).alias("x"))
        .groupBy("s")
        .agg(F.collect_list("x").alias("xs")),
        "prefixes",
    )
    reach = size + SHINGLE
    if small:
        found = positions.join(F.broadcast(rare), "s")
        held = "filter(xs, x -> p >= x.offset and p - x.offset + size(x.win) <= size(w) and slice(w, p - x.offset + 1, size(x.win)) = x.win)"
    else:
        near = positions.select("row", "p", "s", F.least("p", F.lit(reach)).alias("back"), F.expr(f"slice(w, p - least(p, {reach}) + 1, {2 * reach})").alias("w"))
        found = near.join(rare, "s")
        held = "filter(xs, x -> p >= x.offset and back - x.offset + size(x.win) <= size(w) and slice(w, back - x.offset + 1, size(x.win)) = x.win)"
    hits = found.select("row", "p", F.explode(F.expr(held)).alias("x")).select("row", (F.col("p") - F.col("x.offset")).alias("at"), F.size("x.win").alias("n"), F.col("x.win").alias("win"))
    return hits.join(hint(wins), "win").select("row", "at", "n", "item_id")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    row = F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l"))
    named = docs.select("doc_id", "text", row.alias("row"))
    hits, _ = materialize(find(named, items, size, broadcast_windows), "hits")
    per = summary(hits)
    return (
        named.select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        .join(per, F.col("row").eqNullSafe(F.col("hit_row")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def summary(hits: DataFrame) -> DataFrame:
    """hit_row, n_hit, n_items, items_sha256 of each row that has hits: words under the union of the occurrences."""
    # the intervals of a row, longest at each place, in order: a fold of what each adds beyond those before
    places = hits.groupBy("row", "at").agg(F.max("n").alias("n")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("o"))
    hit = places.select("row", F.expr("aggregate(o, struct(0L as c, 0 as e), (a, x) -> struct(a.c + greatest(0, x.at + x.n - greatest(a.e, x.at)) as c, greatest(a.e, x.at + x.n) as e), a -> a.c)").alias("n_hit"))
    items = hits.filter("item_id is not null").select(F.col("row").alias("r"), "item_id").distinct().groupBy("r").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("i"))
    return hit.join(items, F.col("row").eqNullSafe(F.col("r")), "left").select(F.col("row").alias("hit_row"), "n_hit", F.coalesce(F.size("i"), F.lit(0)).alias("n_items"), F.sha2(F.array_join(F.coalesce("i", F.array().cast("array<string>")), ","), 256).alias("items_sha256"))


def clean(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of docs, with their columns, of which a share of at most `most` of the words is hit."""
    row = F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h"), F.length(docs["text"]).alias("l"))
    hits, _ = materialize(find(docs.select("text", row.alias("row")), items), "hits")
    per = summary(hits)
    if most > 0:
        size = docs.select(row.alias("row"), F.size(words(docs["text"])).alias("n_words")).distinct()
        per = per.join(size, F.col("hit_row").eqNullSafe(F.col("row"))).filter(F.col("n_hit") > most * F.col("n_words"))
    bad, _ = materialize(per.select(F.col("hit_row.doc_id").alias("d"), F.col("hit_row.h").alias("h"), F.col("hit_row.l").alias("l")).distinct(), "bad")
    bad = (F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad).alias("bad")
    # the row travels as one column, so that names of the input's columns are of no matter
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), row.alias("row")).alias("m")
    found = F.col("m.row.doc_id").eqNullSafe(F.col("bad.d")) & (F.col("m.row.h") == F.col("bad.h")) & F.col("m.row.l").eqNullSafe(F.col("bad.l"))
    return marked.join(bad, found, "left_anti").select("whole.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (
  SELECT r, n, s, w[s : s + n - 1] AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.r, g.s, g.n, win.item_id FROM g JOIN win ON g.k = win.k),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
