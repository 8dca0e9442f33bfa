"""Quality rules: word statistics of whole texts, and an ordered decision list learned from labelled statistics.

Everything on the main path is a DataFrame or SQL expression. The learner (sequential covering) never sees a row:
each growing step asks Spark for the class histogram, per feature and bin, of the labelled rows that the rules so far
leave uncovered and that the growing conjunction still holds; the driver gets FEATURES x BINS rows of two counts.

Defined results: null text has no words, so all counts are 0, base_failed is true and kept false; empty text likewise.
Repeated rows give repeated rows. Extra columns of the input are ignored. Without labels the list is empty and every
text that passes the base rules is kept. Labels of one id that differ count as votes of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, drop, materialize, read

WINDOW = 5
BINS = 24
FEATURES = ("repeat_share", "symbols_per_word", "dup_line_share", "upper_share", "mark_share", "mean_word", "distinct_share", "n_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # '>' or '<='
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.bound) if self.op == ">" else F.col(self.feature) <= F.lit(self.bound)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{c.feature} {c.op} {c.bound:.6g}" for c in self.conditions)


def statistics(docs: DataFrame, key: Column | str = "doc_id") -> DataFrame:
    """key (as doc_id), COUNTS and FEATURES of each row's whole text; no shuffle, one pass over the words.

    n_repeat_words: the 5-word windows are compared as joined strings, so two are equal only if their words are.
    Only texts in which array_distinct loses a window sort their (window, position) pairs to find the covered words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    d = docs.select(key, text.alias("text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("w"))
    d = d.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?.,;:\\p{N}]")).cast("long").alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
    )
    shingles = F.when(F.col("n_words") >= WINDOW, F.expr(f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> array_join(slice(w, i, {WINDOW}), ' '))")).otherwise(F.array().cast("array<string>"))
    d = d.select("*", shingles.alias("s"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct_lines"), F.size(F.array_distinct("w")).alias("n_distinct"))
    d = d.drop("lines").select("*", (F.size(F.array_distinct("s")) < F.size("s")).alias("again"))
    pairs = F.when(F.col("again"), F.sort_array(F.transform("s", lambda x, i: F.struct(x.alias("k"), i.alias("p")))))
    d = d.select("*", pairs.alias("o"))
    repeated = F.expr("sort_array(transform(filter(transform(o, (x, i) -> struct(x.p as p, (i > 0 and o[i - 1].k = x.k) or (i < size(o) - 1 and o[i + 1].k = x.k) as d)), x -> x.d), x -> x.p))")
    d = d.select("*", F.when(F.col("again"), repeated).alias("r"))
    covered = F.expr(f"aggregate(r, struct(0L as n, -{WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)")
    d = d.select("*", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long").alias("n_repeat_words"), (F.col("n_lines") - F.col("n_distinct_lines")).cast("long").alias("n_dup_lines"))
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return d.select(
        "doc_id",
        *COUNTS,
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_upper") / c).alias("upper_share"),
        (F.col("n_marks") / c).alias("mark_share"),
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_distinct") / n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.filter("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return stats.filter("doc_id is not null").select("doc_id", *FEATURES).join(marks, "doc_id").select(*FEATURES, "bad")


def _bounds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature within either class."""
    shares = [i / (BINS // 2) for i in range(1, BINS // 2)] + [0.01, 0.99]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 2000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(v) for r in got for v in r[f] or []}) for f in FEATURES}


def _histogram(rows: DataFrame, bounds: dict[str, list[float]], split: Column) -> dict[tuple[bool, str], list[tuple[int, int]]]:
    """Per half and feature, (bad, good) of each bin: bin i holds bounds[i-1] < value <= bounds[i]."""

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds[f])), lambda b: b < F.col(f)))

    one = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES if bounds[f]])
    out = {(half, f): [(0, 0)] * (len(bounds[f]) + 1) for f in FEATURES for half in (True, False)}
    for r in rows.select("bad", split.alias("half"), F.explode(one).alias("x")).groupBy("half", "x.f", "x.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect():
        out[r["half"], r["f"]][r["b"]] = (r["bad"], r["good"])
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    from math import log2

    return p * (log2((p + 0.5) / (p + n + 1)) - log2((p0 + 0.5) / (p0 + n0 + 1)))


def learn(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_bad: int = 4, purity: float = 0.9) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the uncovered rows, prune it on the rest, repeat.

    Stops when no rule of at least `purity` (Laplace-corrected, on all uncovered rows) covers `least_bad` bad rows.
    The halves come from a hash of the features, so a run gives the same rules at any partitioning.
    """
    if rows.isEmpty():
        return []
    bounds = _bounds(rows)
    split = F.pmod(F.xxhash64(*FEATURES), F.lit(3)) != 0
    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        grown: list[Condition] = []
        held = left
        steps: list[tuple[tuple[int, int], tuple[int, int]]] = []  # (growing, pruning) counts after each condition
        for _ in range(max_conditions):
            seen = _histogram(held, bounds, split)
            p0, n0 = (sum(x[k] for x in seen[True, FEATURES[0]]) for k in (0, 1))
            if not p0 or (grown and not n0):
                break
            best = None
            for f in FEATURES:
                bins, check = seen[True, f], seen[False, f]
                for i, bound in enumerate(bounds[f]):
                    for op, part, other in ((">", bins[i + 1 :], check[i + 1 :]), ("<=", bins[: i + 1], check[: i + 1])):
                        p, n = sum(x[0] for x in part), sum(x[1] for x in part)
                        g = _gain(p, n, p0, n0)
                        if p >= min(least_bad, p0) and g > 1e-9 and (best is None or g > best[0] + 1e-9):
                            best = (g, Condition(f, op, bound), (p, n), (sum(x[0] for x in other), sum(x[1] for x in other)))
            if best is None:
                break
            grown.append(best[1])
            steps.append((best[2], best[3]))
            held = held.filter(best[1].column())
        if not grown:
            break
        # prune: the shortest prefix that is best on the pruning rows, (p - n) / (p + n)
        keep = max(range(len(grown)), key=lambda k: ((steps[k][1][0] - steps[k][1][1]) / max(1, sum(steps[k][1])), -k)) + 1
        (p, n), (q, m) = steps[keep - 1]
        rule = Rule(tuple(grown[:keep]), p + q, n + m)
        if rule.bad < least_bad or (rule.bad + 1) / (rule.bad + rule.good + 2) < purity:
            break
        rules.append(rule)
        left = left.filter(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered decision list as one conditional expression: the number of the first rule that rejects, else 0."""
    out = F.lit(None).cast("int")
    for i, rule in enumerate(rules):
        out = F.when(rule.column(), F.lit(i + 1)) if not i else out.when(rule.column(), F.lit(i + 1))
    return F.coalesce(out, F.lit(0))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, rule (which rule rejected, else 0) for each row of docs."""
    stats, _ = materialize(statistics(docs), "quality")
    rows, path = materialize(labelled(stats, labels), "quality-labelled")
    rules = learn(rows)
    drop(stats.sparkSession, path)
    rule = verdict(rules)
    return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns: they travel with their statistics, as one column."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc_id")
    stats, _ = materialize(statistics(docs, whole), "quality")
    rows, path = materialize(labelled(stats.select(F.col("doc_id.doc_id").alias("doc_id"), *FEATURES), labels), "quality-labelled")
    rules = learn(rows)
    drop(docs.sparkSession, path)
    return stats.filter(~base_failed() & (verdict(rules) == 0)).select("doc_id.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
