from pyspark.sql import functions as F

from tidegate.llm import language


def test_quotas():
    assert language.quotas({"a": 1_000_000, "b": 3, "c": 500}, 2400) == {"a": 2355, "b": 3, "c": 41}
    assert language.quotas({"a": 5, "b": 3}, 2400) == {"a": 5, "b": 3}
    many = language.quotas({str(i): 10 for i in range(2400)}, 2400)
    assert sum(many.values()) == 2400 and min(many.values()) == 1


def test_a_rare_language_is_learned(spark):
    """Five rows among 30,000: a sample of 2,400 of all rows has none of these with this id hash."""
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the quick fox number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(100_000 + i, f"zażółć gęślą jaźń {i}", "pl") for i in range(40) if i % 8 == 3], "doc_id long, text string, lang string")
    got = language.by_language(many.union(few), F.lit(True), 2400).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 2395, "pl": 5}
    assert {r.lang for r in language.identify(few, language.train(many.union(few), F.lit(True)), F.lit(True)).select(F.col("lang_pred").alias("lang")).collect()} == {"pl"}
