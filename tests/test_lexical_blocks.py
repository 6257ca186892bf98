"""Full-text search over packed blocks."""

from pyspark.sql import functions as F

from dossier.functions.text import text_features
from dossier.operators import blocks, lexical, search

ASK = "ask_id string, query string, company_id string, kinds array<string>"


def test_a_common_term_passes_on_no_more_than_the_limit(spark):
    texts = spark.range(200, numPartitions=2).select(F.format_string("k%03d", "id").alias("item_id"), F.when(F.col("id") == 150, "margin margin").otherwise("margin call").alias("text"))
    asks = spark.createDataFrame([("q", "the margin", None, None), ("r", "margin call", None, None), ("s", "absent", None, None)], ASK)
    words = lexical.vocabulary(asks)
    held = blocks.pack(text_features(texts, "text", "item_id", vectors=False, vocabulary=words), 10)
    passed = lexical.tops(asks, held, words, 3)
    assert passed.groupBy("ask_id").count().where("count > 6").isEmpty()
    best = search.by_terms(asks, held, words, 3)
    assert {(r["ask_id"], r["rank"], r["chunk_id"]) for r in best.collect()} == {("q", 1, "k150"), ("q", 2, "k000"), ("q", 3, "k001"), ("r", 1, "k000"), ("r", 2, "k001"), ("r", 3, "k002")}
