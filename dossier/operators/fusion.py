"""Reciprocal rank fusion of ranked signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAMPING = 60
POOL = 3  # candidates of each signal, as a multiple of k
ORDER = ("semantic", "lexical", "graph", "timeline")


def fuse(signals: dict[str, DataFrame], key: str, k: int) -> DataFrame:
    """(query_id, key, score, signals, places, rank): the k best items of each query, with the signals that have them and their ranks there.

    Each signal is (query_id, key, rank). The score is the sum of 1 / (60 + rank) in signal
    order; ties go to the item that the earlier signal ranks higher.
    """
    tagged = [df.select("query_id", key, F.lit(ORDER.index(name)).alias("signal"), F.col("rank").cast("int").alias("rank")) for name, df in signals.items()]
    grouped = reduce(DataFrame.union, tagged).groupBy("query_id", key).agg(F.sort_array(F.collect_list(F.struct("signal", "rank"))).alias("ranks"))
    score = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + F.lit(1.0) / (r["rank"] + DAMPING))
    names = F.array(*(F.lit(n) for n in ORDER))
    scored = grouped.select("query_id", key, score.alias("score"), F.element_at("ranks", 1).alias("first"), F.array_join(F.transform("ranks", lambda r: F.get(names, r["signal"])), ",").alias("signals"), F.array_join(F.transform("ranks", lambda r: r["rank"].cast("string")), ",").alias("places"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "first", key)
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", key, "score", "signals", "places", "rank")
