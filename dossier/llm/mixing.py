"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: its target number of tokens over the tokens it has. A
document's number of copies is the quantile of a Poisson variable at a uniform number that
comes from a hash of the document and the seed, cut off at the source's cap; the parameter of
the Poisson distribution is chosen so that the mean of the cut-off variable is the rate. Copies
are ordered by a second hash, which is a global shuffle that can be repeated exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.tokens import document_tokens
from dossier.session import cut_lineage, read_table, spread


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(X, cap) for a Poisson variable X."""
    below = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(cap)] if rate > 0 else [1.0, *([0.0] * (cap - 1))]
    return cap - sum((cap - k) * p for k, p in enumerate(below))


def thresholds(mean: float, cap: int) -> list[float]:
    """P(X <= k) for k < cap, of the Poisson variable whose cut-off mean is ``mean``; copies = how many the uniform number reaches."""
    if mean <= 0 or cap <= 0:
        return []
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < mean else (low, middle)
    total, result = 0.0, []
    for k in range(cap):
        total += math.exp(k * math.log(high) - high - math.lgamma(k + 1))
        result.append(total)
    return result


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def mixing_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, tuple[float, int]]:
    """(rate, cap) of each source that has tokens and a target.

    Shares are taken among these sources. Without ``total_tokens``, the mixture is the largest
    one in which every source reaches its share within its cap.
    """
    present = {s: (w, c) for s, (w, c) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and c > 0}
    weight = sum(w for w, _ in present.values())
    if total_tokens is None:
        total_tokens = min((c * sizes[s] * weight / w for s, (w, c) in present.items()), default=0)
    return {s: (min(float(c), w / weight * total_tokens / sizes[s]), c) for s, (w, c) in present.items()}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """Copies of ``documents(doc_id, source, tokens)``: (doc_id, source, tokens, copy, place), ordered by ``place``.

    ``targets(source, target_share, max_repeats)`` is a small table with one row per source
    (repeated rows count once; NULL shares or caps count as 0). Sources without a target,
    targets without documents, and documents of NULL source give no copies. A document without
    tokens is drawn like any other. Empty tables give an empty mixture.
    """
    # one row per source of a fixed table, and sums by those sources
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().collect()}
    listed = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    sizes = {r["source"]: int(r["n"] or 0) for r in listed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    copies = F.lit(0)
    for source, (rate, cap) in mixing_rates(sizes, wanted, total_tokens).items():
        u = uniform(F.lit(seed), F.col("doc_id"))
        steps = thresholds(rate, cap)
        copies = F.when(F.col("source") == source, sum((F.when(u >= t, 1).otherwise(0) for t in steps), F.lit(0))).otherwise(copies)
    drawn = listed.withColumn("copies", copies).where("copies > 0")
    repeated = drawn.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("place", "doc_id", "copy")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: copies, tokens, target share and the share of all tokens reached (0 for an absent source)."""
    sums = cut_lineage(mixture.groupBy("source").agg(F.count("*").alias("copies"), F.countDistinct("doc_id").alias("documents"), F.max("copy").alias("most_copies"), F.sum("tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return targets.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_copies", "tokens")),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("reached_share"),
    )


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The selected copies of documents, globally shuffled."""
    sizes = cut_lineage(document_tokens(spread(read_table(spark, folder, "documents").select("doc_id", "document_id", "source", "text"))))
    return mix(sizes, read_table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return shares(p7_mix(spark, folder), read_table(spark, folder, "mix_targets"))
