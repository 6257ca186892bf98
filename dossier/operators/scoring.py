"""Source scores and confidence, as column expressions with an explicit point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quality of document types, and the weights of the scores' parts.
TIERS = {"filing": 1.0, "transcript": 0.9, "news": 0.6, "profile": 0.4}
OTHER_TIER = 0.5
RANK_WEIGHTS = {"authority": 0.30, "freshness": 0.25, "independence": 0.20, "corroboration": 0.25}
CONFIDENCE_WEIGHTS = {"diversity": 0.25, "documents": 0.15, "quality": 0.20, "recency": 0.15, "agreement": 0.25}
HALF_LIFE_DAYS, SATURATION, HORIZON_DAYS = 180, 5, 365


def tier(doc_type: Column) -> Column:
    column = F.lit(OTHER_TIER)
    for name, value in TIERS.items():
        column = F.when(doc_type == name, value).otherwise(column)
    return column


def source_score(doc_type: Column, published: Column, corroborating: Column, publishers: Column, as_of: str) -> Column:
    """Weighted sum of authority, freshness, independence and corroboration; an undated document counts as half fresh."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), published))
    freshness = F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS), F.lit(0.5))
    corroboration = F.least(corroborating / SATURATION, F.lit(1.0))
    independence = F.when(corroborating > 0, F.least(publishers / corroborating, F.lit(1.0))).otherwise(0.0)
    w = RANK_WEIGHTS
    return w["authority"] * tier(doc_type) + w["freshness"] * freshness + w["independence"] * independence + w["corroboration"] * corroboration


def confidence(evidence: DataFrame, as_of: str) -> DataFrame:
    """Five parts and their weighted sum per investigation of ``evidence(investigation_id, document_id, source, doc_type, published, stance, review)``.

    Rejected evidence is left out. Without dated documents, recency is 0; without supporting or
    contradicting evidence, agreement is 0.5.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.col("published"))
    for_, against = F.count_if(F.col("stance") == "supporting"), F.count_if(F.col("stance") == "contradicting")
    parts = (
        evidence.where("review is null or review <> 'rejected'")
        .groupBy("investigation_id")
        .agg(
            F.least(F.countDistinct("source") / 3, F.lit(1.0)).alias("diversity"),
            F.least(F.countDistinct("document_id") / 5, F.lit(1.0)).alias("documents"),
            F.avg(tier(F.col("doc_type"))).alias("quality"),
            F.coalesce(F.try_divide(F.count_if(age <= HORIZON_DAYS), F.count("published")), F.lit(0.0)).alias("recency"),
            F.coalesce(F.try_divide(for_, for_ + against), F.lit(0.5)).alias("agreement"),
        )
    )
    return parts.withColumn("score", sum((F.col(n) * w for n, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0)))
