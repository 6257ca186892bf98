"""Company names that a plan enters, by containment, alias or ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_names(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(entry, company_id): the first company whose name contains an entry of four letters or more, or that has any entry as alias or ticker.

    ``entries(entry)``, ``listed(company_id, name, tickers, aliases)``. A name contains an entry only if it contains the entry's
    first four letters, so the pairs to compare come from an equality join on these. Letter case matters for aliases only.
    """
    entries = entries.where("trim(entry) <> ''").select("entry").distinct()
    listed = listed.select("company_id", F.lower("name").alias("name"), "aliases", "tickers")
    grams = listed.select("company_id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 3, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(4))))).alias("gram"))
    inside = entries.where("length(trim(entry)) >= 4").withColumn("gram", F.substring(F.lower("entry"), 1, 4)).join(grams, "gram").where(F.contains("name", F.lower("entry"))).select("entry", "company_id")
    alias = listed.select("company_id", F.explode("aliases").alias("entry")).select("entry", "company_id")
    ticker = listed.select("company_id", F.explode("tickers").alias("t"))
    by_ticker = entries.join(ticker, F.upper("entry") == F.col("t")).select("entry", "company_id")
    return inside.union(entries.join(alias, "entry").select("entry", "company_id")).union(by_ticker).groupBy("entry").agg(F.min("company_id").alias("company_id"))
