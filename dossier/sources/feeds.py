"""Feed and registry files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import alias_of

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "pubDate", "description")])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """(native_id, title, url, published_at, body) of an RSS file's items.

    The id is the guid, or else the link. Items without id, or with neither title nor content,
    are left out. The body is the title as a heading, then the content.
    """
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    body = F.concat(F.lit("<h1>"), F.coalesce("title", F.lit("")), F.lit("</h1>\n"), F.coalesce("description", F.lit("")))
    rows = items.select(F.coalesce("guid", "link").alias("native_id"), "title", F.col("link").alias("url"), F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")).alias("published_at"), body.alias("body"), "description")
    return rows.where("native_id is not null and (title is not null or description is not null)").drop("description")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(cik, name, tickers, aliases) of a registry file: a JSON object of numbered entries, several per CIK."""
    entry = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("m"))
    rows = whole.select(F.explode("m").alias("k", "e")).select(F.col("k").cast("int").alias("pos"), F.col("e.cik_str").cast("string").alias("cik"), "e.ticker", "e.title")
    grouped = rows.groupBy("cik").agg(F.min_by("title", "pos").alias("name"), F.sort_array(F.collect_list(F.struct("pos", "ticker"))).alias("t"))
    return grouped.select("cik", "name", F.transform("t", lambda x: x["ticker"]).alias("tickers"), F.array_compact(F.array(alias_of(F.col("name")))).alias("aliases"))


def read_filings(filings: DataFrame, forms: list[str], most: int = 5) -> DataFrame:
    """(cik, form, accession, primary, date, url): the first ``most`` wanted filings of each company.

    ``filings(cik, body)`` holds JSON with parallel arrays; entries without primary document are
    left out, and so is a company whose body cannot be read.
    """
    recent = "struct<form: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, filingDate: array<string>>"
    parsed = filings.select("cik", F.from_json("body", f"struct<filings: struct<recent: {recent}>>").alias("b")).select("cik", "b.filings.recent.*")
    rows = parsed.select("cik", F.posexplode(F.arrays_zip("form", "accessionNumber", "primaryDocument", "filingDate")).alias("pos", "f")).select("cik", "pos", "f.*")
    wanted = rows.where(F.col("form").isin(forms) & (F.col("primaryDocument") != ""))
    kept = wanted.withColumn("n", F.row_number().over(W.partitionBy("cik").orderBy("pos"))).where(F.col("n") <= most)
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.regexp_replace("accessionNumber", "-", ""), F.lit("/"), F.col("primaryDocument"))
    return kept.select("cik", "form", F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("primary"), F.to_date("filingDate").alias("date"), url.alias("url"))


def write_content_addressed(pages: DataFrame, folder: str) -> None:
    """Append ``pages(content binary)`` under its SHA-256, split by the first two digits; content that is there stays."""
    spark = pages.sparkSession
    fresh = pages.select(F.sha2("content", 256).alias("checksum"), "content").dropDuplicates(["checksum"]).withColumn("prefix", F.substring("checksum", 1, 2))
    try:
        fresh = fresh.join(spark.read.parquet(folder).select("checksum"), "checksum", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    fresh.write.mode("append").partitionBy("prefix").parquet(folder)
