"""Queries of ingestion: sightings, registry, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import views
from dossier.functions.text import SUFFIX, alias_of, words_of
from dossier.session import read_table
from dossier.sources.html import html_to_text
from dossier.view_sql import with_views


REGISTERED_FROM, STORED_UNTIL = "2021-11-30 00:00:00", "2021-12-12 00:00:00"


def ingest_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Sightings per source: all, distinct, and those of documents not ingested yet."""
    refs = read_table(spark, folder, "document_refs").select("source", "native_id")
    have = read_table(spark, folder, "documents").select("source", F.col("source_native_id").alias("native_id"), F.lit(True).alias("known")).distinct()
    counted = refs.groupBy("source", "native_id").agg(F.count("*").alias("n")).join(have, ["source", "native_id"], "left")
    return counted.groupBy("source").agg(F.sum("n").alias("seen"), F.count("*").alias("distinct_refs"), F.count_if(F.col("known").isNull()).alias("new"))


def new_references(spark: SparkSession, folder: str) -> DataFrame:
    """The first sighting of every document that isn't ingested."""
    refs = read_table(spark, folder, "document_refs")
    have = read_table(spark, folder, "documents").select("source", F.col("source_native_id").alias("native_id")).distinct()
    return views.latest(refs.join(have, ["source", "native_id"], "left_anti"), ["source", "native_id"], "discovered_at", "ref_id").select("source", "native_id", "ref_id")


def registry_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """What an upsert of the registry, grouped by CIK with derived aliases, changes in the stored companies.

    The store holds the companies created before ``STORED_UNTIL``, the registry those since ``REGISTERED_FROM``.
    """
    listed = views.companies(spark, folder).where("cik is not null")
    rows = listed.where(F.col("created_at") >= F.lit(REGISTERED_FROM).cast("timestamp")).select("cik", "name", F.posexplode_outer("tickers").alias("pos", "ticker"))
    registry = rows.groupBy("cik").agg(F.min_by("name", F.coalesce("pos", F.lit(0))).alias("name"), F.sort_array(F.collect_list(F.when(F.col("ticker").isNotNull(), F.struct("pos", "ticker")))).alias("t"))
    fresh = registry.select("cik", "name", F.array_join(F.transform("t", lambda x: x["ticker"]), ",").alias("tickers"), alias_of(F.col("name")).alias("alias"))
    stored = listed.where(F.col("created_at") < F.lit(STORED_UNTIL).cast("timestamp"))
    old = stored.select("cik", F.col("name").alias("old_name"), F.array_join("tickers", ",").alias("old_tickers"), F.get("aliases", F.lit(0)).alias("old_alias"))
    same = F.col("name").eqNullSafe(F.col("old_name")) & F.col("tickers").eqNullSafe(F.col("old_tickers")) & F.col("alias").eqNullSafe(F.col("old_alias"))
    change = F.when(F.col("old_name").isNull(), "created").when(F.col("name").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return fresh.join(old, "cik", "full").select("cik", "alias", "tickers", change.alias("change"))


def filing_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest filings of every publisher."""
    filings = views.documents(spark, folder).where("doc_type = 'filing' and publisher is not null").select("document_id", "publisher").join(views.published(spark, folder), "document_id")
    place = F.row_number().over(W.partitionBy("publisher").orderBy(F.desc("published"), "document_id")).cast("long")
    return filings.withColumn("place", place).where("place <= 5").select("publisher", "place", "document_id")


def filing_path(spark: SparkSession, folder: str) -> DataFrame:
    """Archive paths of filings: leading zeros off the feed number, dashes off the rest."""
    filings = views.documents(spark, folder).where("source = 'sec_edgar'")
    feed = F.regexp_replace(F.regexp_extract("source_native_id", r"^sec-(\d+)", 1), "^0+", "")
    return filings.select("document_id", F.concat(F.lit("/archive/"), feed, F.lit("/"), F.regexp_replace(F.regexp_extract("source_native_id", r"^sec-\d+-(.*)$", 1), "-", "")).alias("path"))


def host_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per host, and whether the host is allowed."""
    host = F.try_parse_url("url", F.lit("HOST"))
    urls = views.documents(spark, folder).where("url is not null").select(F.when(F.col("url").rlike("^https?://"), host).alias("host"))
    return urls.groupBy("host").agg(F.count("*").alias("documents")).withColumn("allowed", F.coalesce(F.col("host").rlike(r"(^|\.)example$"), F.lit(False)))


def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows beyond the first per natural key, by table."""

    def extra(name: str, *keys: str) -> DataFrame:
        groups = read_table(spark, folder, name).groupBy(*keys).agg(F.count("*").alias("n"))
        return groups.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.count_if(F.col("n") > 1).alias("keys"))

    return extra("documents", "source", "source_native_id").union(extra("chunks", "chunk_id")).union(extra("evidence", "evidence_id")).union(extra("reports", "report_id")).union(extra("companies", "company_id"))


def html_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text read as a page: characters before and after."""
    docs = views.documents(spark, folder).where("text is not null").select("document_id", F.length("text").alias("before"), html_to_text(F.col("text")).alias("t"))
    return docs.select("document_id", "before", F.length("t").alias("after"), F.col("t").rlike("</?(p|div|script|a)\\b").alias("markup_left"))


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Companies named or tagged in every document, with places."""
    return views.mentions(spark, folder)


def documents_without_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that came out of chunking with nothing, and how many words they have."""
    docs = views.documents(spark, folder).select("document_id", F.size(words_of(F.col("text"))).cast("long").alias("words"))
    return docs.join(read_table(spark, folder, "chunks").select("document_id").distinct(), "document_id", "left_anti")


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Rows against each rule: a document's content never changes, a rebuilt document has one chunk per version and place, chunks cite their text, plans ask something."""
    docs, chunks, plans = (read_table(spark, folder, n) for n in ("documents", "chunks", "research_plans"))

    def rule(name: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))

    guarded = F.xxhash64(*(c for c in docs.columns if c not in ("doc_id", "ingested_at", "deleted_at", "status", "version")))
    changed = docs.groupBy("document_id").agg(F.countDistinct(guarded).alias("n")).where("n > 1")
    doubled = chunks.select("document_id", "pipeline_version", "position", "chunk_id").distinct().groupBy("document_id", "pipeline_version", "position").agg(F.count("*").alias("n")).where("n > 1")
    span = chunks.where("char_end <= char_start or char_start < 0 or length(text) <> char_end - char_start")
    silent = plans.where("coalesce(size(filter(queries, q -> trim(q) <> '')), 0) = 0")
    return rule("document content", changed).union(rule("chunk per version and place", doubled)).union(rule("chunk span", span)).union(rule("plan with queries", silent))


QUERIES = {f.__name__: f for f in (ingest_dedupe, new_references, registry_upsert, filing_top5, filing_path, host_allowlist, unique_keys, html_parse, entity_mentions, documents_without_chunks, integrity)}

_HAVE = "have as (select distinct source, source_native_id native_id from documents)"
SQL = {
    "entity_mentions": with_views("doc dc", "select document_id, company_id, cast(a as integer) char_start, cast(b as integer) char_end from mention"),
    "ingest_dedupe": f"""with {_HAVE}, cnt as (select source, native_id, count(*) n from document_refs group by 1, 2)
select c.source, cast(sum(n) as bigint) seen, count(*) distinct_refs, count(*) filter (h.native_id is null) "new" from cnt c left join have h on c.source = h.source and c.native_id = h.native_id group by 1""",
    "new_references": f"""with {_HAVE} select source, native_id, ref_id from document_refs r where not exists (select 1 from have h where h.source = r.source and h.native_id = r.native_id)
qualify row_number() over (partition by source, native_id order by discovered_at, ref_id) = 1""",
    "registry_upsert": rf"""with fresh as (select cik, trim(regexp_replace(name, '{SUFFIX}', '')) s, name, array_to_string(tickers, ',') tickers from companies where cik is not null and created_at >= timestamptz '{REGISTERED_FROM}+00'),
old as (select cik, name old_name, aliases[1] old_alias from companies where cik is not null and created_at < timestamptz '{STORED_UNTIL}+00')
select cik, case when length(s) >= 4 and s <> name then s end alias, tickers, case when old_name is null then 'created' when name is null then 'removed' when alias is not distinct from old_alias then 'unchanged' else 'updated' end change
from fresh full join old using (cik)""",
    "documents_without_chunks": with_views("doc", r"""select document_id, cast(coalesce(len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda w: w <> '')), 0) as bigint) words
from doc where not exists (select 1 from chunks c where c.document_id = doc.document_id)"""),
    "integrity": """select 'document content' "rule", count(*) broken from (select document_id from (select distinct * exclude (doc_id, ingested_at, deleted_at, status, version) from documents) group by 1 having count(*) > 1)
union all select 'chunk per version and place', count(*) from (select document_id from (select distinct document_id, pipeline_version, position, chunk_id from chunks) group by document_id, pipeline_version, position having count(*) > 1)
union all select 'chunk span', count(*) from chunks where char_end <= char_start or char_start < 0 or length(text) <> char_end - char_start
union all select 'plan with queries', count(*) from research_plans where coalesce(len(list_filter(queries, lambda q: trim(q) <> '')), 0) = 0""",
    "filing_top5": with_views("doc time pub", """select publisher, row_number() over (partition by publisher order by published desc, document_id) place, document_id from doc join pub using (document_id)
where doc_type = 'filing' and publisher is not null qualify place <= 5"""),
    "filing_path": with_views("doc", r"""select document_id, '/archive/' || regexp_replace(regexp_extract(source_native_id, '^sec-(\d+)', 1), '^0+', '') || '/' || replace(regexp_extract(source_native_id, '^sec-\d+-(.*)$', 1), '-', '') path
from doc where source = 'sec_edgar'"""),
    "host_allowlist": with_views("doc", r""", hosts as (select nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') host from doc where url is not null)
select host, count(*) documents, coalesce(regexp_matches(host, '(^|\.)example$'), false) allowed from hosts group by 1"""),
    "unique_keys": " union all ".join(
        f"select '{t}' table_name, cast(coalesce(sum(n - 1), 0) as bigint) extra, count(*) filter (n > 1) keys from (select count(*) n from {t} group by {k})"
        for t, k in (("documents", "source, source_native_id"), ("chunks", "chunk_id"), ("evidence", "evidence_id"), ("reports", "report_id"), ("companies", "company_id"))
    ),
}
