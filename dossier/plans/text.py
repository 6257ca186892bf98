"""Queries on text: chunking, hashing, aliases, time frames, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import views
from dossier.functions import text as T
from dossier.session import read_table, spread
from dossier.view_sql import with_views


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's paragraphs packed into chunks."""
    rows = spread(read_table(spark, folder, "documents").select("doc_id", "document_id", "ingested_at", "text"))
    docs = views.first_deliveries(rows, "document_id", "ingested_at", "doc_id").select("document_id", "text")
    spans = docs.select("document_id", "text", F.posexplode(T.packed_spans(F.col("text"))).alias("position", "span"))
    piece = F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    return spans.select("document_id", "position", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), F.size(T.words_of(piece)).alias("token_count"))


def feature_hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed vectors of all chunks, sparse."""
    vectors = T.feature_hash(views.chunks(spark, folder), "chunk_id", "text")
    return vectors.select("chunk_id", "dim", F.round("weight", 6).alias("weight"))


def alias_derivation(spark: SparkSession, folder: str) -> DataFrame:
    return views.companies(spark, folder).select("company_id", "name", T.alias_of(F.col("name")).alias("alias"))


def timeframe_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of every time frame that starts a raw publication time."""
    raw = views.documents(spark, folder).select("published_at")
    labels = raw.select(F.explode(F.array(F.substring("published_at", 1, 4), F.substring("published_at", 1, 7), F.concat(F.substring("published_at", 1, 4), F.lit("Q"), F.substring("published_at", 7, 1)))).alias("label"))
    start, end = T.timeframe(F.col("label"))
    return labels.where("label is not null").distinct().select("label", start.cast("string").alias("start_day"), end.cast("string").alias("end_day"))


def content_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """Content address of each document."""
    digest = F.sha2("text", 256)
    return views.documents(spark, folder).where("text is not null").select("document_id", digest.alias("checksum"), F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("path"))


def exact_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several documents have."""
    docs = views.documents(spark, folder).where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("copies"), F.min("document_id").alias("first_id")).where("copies > 1")


def metadata_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of four conditions: title, time, url, more than 200 characters."""
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("title") != "", F.col("published_at") != "", F.col("url") != "", F.length("text") > 200)]
    return views.documents(spark, folder).select("document_id", (sum(flags[1:], flags[0]) / 4).alias("quality"))


def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence with its excerpt cut to the citation length."""
    return views.evidence(spark, folder).select("evidence_id", T.truncated(F.col("excerpt"), 240).alias("excerpt"), F.length("excerpt").cast("long").alias("length")).distinct()


QUERIES = {f.__name__: f for f in (chunk_pack, feature_hash_embed, alias_derivation, timeframe_bounds, content_checksum, exact_dup_groups, metadata_quality, excerpts)}

SQL = {
    "chunk_pack": with_views("doc", r""",
para as (select document_id, i, parts[i] p, len(list_filter(regexp_split_to_array(parts[i], '[\s\p{Z}]+'), lambda w: w <> '')) n
  from (select document_id, string_split(text, chr(10)) parts from doc where text is not null), lateral (select unnest(range(1, len(parts) + 1)) i)),
placed as (select document_id, i, n, length(p) len, coalesce(sum(length(p) + 1) over (partition by document_id order by i rows between unbounded preceding and 1 preceding), 0) off from para),
filled as (select document_id, n, len, off, row_number() over (partition by document_id order by i) k from placed where n > 0),
pack as (
  select document_id, k, off start_, off + len end_, n words from filled where k = 1
  union all
  select f.document_id, f.k, case when p.words >= 250 then f.off else p.start_ end, f.off + f.len, case when p.words >= 250 then f.n else p.words + f.n end
  from pack p join filled f on f.document_id = p.document_id and f.k = p.k + 1),
closed as (select document_id, start_, max(end_) end_ from pack group by 1, 2)
select c.document_id, cast(row_number() over (partition by c.document_id order by start_) - 1 as integer) as position, cast(start_ as integer) char_start, cast(end_ as integer) char_end,
  cast(len(list_filter(regexp_split_to_array(substring(d.text, cast(start_ as integer) + 1, cast(end_ - start_ as integer)), '[\s\p{Z}]+'), lambda w: w <> '')) as integer) token_count
from closed c join doc d using (document_id)"""),
    "feature_hash_embed": with_views("chunk", r""",
word as (select chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda w: w <> '')) w from chunk),
cnt as (select chunk_id, sha256(w) h, count(*) n from word group by 1, 2),
dims as (select chunk_id, cast(('0x' || substr(h, 1, 8))::bigint % 384 as integer) dim, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then n else -n end) v from cnt group by 1, 2),
norm as (select chunk_id, sqrt(sum(v * v)) norm from dims where v <> 0 group by 1)
select chunk_id, dim, round(v / norm, 6) weight from dims join norm using (chunk_id) where v <> 0"""),
    "alias_derivation": rf"""select company_id, name, case when length(s) >= 4 and s <> name then s end alias
from (select *, trim(regexp_replace(name, '{T.SUFFIX}', '')) s from companies)""",
    "timeframe_bounds": with_views("doc", r""",
labels as (select distinct unnest([substr(published_at, 1, 4), substr(published_at, 1, 7), substr(published_at, 1, 4) || 'Q' || substr(published_at, 7, 1)]) label from doc where published_at is not null),
parts as (select label, try_cast(regexp_extract(trim(label), '^(\d{4})(Q[1-4]|-\d{2})?$', 1) as integer) y,
  case when regexp_matches(trim(label), '^\d{4}Q[1-4]$') then try_cast(right(trim(label), 1) as integer) * 3 - 2
       when regexp_matches(trim(label), '^\d{4}-(0[1-9]|1[0-2])$') then try_cast(right(trim(label), 2) as integer)
       when regexp_matches(trim(label), '^\d{4}$') then 1 end m,
  case when trim(label) like '%Q%' then 3 when trim(label) like '%-%' then 1 else 12 end span from labels)
select label, cast(case when m is not null and y between 1 and 9998 then make_date(y, m, 1) end as varchar) start_day,
  cast(cast(case when m is not null and y between 1 and 9998 then make_date(y, m, 1) end + to_months(span) as date) as varchar) end_day from parts"""),
    "content_checksum": with_views("doc", "select document_id, sha256(text) checksum, substr(sha256(text), 1, 2) || '/' || sha256(text) path from doc where text is not null"),
    "exact_dup_groups": with_views("doc", "select sha256(text) checksum, count(*) copies, min(document_id) first_id from doc where text is not null group by 1 having count(*) > 1"),
    "metadata_quality": with_views("doc", """select document_id, (coalesce(title <> '', false)::int + coalesce(published_at <> '', false)::int + coalesce(url <> '', false)::int + coalesce(length(text) > 200, false)::int) / 4 quality from doc"""),
    "excerpts": with_views("ev", "select distinct evidence_id, substring(excerpt, 1, 240) excerpt, length(excerpt) length from ev"),
}
