"""References to records that do not exist: missing, deleted, or arrived later than they were cited.

References are counted per key and month before anything is joined. Keys that carry at least
1/``HEAVY`` of all references (there can be no more than ``HEAVY`` of them) are looked up by
broadcast, both against the target tables and against the references, so that no hot key is
shuffled; of all other keys, those without a target come from a shuffle anti-join. The orphan keys
of both are united, with the state that a key's references have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import cut_lineage, read_table

HEAVY = 1000
BLANK = r"[\s\p{Z}]"


def clean_id(column: Column) -> Column:
    """An id in lower case without outer blanks; NULL if nothing is left."""
    name = F.lower(F.regexp_replace(column, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.when(name != "", name)


def cited_chunks(narrative: Column) -> Column:
    """The ids after ``chunk:`` inside square brackets, in order."""
    marker = rf"(?i)chunk:{BLANK}*([^,;\s\p{{Z}}\[\]]+)"
    return F.flatten(F.transform(F.regexp_extract_all(narrative, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), lambda b: F.regexp_extract_all(b, F.lit(marker), F.lit(1))))


def record_references(evidence: DataFrame, reports: DataFrame) -> DataFrame:
    """(src_table, row_id, src_field, target, target_id, created_at), one row per reference; second deliveries count once."""
    rows = evidence.select(
        F.lit("evidence").alias("src_table"), F.col("evidence_id").alias("row_id"), "created_at",
        F.explode(F.array(F.struct(F.lit("chunk_id").alias("f"), F.lit("chunk").alias("t"), clean_id(F.col("chunk_id")).alias("id")), F.struct(F.lit("document_id").alias("f"), F.lit("document").alias("t"), clean_id(F.col("document_id")).alias("id")))).alias("r"),
    )
    cited = reports.select(F.lit("reports").alias("src_table"), F.col("report_id").alias("row_id"), "created_at", F.explode(F.array_distinct(F.transform(cited_chunks(F.col("narrative")), clean_id))).alias("id"))
    both = rows.select("src_table", "row_id", F.col("r.f").alias("src_field"), F.col("r.t").alias("target"), F.col("r.id").alias("target_id"), "created_at").union(
        cited.select("src_table", "row_id", F.lit("narrative"), F.lit("chunk"), "id", "created_at")
    )
    return both.where("target_id is not null").distinct()


def record_targets(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(target, target_id, deleted, since) rows of what can be referred to, not yet grouped."""
    return chunks.select(F.lit("chunk").alias("target"), clean_id(F.col("chunk_id")).alias("target_id"), F.col("deleted_at").isNotNull().alias("deleted"), F.col("created_at").alias("since")).union(
        documents.select(F.lit("document"), clean_id(F.col("document_id")), F.col("deleted_at").isNotNull(), F.col("ingested_at"))
    )


def utc_month(moment: Column) -> Column:
    """First day of a timestamp's month in UTC, whatever the session's time zone."""
    return F.trunc(F.date_from_unix_date(F.floor(F.unix_micros(moment.cast("timestamp")) / 86_400_000_000).cast("int")), "month")


def per_period(references: DataFrame, *columns: str) -> DataFrame:
    """(target, target_id, columns, month, n, first): references counted per key and month before anything is joined."""
    month = utc_month(F.col("created_at")).alias("month")
    return references.where("target_id is not null").groupBy("target", "target_id", *columns, month).agg(F.count("*").alias("n"), F.min("created_at").alias("first"))


def orphan_keys(counted: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of ``counted`` (``per_period``) that dangle for some of their references: (target, target_id, ref_state, ref_since), those of heavy keys and of the rest.

    ``ref_state`` is missing or deleted for all of a key's references; late for those before ``ref_since``.
    """
    key = ["target", "target_id"]
    keys = cut_lineage(counted.groupBy(*key).agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") >= max(2.0, total / HEAVY)
    heavy, rest = keys.where(is_heavy), keys.where(~is_heavy)  # at most HEAVY heavy ones

    def state_of(rows: DataFrame) -> DataFrame:
        return rows.where("target_id is not null").groupBy(*key).agg(F.max("deleted").alias("deleted"), F.min("since").alias("since"))

    def known(rows: DataFrame) -> DataFrame:
        late = F.col("since") > F.col("first")
        return rows.where(F.col("deleted") | late).select(*key, F.when(F.col("deleted"), "deleted").otherwise("late").alias("ref_state"), F.col("since").alias("ref_since"))

    def missing(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.lit("missing").alias("ref_state"), F.lit(None).cast("timestamp").alias("ref_since"))

    small = F.broadcast(heavy)
    hot = cut_lineage(state_of(targets.join(small.select(*key), key, "left_semi")))
    every = state_of(targets)
    of_heavy = missing(heavy.join(F.broadcast(hot), key, "left_anti")).union(known(hot.join(small, key)))
    of_rest = missing(rest.join(every, key, "left_anti")).union(known(every.join(rest, key)))
    return of_heavy, of_rest


def dangling_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """``references`` that dangle, with ``state`` (missing, deleted, late) and ``period`` (YYYY-MM, UTC).

    ``references(target, target_id, created_at, ...)`` has clean ids; NULL ids are no references.
    ``targets(target, target_id, deleted, since)`` may have several rows per id: it is deleted
    if any of them is, and exists since the earliest (NULL: always). A reference without
    ``created_at`` is never late and has a NULL period. Rows are kept one for one, so repeated
    references come out repeated, with their other columns; a column named ``state`` or ``period`` is
    replaced, names that begin with ``ref_`` are taken. Without targets every reference is missing.
    """
    references = references.where("target_id is not null")
    heavy, rest = orphan_keys(per_period(references), targets)
    key = ["target", "target_id"]
    judged = references.join(F.broadcast(heavy), key).unionByName(references.join(rest, key))
    dangling = judged.where((F.col("ref_state") != "late") | (F.col("ref_since") > F.col("created_at")))
    kept = [c for c in references.columns if c not in ("state", "period")]
    return dangling.select(*kept, F.col("ref_state").alias("state"), F.date_format(utc_month(F.col("created_at")), "yyyy-MM").alias("period"))


def dangling_by_period(references: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_table, src_field, period, state, orphans, targets): dangling references per table, field, month and state.

    Counted on the references per key and month. Only for the month in which a target arrived the
    references themselves are looked at again.
    """
    of = ["src_table", "src_field"]
    references = cut_lineage(references.where("target_id is not null"))
    counted = cut_lineage(per_period(references, *of))
    heavy, rest = orphan_keys(counted, targets)
    orphans = heavy.union(rest).withColumn("arrived", utc_month(F.col("ref_since")))
    key = ["target", "target_id"]
    whole = counted.join(orphans, key).where((F.col("ref_state") != "late") | (F.col("month") < F.col("arrived"))).select(*of, "target_id", "month", "ref_state", "n")
    arriving = references.withColumn("month", utc_month(F.col("created_at"))).join(orphans.where("ref_state = 'late'"), key)
    part = arriving.where((F.col("month") == F.col("arrived")) & (F.col("ref_since") > F.col("created_at"))).groupBy(*of, "target_id", "month", "ref_state").agg(F.count("*").alias("n"))
    return whole.union(part).groupBy(*of, F.date_format("month", "yyyy-MM").alias("period"), F.col("ref_state").alias("state")).agg(F.sum("n").alias("orphans"), F.countDistinct("target_id").alias("targets"))


def _all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    table = lambda name: read_table(spark, folder, name)
    return record_references(table("evidence"), table("reports")), record_targets(table("chunks"), table("documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every dangling reference of evidence and reports."""
    references, targets = _all(spark, folder)
    return dangling_references(cut_lineage(references), targets).select("src_table", "row_id", "src_field", "target_id", "state", "period")


def p2_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling references per table, field, month and state."""
    return dangling_by_period(*_all(spark, folder))


_STATES = r"""
with refs as (
  select 'evidence' src_table, evidence_id row_id, 'chunk_id' src_field, 'chunk' target, chunk_id id, created_at from evidence
  union all select 'evidence', evidence_id, 'document_id', 'document', document_id, created_at from evidence
  union all select 'reports', report_id, 'narrative', 'chunk', unnest(regexp_extract_all(b, '(?i)chunk:[\s\p{Z}]*([^,;\s\p{Z}\[\]]+)', 1)), created_at
    from (select report_id, created_at, unnest(regexp_extract_all(narrative, '\[[^\[\]]*\]')) b from reports)),
clean as (
  select distinct src_table, row_id, src_field, target, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) target_id, created_at from refs where id is not null),
targets as (
  select target, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) target_id, bool_or(deleted) deleted, min(since) since
  from (select 'chunk' target, chunk_id id, deleted_at is not null deleted, created_at since from chunks
        union all select 'document', document_id, deleted_at is not null, ingested_at from documents)
  group by 1, 2),
found as (
  select distinct src_table, row_id, src_field, c.target_id, strftime(timezone('UTC', c.created_at), '%Y-%m') period,
    case when t.target_id is null then 'missing' when t.deleted then 'deleted' when t.since > c.created_at then 'late' end state
  from clean c left join targets t on c.target = t.target and c.target_id = t.target_id where c.target_id <> '')
"""

P2_FOUND_SQL = _STATES + "select src_table, row_id, src_field, target_id, state, period from found where state is not null"

P2_BY_PERIOD_SQL = _STATES + "select src_table, src_field, period, state, count(*) orphans, count(distinct target_id) targets from found where state is not null group by 1, 2, 3, 4"
