"""Queries on collected evidence, reports and how well searches find them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import views
from dossier.functions import text as T
from dossier.operators import names, scoring, vector
from dossier.plans import retrieval
from dossier.session import cut_lineage, few, read_table
from dossier.view_sql import with_views

AS_OF_DAY = views.AS_OF[:10]
NEAR_DUPLICATE = 0.97  # cosine from which a hit repeats another


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence with its document; evidence of unknown documents is left out."""
    days = views.published(spark, folder).select("document_id", F.to_date("published").alias("published"))
    docs = views.documents(spark, folder).select("document_id", "source", "publisher", "doc_type").join(days, "document_id", "left")
    return views.evidence(spark, folder).where("investigation_id is not null").join(docs, "document_id")


def _corroborated(spark: SparkSession, folder: str) -> DataFrame:
    """Per evidence row: the other documents of its investigation with the same stance, and their publishers.

    Counted per (investigation, stance); a row's own document is taken off its group's counts,
    so that no group of evidence is collected or paired.
    """
    known = _known(spark, folder)
    key = ["investigation_id", "stance"]
    docs = known.groupBy(*key, "document_id").agg(F.first(F.coalesce("publisher", "source")).alias("who"), F.first("doc_type").alias("doc_type"), F.first("published").alias("published"))
    per = docs.groupBy(*key, "who").agg(F.count("*").alias("of_who"))
    all_ = per.groupBy(*key).agg(F.sum("of_who").alias("docs"), F.count("*").alias("whos"))
    joined = docs.join(per, [*key, "who"]).join(all_, key)
    return joined.select(*key, "document_id", "doc_type", "published", (F.col("docs") - 1).alias("corroborating"), (F.col("whos") - F.when(F.col("of_who") == 1, 1).otherwise(0)).alias("publishers"))


def corroboration(spark: SparkSession, folder: str) -> DataFrame:
    return _corroborated(spark, folder).select("investigation_id", "stance", "document_id", "corroborating", "publishers")


def source_score(spark: SparkSession, folder: str) -> DataFrame:
    score = scoring.source_score(F.col("doc_type"), F.col("published"), F.col("corroborating"), F.col("publishers"), AS_OF_DAY)
    return _corroborated(spark, folder).select("investigation_id", "stance", "document_id", F.round(score, 6).alias("score"))


def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose query, in the same investigation, also has evidence of the opposite stance, and how much.

    A query's pairs are all its supporting with all its contradicting rows. They aren't written
    out, since a popular query would have quadratically many.
    """
    ev = views.evidence(spark, folder).where("investigation_id is not null and query is not null and stance in ('supporting', 'contradicting')")
    counts = ev.groupBy("investigation_id", "query").agg(F.count_if(F.col("stance") == "supporting").alias("s"), F.count_if(F.col("stance") == "contradicting").alias("c")).where("s > 0 and c > 0")
    opponents = F.when(F.col("stance") == "supporting", F.col("c")).otherwise(F.col("s"))
    return ev.join(counts, ["investigation_id", "query"]).select("investigation_id", "query", "evidence_id", "stance", opponents.alias("opponents"))


def evidence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Planned queries of each investigation's latest plan with fewer than two pieces of evidence."""
    latest = views.latest(views.plans(spark, folder), ["investigation_id"], F.desc("version"), F.desc("plan_id"))
    planned = latest.select("investigation_id", F.explode("queries").alias("query")).where("query is not null").distinct()
    counts = views.evidence(spark, folder).groupBy("investigation_id", "query").agg(F.count("*").alias("n"))
    return planned.join(counts, ["investigation_id", "query"], "left").select("investigation_id", "query", F.coalesce("n", F.lit(0)).alias("n")).where("n < 2")


def evidence_first_writer(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence that stays when a chunk may serve an investigation once: the first by time, then id."""
    ev = views.evidence(spark, folder).where("investigation_id is not null and chunk_id is not null")
    return views.latest(ev, ["investigation_id", "chunk_id"], "created_at", "evidence_id").select("investigation_id", "chunk_id", "evidence_id", "query")


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    parts = scoring.confidence(_known(spark, folder), AS_OF_DAY)
    return parts.select("investigation_id", *(F.round(c, 6).alias(c) for c in parts.columns[1:]))


def citation_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct citations of each report, numbered by first appearance."""
    ids = T.citation_ids(F.col("narrative"))
    rows = views.reports(spark, folder).select("report_id", F.posexplode(F.array_distinct(ids)).alias("p", "chunk_id"))
    return rows.select("report_id", (F.col("p") + 1).alias("number"), "chunk_id")


def citation_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a report cites at all, and only evidence of its investigation."""
    cited = citation_extract(spark, folder)
    allowed = views.evidence(spark, folder).select("investigation_id", "chunk_id").where("chunk_id is not null").distinct()
    reports = views.reports(spark, folder).select("report_id", "investigation_id")
    bad = cited.join(reports, "report_id").join(allowed, ["investigation_id", "chunk_id"], "left_anti").groupBy("report_id").agg(F.count("*").alias("invented"))
    some = cited.groupBy("report_id").agg(F.count("*").alias("cited"))
    joined = reports.join(some, "report_id", "left").join(bad, "report_id", "left")
    verdict = F.when(F.col("cited").isNull(), "uncited").when(F.col("invented").isNotNull(), "invented").otherwise("pass")
    return joined.select("report_id", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("invented", F.lit(0)).alias("invented"), verdict.alias("verdict"))


def citation_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Document and excerpt behind every citation that resolves."""
    chunks = views.chunks(spark, folder).select("chunk_id", "document_id", T.truncated(F.col("text"), 240).alias("excerpt"))
    docs = views.documents(spark, folder).select("document_id", "title")
    return citation_extract(spark, folder).join(chunks, "chunk_id").join(docs, "document_id").select("report_id", "number", "chunk_id", "document_id", "title", "excerpt")


def citation_display(spark: SparkSession, folder: str) -> DataFrame:
    """Narratives with each marker replaced by its number."""
    reports = views.reports(spark, folder).where("narrative is not null").select("report_id", "narrative")
    ids = F.array_distinct(T.citation_ids(F.col("narrative")))
    numbered = F.aggregate(F.transform(ids, lambda x, i: F.struct(x.alias("id"), (i + 1).alias("n"))), F.col("narrative"), lambda s, c: F.replace(s, F.concat(F.lit("[chunk:"), c["id"], F.lit("]")), F.concat(F.lit("["), c["n"].cast("string"), F.lit("]"))))
    return reports.select("report_id", numbered.alias("narrative"))


def _collected(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """(plan_id, place, ordinal, rank, chunk_id, document_id, checksum, score, dims, weights): the hits of every question, in order.

    A plan's questions are asked in their order, each for the plan's companies in theirs; a chunk that came up before is left out.
    """
    asked = retrieval.asks(spark, folder, step)
    found = retrieval.run_search(spark, folder, asked).join(asked.select("ask_id", "plan_id", "place", "ordinal"), "ask_id")
    first = cut_lineage(views.latest(found, ["plan_id", "chunk_id"], "place", "ordinal", "rank").select("plan_id", "place", "ordinal", "rank", "chunk_id", "score"))
    texts = retrieval.among(spark, folder, first, "document_id", "text")
    features = T.text_features(texts.withColumn("checksum", F.sha2("text", 256)), "text", "chunk_id", "document_id", "checksum", vocabulary=[])
    once = features.groupBy("chunk_id").agg(F.min(F.struct("checksum", "document_id", "dims", "weights")).alias("c"))
    return first.join(once.select("chunk_id", "c.*"), "chunk_id")


def evidence_collect(spark: SparkSession, folder: str, step: int = retrieval.SPARSE) -> DataFrame:
    """Evidence of every plan whose id is divisible by ``step``: its questions' hits without near duplicates, and the stance where a reviewer gave one."""
    hits = cut_lineage(_collected(spark, folder, step))
    group = F.concat_ws("-", "plan_id", "place").alias("group")
    order = F.col("ordinal") * 1000 + F.col("rank")
    kept = vector.merge_near(hits.select(group, F.col("chunk_id").alias("item_id"), "document_id", "checksum", F.round("score", 12).alias("score"), order.alias("place"), "dims", "weights"), NEAR_DUPLICATE, T.DIMENSIONS)
    rows = hits.select(group, F.col("chunk_id").alias("item_id"), "plan_id", "place", "document_id", "score").join(kept, ["group", "item_id"])
    plans = views.plans(spark, folder).select("plan_id", "investigation_id")
    stances = views.evidence(spark, folder).where("investigation_id is not null and chunk_id is not null").groupBy("investigation_id", "chunk_id").agg(F.min("stance").alias("stance"))
    judged = rows.withColumnRenamed("item_id", "chunk_id").join(plans, "plan_id").join(stances, ["investigation_id", "chunk_id"], "left")
    return judged.select("plan_id", "place", "chunk_id", "document_id", F.round("score", 6).alias("score"), F.array_join("corroborated_by", ",").alias("corroborated_by"), F.coalesce("stance", F.lit("unknown")).alias("stance"))


def replay_match(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan, of all plans: whether asking its questions again finds the chunks that its investigation's evidence records for them."""
    again = evidence_collect(spark, folder, 1).select("plan_id", "place", "chunk_id", F.lit(1).alias("again"))
    asked = retrieval.questions(spark, folder).select("plan_id", "place", "query").join(views.plans(spark, folder).select("plan_id", "investigation_id"), "plan_id")
    stored = views.evidence(spark, folder).where("chunk_id is not null").select("investigation_id", "query", "chunk_id").distinct()
    recorded = asked.join(stored, ["investigation_id", "query"]).select("plan_id", "place", "chunk_id", F.lit(1).alias("recorded"))
    both = again.join(recorded, ["plan_id", "place", "chunk_id"], "full")
    return both.groupBy("plan_id").agg(F.count("recorded").alias("recorded"), F.count("again").alias("again"), F.count(F.col("recorded") + F.col("again")).alias("both")).withColumn("same", (F.col("both") == F.col("recorded")) & (F.col("both") == F.col("again")))


def staleness_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with evidence collected after them."""
    latest = views.latest(views.reports(spark, folder), ["investigation_id"], F.desc("version"), F.desc("report_id")).select("report_id", "investigation_id", "created_at")
    newest = views.evidence(spark, folder).groupBy("investigation_id").agg(F.max("created_at").alias("newest"))
    return latest.join(newest, "investigation_id").where(F.col("newest") > F.col("created_at")).select("report_id", "investigation_id")


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """All reports with their investigation's highest version; ties stay."""
    reports = views.reports(spark, folder).select("report_id", "investigation_id", "version")
    top = reports.groupBy("investigation_id").agg(F.max("version").alias("version"))
    return reports.join(top, ["investigation_id", "version"]).select("report_id", "investigation_id", "version")


def report_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Citations, coverage of the evidence and stances of each investigation's latest report."""
    latest = views.latest(views.reports(spark, folder), ["investigation_id"], F.desc("version"), F.desc("report_id"))
    ids = T.citation_ids(F.col("narrative"))
    cites = latest.select("report_id", "investigation_id", F.size(ids).cast("long").alias("citations"), F.size(F.array_distinct(ids)).cast("long").alias("distinct_citations"))
    ev = views.evidence(spark, folder).groupBy("investigation_id").agg(F.count("*").alias("evidence"), F.count_if(F.col("stance") == "supporting").alias("supporting"), F.count_if(F.col("stance") == "contradicting").alias("contradicting"), F.count_if(F.col("stance") == "unknown").alias("unknown"))
    joined = cites.join(ev, "investigation_id", "left").na.fill(0, ["evidence", "supporting", "contradicting", "unknown"])
    return joined.select("report_id", "citations", "distinct_citations", "evidence", F.round(F.coalesce(F.try_divide("distinct_citations", "evidence"), F.lit(0.0)), 6).alias("coverage"), ((F.col("supporting") > 0) & (F.col("contradicting") > 0)).alias("both_stances"), F.round(F.coalesce(F.try_divide("unknown", "evidence"), F.lit(0.0)), 6).alias("unknown_share"))


def retrieval_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rates and mean reciprocal rank of the search for all plans' questions, without filters: the place of the first expected document among those found.

    Expected are all documents of the companies that a plan enters, of the plan's kinds. They are never listed, a plan has thousands: those
    found are looked at, and whether a plan has any is known from the kinds of each company's documents.
    """
    asked = views.plans(spark, folder).where("trim(question) <> ''").select("plan_id", F.col("plan_id").cast("string").alias("ask_id"), F.col("question").alias("query"))
    no_filter = {"company_id": F.lit(None).cast("string"), "kinds": F.lit(None).cast("array<string>"), "timeframe": F.lit(None).cast("string")}
    named = views.document_keys(spark, folder)
    found = cut_lineage(retrieval.run_search(spark, folder, asked.withColumns(no_filter), named=named))
    chunks = views.latest(retrieval.among(spark, folder, found, "document_id", "loaded_at"), ["chunk_id"], F.desc("loaded_at")).select("chunk_id", "document_id")
    docs = found.join(chunks, "chunk_id").groupBy("ask_id", "document_id").agg(F.min("rank").alias("rank"))
    docs = cut_lineage(docs.select("document_id", F.row_number().over(W.partitionBy("ask_id").orderBy("rank")).alias("place"), F.col("ask_id").cast("long").alias("plan_id")))
    kinds = views.plans(spark, folder).select("plan_id", F.when(F.size("doc_types") > 0, F.col("doc_types")).alias("kinds"))
    wanted = cut_lineage(retrieval.keyed(spark, folder, retrieval.asked_companies(spark, folder)).join(kinds, "plan_id").select("plan_id", F.col("company_id").alias("key"), "kinds"))
    fits = F.col("kinds").isNull() | F.array_contains("kinds", F.col("doc_type"))
    about = cut_lineage(views.documents(spark, folder).select("document_id", "doc_type").join(named, "document_id"))
    known = about.select("doc_type", F.explode("named").alias("key")).distinct().join(wanted, "key").where(fits).select("plan_id", F.lit(1).alias("known")).distinct()
    seen = about.join(few(docs), "document_id").select("plan_id", "place", "doc_type", F.explode("named").alias("key"))
    first = seen.join(wanted, ["plan_id", "key"]).where(fits).groupBy("plan_id").agg(F.min("place").alias("first"))
    each = asked.select("plan_id").join(known, "plan_id", "left").join(first, "plan_id", "left")
    hit = lambda most: F.round(F.coalesce(F.avg(F.when(F.col("known") == 1, F.coalesce((F.col("first") <= most).cast("int"), F.lit(0)))), F.lit(0.0)), 6)
    return each.agg(
        F.count("known").alias("questions"), F.count_if(F.col("known").isNull()).alias("skipped"), hit(3).alias("hit_rate_3"), hit(retrieval.K).alias("hit_rate_k"),
        F.round(F.coalesce(F.avg(F.when(F.col("known") == 1, F.coalesce(1 / F.col("first"), F.lit(0.0)))), F.lit(0.0)), 6).alias("mrr"),
    )


def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The company that each distinct entry of the plans resolves to."""
    entries = views.plans(spark, folder).select(F.explode("companies").alias("entry"))
    return names.resolve_names(entries, views.companies(spark, folder))


def foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    """References without target, per relation: rows and distinct keys."""

    def orphans(child: str, key: str, parent: str, target: str) -> DataFrame:
        keys = read_table(spark, folder, child).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        missing = keys.join(read_table(spark, folder, parent).select(F.col(target).alias("k")).distinct(), "k", "left_anti")
        return missing.agg(F.lit(f"{child}.{key}").alias("relation"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"), F.count("*").alias("keys"))

    return reduce(DataFrame.union, (orphans(*r) for r in RELATIONS))


def fused_context(spark: SparkSession, folder: str) -> DataFrame:
    """What a report is drafted from: each investigation's latest question and its evidence that was not rejected, numbered by query and id, excerpts cut to 500 characters.

    An investigation's text is one value by its nature, as large as its evidence.
    """
    latest = views.latest(views.plans(spark, folder), ["investigation_id"], F.desc("version"), F.desc("plan_id")).select("investigation_id", "question")
    ev = views.evidence(spark, folder).where("investigation_id is not null and excerpt is not null and (review is null or review <> 'rejected')")
    lines = ev.groupBy("investigation_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("query", F.lit("")).alias("query"), "evidence_id", T.truncated(F.col("excerpt"), 500).alias("text")))).alias("e"))
    numbered = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
    return latest.join(lines, "investigation_id").select("investigation_id", "question", F.size("e").cast("long").alias("evidence"), numbered.alias("context"))


def stance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence, chunks and documents per investigation and stance."""
    ev = views.evidence(spark, folder)
    return ev.groupBy("investigation_id", "stance").agg(F.count("*").alias("evidence"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("document_id").alias("documents"))


RELATIONS = (
    ("chunks", "document_id", "documents", "document_id"),
    ("evidence", "chunk_id", "chunks", "chunk_id"),
    ("evidence", "document_id", "documents", "document_id"),
    ("evidence", "investigation_id", "research_plans", "investigation_id"),
    ("reports", "investigation_id", "research_plans", "investigation_id"),
    ("documents", "feed_id", "feeds", "feed_id"),
    ("document_refs", "feed_id", "feeds", "feed_id"),
)

QUERIES = {f.__name__: f for f in (
    foreign_keys, fused_context, stance_histogram, corroboration, source_score, contradictions, evidence_gaps, evidence_first_writer, confidence, citation_extract, citation_gate, citation_resolve, citation_display,
    evidence_collect, replay_match, staleness_semi, latest_report, report_eval, retrieval_eval, name_resolution,
)}

_KNOWN = "known as (select ev.*, source, publisher, doc_type, published_day published from ev join doc using (document_id) left join pub using (document_id) where investigation_id is not null)"
_CORR = f"""{_KNOWN},
docs as (select distinct investigation_id, stance, document_id, coalesce(publisher, source) who, doc_type, published from known),
per as (select investigation_id, stance, who, count(*) of_who from docs group by 1, 2, 3),
total as (select investigation_id, stance, sum(of_who) docs, count(*) whos from per group by 1, 2),
corr as (select d.investigation_id, d.stance, d.document_id, doc_type, published, cast(docs - 1 as bigint) corroborating, whos - (of_who = 1)::int publishers
  from docs d join per p on p.investigation_id = d.investigation_id and p.stance = d.stance and p.who = d.who join total t on t.investigation_id = d.investigation_id and t.stance = d.stance)"""
_TIER = "case doc_type when 'filing' then 1.0 when 'transcript' then 0.9 when 'news' then 0.6 when 'profile' then 0.4 else 0.5 end"
_QUESTION_ASKS = retrieval._asks("")[: retrieval._asks("").index("ask as ")] + """ask as (select plan_id ask_id, question query, null::varchar company_id, null::varchar[] kinds from plan where trim(question) <> '')"""
_HITS = """,
hits as materialized (select plan_id, place, ordinal, rank, chunk_id, document_id, sha256(text) checksum, round(f.score, 12) score, row_number() over (partition by plan_id, place order by round(f.score, 12) desc, ordinal, rank) n
  from (select *, row_number() over (partition by plan_id, chunk_id order by place, ordinal, rank) seen from fused join ask on ask.ask_id = fused.query_id) f join chunk using (chunk_id) where seen = 1),
pairs as materialized (select a.plan_id, a.place, a.n, b.n m, a.chunk_id x, b.chunk_id y, a.checksum = b.checksum same from hits a join hits b on a.plan_id = b.plan_id and a.place = b.place and b.n < a.n),
of_hits as materialized (select chunk_id, dim, v / norm w from dims join norm using (chunk_id) where chunk_id in (select chunk_id from hits)),
sims as materialized (select x, y, round(sum(p.w * q.w), 6) cosine from (select distinct x, y from pairs) join of_hits p on p.chunk_id = x join of_hits q on q.chunk_id = y and q.dim = p.dim group by 1, 2),
alike as materialized (select plan_id, place, n, list(m) earlier from pairs left join sims using (x, y) where same or cosine >= 0.97 group by 1, 2, 3),
visit as (
  select plan_id, place, n, n leader, [n] kept from hits where n = 1
  union all
  select v.plan_id, v.place, h.n, coalesce(list_min(list_intersect(v.kept, coalesce(e.earlier, []))), h.n), case when len(list_intersect(v.kept, coalesce(e.earlier, []))) = 0 then list_append(v.kept, h.n) else v.kept end
  from visit v join hits h on h.plan_id = v.plan_id and h.place = v.place and h.n = v.n + 1 left join alike e on e.plan_id = h.plan_id and e.place = h.place and e.n = h.n),
led as (select v.plan_id, v.place, v.leader, string_agg(distinct h.document_id, ',' order by h.document_id) others from visit v join hits h on h.plan_id = v.plan_id and h.place = v.place and h.n = v.n
  join hits l on l.plan_id = v.plan_id and l.place = v.place and l.n = v.leader where v.leader <> v.n and h.document_id <> l.document_id group by 1, 2, 3),
stances as (select investigation_id, chunk_id, min(stance) stance from ev group by 1, 2),
collected as (select h.plan_id, h.place, h.chunk_id, h.document_id, round(h.score, 6) score, coalesce(others, '') corroborated_by, coalesce(s.stance, 'unknown') stance
  from visit v join hits h on h.plan_id = v.plan_id and h.place = v.place and h.n = v.n join plan p on p.plan_id = h.plan_id
  left join led on led.plan_id = h.plan_id and led.place = h.place and led.leader = h.n left join stances s on s.investigation_id = p.investigation_id and s.chunk_id = h.chunk_id where v.leader = v.n)"""
_CITES = r"""ids as (select *, coalesce(regexp_extract_all(narrative, '\[chunk:([0-9a-f-]{36})\]', 1), []) ids from rep),
seen as (select report_id, investigation_id, ids[i] chunk_id, min(i) i from ids, lateral (select unnest(range(1, len(ids) + 1)) i) group by 1, 2, 3),
cite as (select report_id, investigation_id, chunk_id, cast(row_number() over (partition by report_id order by i) as integer) number from seen)"""

SQL = {
    "foreign_keys": " union all ".join(
        f"select '{c}.{k}' relation, count(*) orphans, count(distinct {k}) keys from {c} where {k} is not null and {k} not in (select {t} from {p} where {t} is not null)" for c, k, p, t in RELATIONS
    ),
    "fused_context": with_views("plan ev", """, lat as (select * from plan qualify row_number() over (partition by investigation_id order by version desc, plan_id desc) = 1),
lines as (select investigation_id, row_number() over (partition by investigation_id order by coalesce(query, ''), evidence_id) n, substring(excerpt, 1, 500) t from ev
  where investigation_id is not null and excerpt is not null and (review is null or review <> 'rejected'))
select investigation_id, question, count(*) evidence, string_agg('[' || n || '] ' || t, chr(10) || chr(10) order by n) context from lat join lines using (investigation_id) group by 1, 2"""),
    "citation_display": with_views("rep", f""", {_CITES} select report_id, list_reduce(list_prepend(narrative, list_transform(coalesce(c, []), lambda x: x.chunk_id)), lambda s, x, i: replace(s, '[chunk:' || x || ']', '[' || (i - 1) || ']')) narrative
from rep left join (select report_id, list({{'chunk_id': chunk_id}} order by number) c from cite group by 1) using (report_id) where narrative is not null"""),
    "stance_histogram": with_views("ev", "select investigation_id, stance, count(*) evidence, count(distinct chunk_id) chunks, count(distinct document_id) documents from ev group by 1, 2"),
    "corroboration": with_views("ev doc time pub", f", {_CORR} select investigation_id, stance, document_id, corroborating, publishers from corr"),
    "source_score": with_views("ev doc time pub", f""", {_CORR} select investigation_id, stance, document_id, round(0.30 * {_TIER}::double
  + 0.25 * coalesce(pow(0.5, greatest(0, date '{AS_OF_DAY}' - published) / 180), 0.5)
  + 0.20 * case when corroborating > 0 then least(publishers / corroborating, 1) else 0 end + 0.25 * least(corroborating / 5, 1), 6) score from corr"""),
    "contradictions": with_views("ev", """, cnt as (select investigation_id, query, count(*) filter (stance = 'supporting') s, count(*) filter (stance = 'contradicting') c from ev group by 1, 2)
select investigation_id, query, evidence_id, stance, case stance when 'supporting' then c else s end opponents from ev join cnt using (investigation_id, query)
where s > 0 and c > 0 and stance in ('supporting', 'contradicting')"""),
    "evidence_gaps": with_views("plan ev", """, lat as (select * from plan qualify row_number() over (partition by investigation_id order by version desc, plan_id desc) = 1),
planned as (select distinct investigation_id, query from (select investigation_id, unnest(queries) query from lat) where query is not null),
cnt as (select investigation_id, query, count(*) n from ev group by 1, 2)
select p.investigation_id, p.query, coalesce(n, 0) n from planned p left join cnt c on p.investigation_id = c.investigation_id and p.query = c.query where coalesce(n, 0) < 2"""),
    "evidence_first_writer": with_views("ev", """select investigation_id, chunk_id, evidence_id, query from ev where investigation_id is not null and chunk_id is not null
qualify row_number() over (partition by investigation_id, chunk_id order by created_at, evidence_id) = 1"""),
    "confidence": with_views("ev doc time pub", f""", {_KNOWN}, parts as (select investigation_id, least(count(distinct source) / 3, 1) diversity, least(count(distinct document_id) / 5, 1) documents, avg({_TIER}::double) quality,
  coalesce(count(*) filter (date '{AS_OF_DAY}' - published <= 365) / nullif(count(published), 0), 0) recency,
  coalesce(count(*) filter (stance = 'supporting') / nullif(count(*) filter (stance in ('supporting', 'contradicting')), 0), 0.5) agreement
  from known where review is null or review <> 'rejected' group by 1)
select investigation_id, round(diversity, 6) diversity, round(documents, 6) documents, round(quality, 6) quality, round(recency, 6) recency, round(agreement, 6) agreement,
  round(0.25 * diversity + 0.15 * documents + 0.20 * quality + 0.15 * recency + 0.25 * agreement, 6) score from parts"""),
    "citation_extract": with_views("rep", f", {_CITES} select report_id, number, chunk_id from cite"),
    "citation_gate": with_views("rep ev", f""", {_CITES}, good as (select distinct investigation_id, chunk_id from ev),
n as (select report_id, count(*) cited, count(*) filter (g.chunk_id is null) invented from cite c left join good g on c.investigation_id = g.investigation_id and c.chunk_id = g.chunk_id group by 1)
select r.report_id, coalesce(cited, 0) cited, coalesce(invented, 0) invented, case when cited is null then 'uncited' when invented > 0 then 'invented' else 'pass' end verdict from rep r left join n using (report_id)"""),
    "citation_resolve": with_views("rep chunk doc", f", {_CITES} select report_id, number, chunk_id, document_id, title, substring(c.text, 1, 240) excerpt from cite join chunk c using (chunk_id) join doc using (document_id)"),
    "evidence_collect": with_views(retrieval._SEARCH_VIEWS + " ev", f"{retrieval._SEARCH}{_HITS} select plan_id, place, chunk_id, document_id, score, corroborated_by, stance from collected"),
    "replay_match": with_views(retrieval._SEARCH_VIEWS + " ev", f"""{retrieval._WHOLE_SEARCH}{_HITS}, recorded as (select distinct plan_id, place, chunk_id from question join plan using (plan_id) join ev on ev.investigation_id = plan.investigation_id and ev.query = question.query where chunk_id is not null)
select plan_id, count(r.chunk_id) recorded, count(c.chunk_id) again, count(r.chunk_id || c.chunk_id) "both", recorded = again and "both" = again same
from recorded r full join collected c using (plan_id, place, chunk_id) group by 1"""),
    "staleness_semi": with_views("rep ev", """, lat as (select * from rep qualify row_number() over (partition by investigation_id order by version desc, report_id desc) = 1)
select report_id, investigation_id from lat where exists (select 1 from ev where ev.investigation_id = lat.investigation_id and ev.created_at > lat.created_at)"""),
    "latest_report": with_views("rep", "select report_id, investigation_id, version from rep join (select investigation_id, max(version) version from rep group by 1) using (investigation_id, version)"),
    "report_eval": with_views("rep ev", r""", lat as (select *, coalesce(regexp_extract_all(narrative, '\[chunk:([0-9a-f-]{36})\]', 1), []) ids from rep qualify row_number() over (partition by investigation_id order by version desc, report_id desc) = 1),
n as (select investigation_id, count(*) evidence, count(*) filter (stance = 'supporting') s, count(*) filter (stance = 'contradicting') c, count(*) filter (stance = 'unknown') u from ev group by 1)
select report_id, len(ids) citations, len(list_distinct(ids)) distinct_citations, coalesce(evidence, 0) evidence, round(coalesce(len(list_distinct(ids)) / nullif(evidence, 0), 0), 6) coverage,
  coalesce(s > 0 and c > 0, false) both_stances, round(coalesce(u / nullif(evidence, 0), 0), 6) unknown_share from lat left join n using (investigation_id)"""),
    "retrieval_eval": with_views("plan chunk doc dc", f""", {_QUESTION_ASKS}, {retrieval._HASH}, {retrieval._SEMANTIC}, {retrieval._LEX}, {retrieval._LEXICAL},
"""+ retrieval._FUSE.format("select ask_id query_id, chunk_id, 0 s, rank from semantic union all select ask_id, chunk_id, 1, rank from lexical") + """,
docs as (select query_id plan_id, document_id, row_number() over (partition by query_id order by min(rank)) place from fused join chunk using (chunk_id) group by 1, 2),
expected as (select distinct plan_id, document_id from asked join plan using (plan_id) join dc using (company_id) join doc using (document_id) where coalesce(len(doc_types), 0) = 0 or list_contains(doc_types, doc_type)),
firsts as (select plan_id, min(place) f from expected left join docs using (plan_id, document_id) group by 1),
each as (select a.ask_id, p.plan_id, f from ask a left join firsts p on a.ask_id = p.plan_id)
select count(plan_id) questions, count(*) filter (plan_id is null) skipped, round(coalesce(avg(coalesce((f <= 3)::int, 0)) filter (plan_id is not null), 0), 6) hit_rate_3,
  round(coalesce(avg(coalesce((f <= 10)::int, 0)) filter (plan_id is not null), 0), 6) hit_rate_k, round(coalesce(avg(coalesce(1 / f, 0)) filter (plan_id is not null), 0), 6) mrr from each"""),
    "name_resolution": with_views("plan", """, entry as (select distinct e entry from (select unnest(companies) e from plan) where trim(e) <> '')
select entry, min(company_id) company_id from entry join companies c on (length(trim(entry)) >= 4 and contains(lower(c.name), lower(entry))) or list_contains(c.aliases, entry) or list_contains(c.tickers, upper(entry)) group by 1"""),
}
