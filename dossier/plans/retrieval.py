"""Search queries: plans ask all their queries, each with its whole text, against all chunks.

``semantic_signal`` and ``hybrid_search`` take every plan; ``lexical_match_topk``, ``timeline_signal`` and ``graph_signal`` those of every ``SPARSE``-th id. A query is asked once for each company that the plan enters and that can be resolved, or once without a company, of the
plan's kinds of documents; its timeline covers the year in which the plan was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier import views
from dossier.operators import fusion, graph, lexical, names, search, vector
from dossier.session import cut_lineage, few, read_table
from dossier.view_sql import with_views

K = 10
SPARSE = 100
POOL = K * fusion.POOL


def questions(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """(query_id, plan_id, place, query): the queries of every plan, or of those whose id is divisible by ``step``; an id is the plan's and the query's 0-based place."""
    plans = views.plans(spark, folder).where(F.col("plan_id") % step == 0)
    rows = plans.select("plan_id", F.posexplode("queries").alias("place", "query")).where("query is not null")
    return rows.select(F.concat_ws("-", "plan_id", "place").alias("query_id"), "plan_id", "place", "query")


def asked_companies(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """(plan_id, company_id, ordinal): companies that a plan's entries resolve to, at their first place."""
    entered = views.plans(spark, folder).where(F.col("plan_id") % step == 0).select("plan_id", F.posexplode("companies").alias("ordinal", "entry"))
    found = entered.join(names.resolve_names(entered.select("entry"), views.companies(spark, folder)), "entry")
    return found.groupBy("plan_id", "company_id").agg(F.min("ordinal").alias("ordinal"))


def asks(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """(ask_id, plan_id, place, ordinal, query, company_id, kinds, timeframe): every question for every company of its plan."""
    plans = views.plans(spark, folder).select("plan_id", F.when(F.size("doc_types") > 0, F.col("doc_types")).alias("kinds"), F.date_format(F.col("created_at").cast("timestamp"), "yyyy").alias("timeframe"))
    rows = questions(spark, folder, step).join(plans, "plan_id").join(asked_companies(spark, folder, step), "plan_id", "left")
    return cut_lineage(rows.select(F.concat_ws("-", "query_id", "company_id").alias("ask_id"), "plan_id", "place", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "query", "company_id", "kinds", "timeframe"))


def first_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return views.first_chunks(spark, folder)


def keyed(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """``asked`` with ``views.company_keys`` instead of the companies' ids, which sort alike: what a search joins and sends is a fifth as long."""
    keys = views.company_keys(spark, folder)
    return cut_lineage(asked.join(keys, "company_id", "left").withColumn("company_id", F.col("key")).select(*asked.columns))


def numbered(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asked`` with short ids, which every row of a search carries, and (ask_id, whole), the ids that they stand for."""
    both = cut_lineage(asked.withColumn("short", F.hex(F.monotonically_increasing_id())))
    return both.withColumn("ask_id", F.col("short")).drop("short"), both.select(F.col("short").alias("ask_id"), F.col("ask_id").alias("whole"))


def run_search(spark: SparkSession, folder: str, asked: DataFrame, k: int = K, named: DataFrame | None = None) -> DataFrame:
    """``search.search`` of ``asked`` over the tables of a folder; ``named`` are its ``views.document_keys``, if they have been made."""
    named = views.document_keys(spark, folder) if named is None else named
    asked, ids = numbered(keyed(spark, folder, asked.select("ask_id", "query", "company_id", "kinds", "timeframe")))
    words = lexical.vocabulary(asked)
    index = views.chunk_index(spark, folder, words, named)
    pairs = graph.named_together(named).select("src", "dst")
    edges = cut_lineage(pairs.coalesce(spark.sparkContext.defaultParallelism).distinct())  # a task passes on a pair once
    found = search.search(asked, index, words, named, edges, views.published(spark, folder), views.first_chunks(spark, folder), k)
    return found.join(ids, "ask_id").withColumn("ask_id", F.col("whole")).drop("whole")


def among(spark: SparkSession, folder: str, wanted: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of all deliveries of the chunks ``wanted(chunk_id)``; where these are few, no text is moved to find them."""
    return read_table(spark, folder, "chunks").select("chunk_id", *columns).join(few(cut_lineage(wanted.select("chunk_id").distinct())), "chunk_id", "left_semi")


def filter_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of news and filings of some sources, published in a range of days, that mention a listed company."""
    docs = views.documents(spark, folder).where("doc_type in ('news', 'filing') and source in ('rss', 'sec_edgar', 'wire_archive')")
    dated = views.published(spark, folder).where("to_date(published) between date '2023-06-01' and date '2025-12-31'")
    docs = docs.join(dated, "document_id", "left_semi").select("document_id", "source", "doc_type").join(views.document_companies(spark, folder), "document_id", "left_semi")
    return views.chunks(spark, folder).select("chunk_id", "document_id", "position").join(docs, "document_id").select("chunk_id", "document_id", "source", "doc_type")


def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100, against all vectors."""
    table = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return vector.top_k(table.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), table, K)


def near_dup_leader(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of every search without those too similar to a better one."""
    table = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    hits = vector.top_k(table.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), table, K)
    rows = hits.join(table, "item_id").select(F.col("query_id").alias("group"), F.col("item_id").alias("item"), "score", "vector")
    return vector.leader_clusters(rows, 0.5).withColumnRenamed("group", "query_id")


def lexical_match_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten chunks that have all terms of each question and match it best, without filters."""
    asked = cut_lineage(questions(spark, folder, SPARSE).select(F.col("query_id").alias("ask_id"), "query", F.lit(None).cast("string").alias("company_id"), F.lit(None).cast("array<string>").alias("kinds")))
    words = lexical.vocabulary(asked)
    found = search.by_terms(asked, views.chunk_index(spark, folder, words, vectors=False), words, K)
    return found.select(F.col("ask_id").alias("query_id"), "chunk_id", "score", "rank")


def semantic_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each ask's company and kinds by cosine of hashed vectors."""
    asked, ids = numbered(keyed(spark, folder, asks(spark, folder)))
    found = search.by_company(asked, views.chunk_index(spark, folder, [], views.document_keys(spark, folder)), POOL)
    return found.join(ids, "ask_id").select(F.col("whole").alias("ask_id"), "chunk_id", "rank")


def graph_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of neighbours' documents: nearer companies first, an equal part of the pool each, filled by cosine to the question."""
    named, asked = views.document_keys(spark, folder), keyed(spark, folder, asks(spark, folder, SPARSE))
    return search.by_vector(asked, views.chunk_index(spark, folder, [], named), graph.named_together(named), POOL)[1]


def timeline_signal(spark: SparkSession, folder: str) -> DataFrame:
    """First chunks of the company's documents within the ask's time frame, newest first."""
    return search.by_time(keyed(spark, folder, asks(spark, folder, SPARSE)), views.document_keys(spark, folder), views.published(spark, folder), views.first_chunks(spark, folder), POOL)


def hybrid_search(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """Four signals fused; texts and documents are looked up only for the final ranks."""
    found = cut_lineage(run_search(spark, folder, asks(spark, folder, step)))
    texts = among(spark, folder, found, "document_id", "text").groupBy("chunk_id").agg(F.min(F.struct("document_id", "text")).alias("c"))
    docs = views.documents(spark, folder).select("document_id", "title", "url", "source", "doc_type")
    shown = found.join(texts.select("chunk_id", "c.*"), "chunk_id").join(docs, "document_id")
    return shown.select("ask_id", "rank", "chunk_id", "document_id", "title", "url", "source", "doc_type", "text", F.round("score", 6).alias("score"), "signals", "places")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of every investigation, fused from its rank by source and its rank by time."""
    ev = views.evidence(spark, folder).where("chunk_id is not null and investigation_id is not null")
    ev = ev.groupBy("investigation_id", "chunk_id").agg(F.max("source_rank").alias("source_rank"), F.max(F.unix_micros("created_at")).alias("at")).withColumnRenamed("investigation_id", "query_id")
    one = search.ranked(ev.where("source_rank is not null"), "query_id", F.desc("source_rank"), "chunk_id", limit=POOL)
    two = search.ranked(ev, "query_id", F.desc("at"), "chunk_id", limit=POOL)
    fused = fusion.fuse({"semantic": one.select("query_id", "chunk_id", "rank"), "timeline": two.select("query_id", "chunk_id", "rank")}, "chunk_id", K)
    return fused.select("query_id", "chunk_id", "rank", "signals", "places", F.round("score", 6).alias("score"))


def timeline_desc(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 newest documents of every company."""
    rows = views.document_companies(spark, folder).join(views.published(spark, folder), "document_id")
    place = F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("published"), "document_id")).cast("long")
    return rows.withColumn("place", place).where("place <= 50").select("company_id", "document_id", "place", F.to_date("published").cast("string").alias("day"))


def merged_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Each investigation's dated documents once, under the first of its entered companies that mentions them."""
    entered = views.plans(spark, folder).select("investigation_id", F.posexplode("companies").alias("pos", "entry")).where("entry is not null")
    named = views.companies(spark, folder).select("company_id", F.lower("name").alias("n"))
    mine = entered.join(named, F.lower(F.trim("entry")) == F.col("n")).select("investigation_id", "pos", "company_id")
    docs = mine.join(views.document_companies(spark, folder), "company_id").join(views.published(spark, folder), "document_id")
    first = docs.groupBy("investigation_id", "document_id", "published").agg(F.min(F.struct("pos", "company_id")).alias("f"))
    place = F.row_number().over(W.partitionBy("investigation_id").orderBy(F.desc("published"), "document_id")).cast("long")
    return first.select("investigation_id", "document_id", F.col("f.company_id").alias("company_id"), place.alias("place"))


def page_investigations(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of twenty plans, newest first."""
    return views.plans(spark, folder).select("plan_id", "investigation_id", "version", "created_at").orderBy(F.desc("created_at"), "plan_id").offset(40).limit(20).select("plan_id", "investigation_id", "version")


QUERIES = {f.__name__: f for f in (
    filter_metadata, semantic_topk, near_dup_leader, lexical_match_topk, semantic_signal, timeline_signal, graph_signal, hybrid_search, rrf_fusion, timeline_desc, merged_timeline, page_investigations,
)}

_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
_SPARSE = f"where plan_id % {SPARSE} = 0"


def _questions(which: str) -> str:
    return f"""question as (select plan_id || '-' || place query_id, plan_id, place, query
  from (select plan_id, unnest(queries) query, generate_subscripts(queries, 1) - 1 place from plan {which}) where query is not null)"""


def _asks(which: str) -> str:
    """The asks of the plans ``which``, all or ``_SPARSE``."""
    return f"""{_questions(which)},
entered as (select plan_id, unnest(companies) entry, generate_subscripts(companies, 1) - 1 ordinal from plan {which}),
meant as (select entry, min(company_id) company_id from (select distinct entry from entered where trim(entry) <> '') join companies c
  on (length(trim(entry)) >= 4 and contains(lower(c.name), lower(entry))) or list_contains(c.aliases, entry) or list_contains(c.tickers, upper(entry)) group by 1),
asked as (select plan_id, company_id, min(ordinal) ordinal from entered join meant using (entry) group by 1, 2),
ask as materialized (select query_id || coalesce('-' || company_id, '') ask_id, plan_id, place, coalesce(ordinal, 0) ordinal, query, company_id, case when len(doc_types) > 0 then doc_types end kinds, cast(year(created_at) as varchar) timeframe
  from question join plan using (plan_id) left join asked using (plan_id))"""


_HASH = r"""word as (select chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda w: w <> '')) w from chunk),
cnt as (select chunk_id, sha256(w) h, count(*) n from word group by 1, 2),
dims as materialized (select chunk_id, ('0x' || substr(h, 1, 8))::bigint % 384 dim, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then n else -n end) v from cnt group by 1, 2),
norm as materialized (select chunk_id, sqrt(sum(v * v)) norm from dims where v <> 0 group by 1),
qword as (select query, unnest(list_filter(regexp_split_to_array(lower(query), '[\s\p{Z}]+'), lambda w: w <> '')) w from (select distinct query from ask)),
qcnt as (select query, sha256(w) h, count(*) n from qword group by 1, 2),
qdims as (select query, ('0x' || substr(h, 1, 8))::bigint % 384 dim, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 1 then n else -n end) v from qcnt group by 1, 2),
qnorm as (select query, sqrt(sum(v * v)) norm from qdims where v <> 0 group by 1),
shared as (select query, chunk_id, sum(q.v / qn.norm * (d.v / n.norm)) score from qdims q join qnorm qn using (query) join dims d using (dim) join norm n using (chunk_id) where q.v <> 0 and d.v <> 0 group by 1, 2),
cosine as materialized (select query, chunk_id, document_id, doc_type kind, round(coalesce(score, 0), 6) score
  from (select distinct query from ask) cross join norm join chunk using (chunk_id) left join doc using (document_id) left join shared using (query, chunk_id))"""
_SEMANTIC = """semantic as (select ask_id, chunk_id, row_number() over (partition by ask_id order by score desc, chunk_id) rank from ask a join cosine c using (query)
  where (kinds is null or list_contains(kinds, kind)) and (a.company_id is null or exists (select 1 from dc where dc.company_id = a.company_id and dc.document_id = c.document_id)) qualify rank <= 30)"""
_LEX = rf"""tok as (select chunk_id, len(t) length, unnest(t) term from (select chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') t from chunk)),
post as (select chunk_id, term, length, count(*) tf from tok where term not in ({_STOP}) group by 1, 2, 3),
corpus as (select count(*) n, avg(len(coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), []))) mean from chunk),
want as (select distinct query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) term from question),
wanted as (select * from want where term not in ({_STOP})),
dfs as (select term, count(*) df from post where term in (select term from wanted) group by 1),
lexhits as (select query, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) score, count(*) hits
  from wanted join post using (term) join dfs using (term), corpus group by 1, 2),
lexscore as (select l.query, chunk_id, score from lexhits l join (select query, count(*) terms from wanted group by 1) t on l.query = t.query and hits = terms)"""
_LEXICAL = """lexical as (select ask_id, chunk_id, row_number() over (partition by ask_id order by score desc, chunk_id) rank from ask a join lexscore using (query) join chunk c using (chunk_id) left join doc using (document_id)
  where (kinds is null or list_contains(kinds, doc_type)) and (a.company_id is null or exists (select 1 from dc where dc.company_id = a.company_id and dc.document_id = c.document_id)) qualify rank <= 30)"""
_FIRST = "firstc as (select chunk_id, document_id from chunk where position = 0 qualify row_number() over (partition by document_id order by pipeline_version desc, chunk_id) = 1)"
_TIME = f"""{_FIRST},
newest as (select ask_id, document_id, row_number() over (partition by ask_id order by published desc, document_id) rank from ask join dc using (company_id) join pub using (document_id)
  where published between make_timestamp(cast(timeframe as bigint), 1, 1, 0, 0, 0) and make_timestamp(cast(timeframe as bigint) + 1, 1, 1, 0, 0, 0) qualify rank <= 30),
timeline as (select ask_id, chunk_id, rank from newest join firstc using (document_id))"""
_EDGES = """few as (select document_id from dc group by 1 having count(*) between 2 and 12),
kept as (select * from dc where document_id in (select document_id from few)),
edge as (select a.company_id src, b.company_id dst, document_id from kept a join kept b using (document_id) where a.company_id < b.company_id),
sym as (select distinct src, dst from (select src, dst from edge union all select dst, src from edge))"""
_GRAPH = f"""{_EDGES},
w0 as (select distinct company_id seed, company_id node from ask where company_id is not null),
w1 as (select distinct seed, dst node from w0 join sym on node = src),
w2 as (select distinct seed, dst node from w1 join sym on node = src),
depths as (select seed, node, min(d) depth from (select *, 1 d from w1 union all select *, 2 from w2) where node <> seed group by 1, 2),
near as (select ask_id, query, kinds, node, depth, greatest(1, 30 // count(*) over (partition by ask_id)) portion from ask join depths on company_id = seed),
cand as (select ask_id, node, depth, chunk_id, portion, row_number() over (partition by ask_id, node order by score desc, chunk_id) place
  from near join dc on node = dc.company_id join cosine using (query, document_id) where kinds is null or list_contains(kinds, kind) qualify place <= portion),
best as (select ask_id, chunk_id, min((depth, node, place)) b from cand group by 1, 2),
graph as (select ask_id, chunk_id, row_number() over (partition by ask_id order by b, chunk_id) rank from best qualify rank <= 30)"""
_FUSE = """sig as ({}),
ranks as (select query_id, chunk_id, list((s, rank) order by s) r from sig group by 1, 2),
scored as (select query_id, chunk_id, r, list_sum(list_transform(r, lambda x: 1 / (60 + x[2]))) score from ranks),
fused as materialized (select query_id, chunk_id, r, score, row_number() over (partition by query_id order by round(score, 12) desc, r[1], chunk_id) rank from scored qualify rank <= 10)"""
_NAMES = "array_to_string(list_transform(r, lambda x: ['semantic', 'lexical', 'graph', 'timeline'][x[1] + 1]), ',') signals, array_to_string(list_transform(r, lambda x: x[2]), ',') places"
_SIGNALS = f"{_HASH}, {_SEMANTIC}, {_LEX}, {_LEXICAL}, {_TIME}, {_GRAPH}, " + _FUSE.format(" union all ".join(f"select ask_id query_id, chunk_id, {i} s, rank from {n}" for i, n in enumerate(fusion.ORDER)))
_SEARCH, _WHOLE_SEARCH = (f", {_asks(which)}, {_SIGNALS}" for which in (_SPARSE, ""))
_SEARCH_VIEWS = "plan chunk doc time pub dc"

SQL = {
    "filter_metadata": with_views("doc chunk time pub dc", """select chunk_id, document_id, source, doc_type from chunk join doc using (document_id)
join pub using (document_id)
where doc_type in ('news', 'filing') and source in ('rss', 'sec_edgar', 'wire_archive') and published_day between date '2023-06-01' and date '2025-12-31' and document_id in (select document_id from dc)"""),
    "semantic_topk": """with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) len from embeddings where embedding is not null)
select q.vec_id query_id, v.vec_id item_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (q.len * v.len), 6) score,
  row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (q.len * v.len), 6) desc, v.vec_id) rank
from n q, n v where q.vec_id % 100 = 0 qualify rank <= 10""",
    "near_dup_leader": """with recursive n as (select vec_id, embedding::double[] e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) len from embeddings where embedding is not null),
hit as materialized (select q.vec_id query_id, v.vec_id item, v.e, v.len, row_number() over (partition by q.vec_id order by round(list_dot_product(q.e, v.e) / (q.len * v.len), 6) desc, v.vec_id) n
  from n q, n v where q.vec_id % 100 = 0 qualify n <= 10),
near as materialized (select a.query_id, a.n, list(b.n) earlier from hit a join hit b on a.query_id = b.query_id and b.n < a.n where round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) >= 0.5 group by 1, 2),
visit as (select query_id, n, item, true keep, [n] kept from hit where n = 1
  union all select h.query_id, h.n, h.item, len(list_intersect(v.kept, coalesce(e.earlier, []))) = 0, case when len(list_intersect(v.kept, coalesce(e.earlier, []))) = 0 then list_append(v.kept, h.n) else v.kept end
  from visit v join hit h on h.query_id = v.query_id and h.n = v.n + 1 left join near e on e.query_id = h.query_id and e.n = h.n)
select query_id, item kept from visit where keep""",
    "lexical_match_topk": with_views("plan chunk", f""", {_questions(_SPARSE)}, {_LEX} select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) rank
from question join lexscore using (query) qualify rank <= 10"""),
    "semantic_signal": with_views("plan chunk doc dc", f", {_asks('')}, {_HASH}, {_SEMANTIC} select ask_id, chunk_id, rank from semantic"),
    "timeline_signal": with_views("plan chunk doc time pub dc", f", {_asks(_SPARSE)}, {_TIME} select ask_id, chunk_id, rank from timeline"),
    "graph_signal": with_views("plan chunk doc dc", f", {_asks(_SPARSE)}, {_HASH}, {_GRAPH} select ask_id, chunk_id, rank from graph"),
    "hybrid_search": with_views(_SEARCH_VIEWS, f"""{_WHOLE_SEARCH} select query_id ask_id, rank, chunk_id, document_id, title, url, source, doc_type, chunk.text, round(score, 6) score, {_NAMES}
from fused join chunk using (chunk_id) join doc using (document_id)"""),
    "rrf_fusion": with_views("ev", """, base as (select investigation_id query_id, chunk_id, max(source_rank) source_rank, max(created_at) seen from ev where chunk_id is not null and investigation_id is not null group by 1, 2),
one as (select query_id, chunk_id, row_number() over (partition by query_id order by source_rank desc, chunk_id) rank from base where source_rank is not null qualify rank <= 30),
two as (select query_id, chunk_id, row_number() over (partition by query_id order by seen desc, chunk_id) rank from base qualify rank <= 30), """
        + _FUSE.format("select query_id, chunk_id, 0 s, rank from one union all select query_id, chunk_id, 3, rank from two") + f" select query_id, chunk_id, rank, {_NAMES}, round(score, 6) score from fused"),
    "timeline_desc": with_views("doc time pub dc", """select company_id, document_id, row_number() over (partition by company_id order by published desc, document_id) place, cast(published_day as varchar) as "day"
from dc join pub using (document_id) qualify place <= 50"""),
    "merged_timeline": with_views("plan doc time pub dc", """, entry as (select investigation_id, unnest(companies) e, generate_subscripts(companies, 1) - 1 pos from plan),
mine as (select investigation_id, pos, company_id from entry join companies c on lower(trim(e)) = lower(c.name)),
firsts as (select investigation_id, document_id, published, min((pos, company_id)) f from mine join dc using (company_id) join pub using (document_id) group by 1, 2, 3)
select investigation_id, document_id, f[2] company_id, row_number() over (partition by investigation_id order by published desc, document_id) place from firsts"""),
    "page_investigations": with_views("plan", "select plan_id, investigation_id, version from plan order by created_at desc, plan_id offset 40 limit 20"),
}
