"""Hybrid search: semantic, full-text, graph and timeline signals under filters, fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.operators import fusion, graph, lexical, vector
from dossier.session import cut_lineage, few

ALL = "*"  # the group of all chunks
DEPTH = 2  # steps from a company to its neighbours


def ranked(df: DataFrame, key: str, *order, limit: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def _vectors(asks: DataFrame) -> DataFrame:
    """Every ask with the vector of its query; asks of the same query share the work."""
    vectors = T.text_features(asks.select("query").distinct(), "query", "query").select("query", "dims", "weights")
    return asks.join(vectors, "query")


def _near(asks: DataFrame, edges: DataFrame, pool: int) -> DataFrame:
    """(seed, group, depth, share, before): the neighbours of each company asked for, with an equal part of the pool each, 1 at least, and the places of those before it."""
    seeds = asks.where("company_id is not null").select(F.col("company_id").alias("seed")).distinct()
    one = W.partitionBy("seed")
    share = F.greatest(F.lit(1), F.floor(F.lit(pool) / F.count("*").over(one))).cast("int")
    near = graph.min_depths(seeds, edges, DEPTH).select("seed", F.col("node").alias("group"), "depth", share.alias("share"))
    return near.withColumn("before", (F.row_number().over(one.orderBy("depth", "group")) - 1) * F.col("share"))


def _of_units(units: DataFrame, wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(ask_id, group, depth, place, item_id) for ``wanted(ask_id, unit, group, depth, share)``: asks of the same query and kinds, a unit, share their groups' work."""
    most = wanted.groupBy("unit", "group").agg(F.max("share").alias("share"))
    grouped = most.groupBy("unit").agg(F.collect_list(F.struct("group", "share")).alias("wanted"))
    sent = cut_lineage(units.join(grouped, "unit").withColumnRenamed("unit", "ask_id"))
    tops = vector.group_tops(sent, index, T.DIMENSIONS).select(F.col("ask_id").alias("unit"), "group", "item_id", "place")
    return cut_lineage(tops.join(wanted, ["unit", "group"]).where("place <= share").select("ask_id", "group", "depth", "place", "item_id"))


def _shared(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``asks`` with their ``unit``, the first ask of the same query and kinds, and the units with their vectors."""
    asks = cut_lineage(asks.select("ask_id", "query", "kinds", "company_id", F.min("ask_id").over(W.partitionBy("query", "kinds")).alias("unit")))
    return asks, cut_lineage(_vectors(asks.where("ask_id = unit").select("unit", "query", "kinds")).drop("query"))


def _own(asks: DataFrame, pool: int) -> DataFrame:
    """The group of each ask's company, or of all chunks."""
    return asks.select("ask_id", "unit", F.coalesce("company_id", F.lit(ALL)).alias("group"), F.lit(0).alias("depth"), F.lit(pool).alias("share"))


def _semantic(found: DataFrame) -> DataFrame:
    return found.where("depth = 0").select("ask_id", F.col("item_id").alias("chunk_id"), F.col("place").alias("rank"))


def by_company(asks: DataFrame, index: DataFrame, pool: int) -> DataFrame:
    """The semantic signal of ``by_vector`` alone, without the neighbours' groups."""
    asks, units = _shared(asks)
    return _semantic(_of_units(units, cut_lineage(_own(asks, pool)), index))


def by_vector(asks: DataFrame, index: DataFrame, edges: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """The semantic and the graph signal, (ask_id, chunk_id, rank) each, from one pass over the groups of chunks that they ask.

    Semantic: the chunks of the ask's company, or all, by cosine to the query. Graph: nearer companies first, the
    best chunks of each; a chunk of several companies keeps its first place. Since a chunk's place is that of its first company,
    the first pass takes the companies that fill twice the pool, in order; only asks whose companies share so many
    chunks that the pool isn't full look at further ones, until it is or there are no more.
    """
    asks, units = _shared(asks)
    near = cut_lineage(_near(asks, edges, pool))
    open_, low, high, firsts, semantic = asks, 0, 2 * pool, None, None
    while True:
        neighbours = open_.join(near.where((F.col("before") >= low) & (F.col("before") < high)), F.col("company_id") == F.col("seed")).select("ask_id", "unit", "group", "depth", "share")
        found = _of_units(units, cut_lineage(_own(asks, pool).union(neighbours) if semantic is None else neighbours), index)
        if semantic is None:
            semantic = _semantic(found)
        first = found.where("depth > 0").select("ask_id", F.col("item_id").alias("chunk_id"), F.struct("depth", "group", "place").alias("best"))
        firsts = cut_lineage((first if firsts is None else firsts.union(first)).groupBy("ask_id", "chunk_id").agg(F.min("best").alias("best")))
        full = firsts.groupBy("ask_id").agg(F.count("*").alias("n")).where(F.col("n") >= pool)
        more = near.where(F.col("before") >= high).select(F.col("seed").alias("company_id")).distinct()
        open_ = cut_lineage(open_.join(more, "company_id", "left_semi").join(full, "ask_id", "left_anti"))
        if open_.isEmpty():
            return semantic, ranked(firsts, "ask_id", "best", "chunk_id", limit=pool).select("ask_id", "chunk_id", "rank")
        low, high = high, 4 * high


def by_terms(asks: DataFrame, index: DataFrame, words: list[str], pool: int) -> DataFrame:
    """(ask_id, chunk_id, rank, score): chunks that have all terms of the query and pass the ask's filters."""
    found = lexical.tops(asks.select("ask_id", "query", "company_id", "kinds"), index, words, pool).withColumnRenamed("item_id", "chunk_id")
    return ranked(found, "ask_id", F.desc("score"), "chunk_id", limit=pool).select("ask_id", "chunk_id", "rank", "score")


def by_time(asks: DataFrame, named: DataFrame, dated: DataFrame, first: DataFrame, pool: int) -> DataFrame:
    """(ask_id, chunk_id, rank): first chunks of the company's documents in the ask's time frame, newest first; nothing without company or frame.

    A document's companies, ``named(document_id, named)``, meet its time as one row and the few companies and frames where that row lies.
    """
    start, end = T.timeframe(F.col("timeframe"))
    framed = asks.where("company_id is not null").select("ask_id", "company_id", start.alias("start"), end.alias("end")).where("start is not null")
    key = ["company_id", "start", "end"]  # asks of the same company and time share the work
    links = named.join(dated, "document_id").select("document_id", "published", F.explode("named").alias("company_id"))
    docs = links.join(few(cut_lineage(framed.select(*key).distinct())), "company_id").where((F.col("published") >= F.col("start")) & (F.col("published") <= F.col("end")))
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("published"), "document_id")).cast("long")
    newest = docs.withColumn("rank", place).where(F.col("rank") <= pool).select(*key, "document_id", "rank").join(first, "document_id")
    return framed.join(newest, key).select("ask_id", "chunk_id", "rank")


def search(asks: DataFrame, index: DataFrame, words: list[str], named: DataFrame, edges: DataFrame, dated: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(ask_id, chunk_id, score, signals, places, rank): the k best chunks of each ask.

    ``asks(ask_id, query, company_id, kinds, timeframe)`` are questions with optional filters: a company, kinds of documents, a time frame.
    ``index`` holds the chunks' features in blocks (``blocks.pack``) with codes of the asks' terms, ``words``, and their documents' companies and ``ALL`` as groups, ``named(document_id, named)``
    the companies of documents, ``edges(src, dst)`` companies named together, ``dated(document_id, published)`` and
    ``first(document_id, chunk_id)`` what a timeline shows. A blank query finds nothing.
    """
    pool = k * fusion.POOL
    asks = asks.where("trim(query) <> ''")
    semantic, near = by_vector(asks, index, edges, pool)
    signals = {"semantic": semantic, "lexical": by_terms(asks, index, words, pool), "graph": near, "timeline": by_time(asks, named, dated, first, pool)}
    renamed = {name: df.select(F.col("ask_id").alias("query_id"), "chunk_id", "rank") for name, df in signals.items()}
    return fusion.fuse(renamed, "chunk_id", k).withColumnRenamed("query_id", "ask_id")
