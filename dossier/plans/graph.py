"""Queries on the co-mention graph; walks start at companies whose CIK is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import views
from dossier.operators import graph
from dossier.plans.retrieval import _EDGES
from dossier.session import cut_lineage
from dossier.view_sql import with_views


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(graph.co_mentions(views.document_companies(spark, folder)))


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    return views.companies(spark, folder).where(F.col("cik").try_cast("int") % 100 == 0).select(F.col("company_id").alias("seed"))


def co_mention_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.co_mentions(views.document_companies(spark, folder))


def neighbor_min_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Fewest steps between any two companies within three."""
    all_companies = views.companies(spark, folder).select(F.col("company_id").alias("seed"))
    return graph.min_depths(all_companies, edges(spark, folder), 3)


def graph_neighborhood(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighborhood(seeds(spark, folder), edges(spark, folder), 2)


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of the companies."""
    nodes = views.companies(spark, folder).select(F.col("company_id").alias("node"))
    return graph.components(nodes, edges(spark, folder).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A node for every company that a document mentions, keyed by its CIK, or else its id."""
    listed = views.companies(spark, folder).select("company_id", F.concat(F.lit("company:"), F.coalesce("cik", "company_id")).alias("node_key"), F.col("name").alias("label"))
    return listed.join(views.document_companies(spark, folder).select("company_id").distinct(), "company_id", "left_semi")


def labelled_neighborhood(spark: SparkSession, folder: str) -> DataFrame:
    """The edges around each start with the labels of both ends: once for each depth at which a walk touches them."""
    found = graph_neighborhood(spark, folder)
    names = graph_nodes(spark, folder)
    src, dst = names.select(F.col("company_id").alias("src"), F.col("label").alias("src_label")), names.select(F.col("company_id").alias("dst"), F.col("label").alias("dst_label"))
    return found.join(src, "src").join(dst, "dst").select("seed", "src_label", "dst_label", F.lit("co_mentioned").alias("edge_type"), "depth", "document_id").distinct()


QUERIES = {f.__name__: f for f in (graph_nodes, labelled_neighborhood, co_mention_edges, neighbor_min_depth, graph_neighborhood, graph_components)}

_AROUND = f"""{_EDGES}, w0 as (select company_id seed, company_id node from companies where try_cast(cik as integer) % 100 = 0),
w1 as (select distinct seed, dst node from w0 join sym on node = src), w2 as (select distinct seed, dst node from w1 join sym on node = src),
steps as (select *, 0 d from w0 union all select *, 1 from w1 union all select *, 2 from w2),
around as (select distinct seed, src, dst, document_id, d "depth" from edge join steps on node = src or node = dst)"""

SQL = {
    "graph_nodes": with_views("doc dc", "select company_id, 'company:' || coalesce(cik, company_id) node_key, name label from companies where company_id in (select company_id from dc)"),
    "labelled_neighborhood": with_views("doc dc", f""", {_AROUND} select distinct seed, s.name src_label, d.name dst_label, 'co_mentioned' edge_type, "depth", document_id
from around join companies s on s.company_id = src join companies d on d.company_id = dst"""),
    "co_mention_edges": with_views("doc dc", f", {_EDGES} select src, dst, document_id from edge"),
    "neighbor_min_depth": with_views("doc dc", f""", {_EDGES}, w0 as (select company_id seed, company_id node from companies),
w1 as (select distinct seed, dst node from w0 join sym on node = src), w2 as (select distinct seed, dst node from w1 join sym on node = src), w3 as (select distinct seed, dst node from w2 join sym on node = src)
select seed, node, min(d) "depth" from (select *, 1 d from w1 union all select *, 2 from w2 union all select *, 3 from w3) where node <> seed group by 1, 2"""),
    "graph_neighborhood": with_views("doc dc", f""", {_EDGES}, w0 as (select company_id seed, company_id node from companies where try_cast(cik as integer) % 100 = 0),
w1 as (select distinct seed, dst node from w0 join sym on node = src), w2 as (select distinct seed, dst node from w1 join sym on node = src),
steps as (select *, 0 d from w0 union all select *, 1 from w1 union all select *, 2 from w2)
select distinct seed, src, dst, document_id, d "depth" from edge join steps on node = src or node = dst"""),
    "graph_components": with_views("doc dc", f""", {_EDGES}, reach as (select company_id node, company_id other from companies union select r.node, s.dst from reach r join sym s on r.other = s.src)
select node, min(other) component from reach group by 1"""),
}
