"""The co-mention graph and walks over it.

Walks are a few equality joins with a symmetric edge table, one per step, each followed by a
distinct; the depth is a parameter and small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import cut_lineage

MOST = 12  # companies in a document beyond which its pairs say nothing


def co_mentions(mentions: DataFrame, most: int = MOST) -> DataFrame:
    """(src, dst, document_id), src < dst: pairs of companies in documents with 2 to ``most`` of them.

    The limit is part of the operator's meaning; a document gives at most ``most`` * (``most`` - 1) / 2 pairs. They are
    made where its companies, no more than there are, have been gathered: nothing is joined.
    """
    known = mentions.where("document_id is not null and company_id is not null")
    return named_together(known.groupBy("document_id").agg(F.collect_set("company_id").alias("named")), most)


def named_together(documents: DataFrame, most: int = MOST) -> DataFrame:
    """``co_mentions`` of ``documents(document_id, named)``, one row per document with its distinct companies."""
    few = documents.where(F.col("document_id").isNotNull() & F.size("named").between(2, most))
    first = few.select("document_id", F.explode("named").alias("src"), "named")
    return first.select("src", F.explode(F.filter("named", lambda c: c > F.col("src"))).alias("dst"), "document_id")


def walk(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): distinct nodes of each walk of up to ``depth`` undirected steps from ``seeds(seed)``."""
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    steps = front
    for d in range(1, depth + 1):
        front = front.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        steps = steps.union(front)
    return steps


def min_depths(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): the fewest steps to each node but the seed itself."""
    return walk(seeds, edges, depth).where("node <> seed").groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def neighborhood(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, src, dst, document_id, depth): all edges that touch a walked node, once per depth at which one does."""
    steps = walk(seeds, edges, depth)
    out = edges.join(steps, F.col("src") == F.col("node")).select("seed", "src", "dst", "document_id", "depth")
    back = edges.join(steps, F.col("dst") == F.col("node")).select("seed", "src", "dst", "document_id", "depth")
    return out.union(back).distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, component): connected components of ``nodes(node)`` under ``links(a, b)``, named by their smallest node.

    Every round takes the smallest label among neighbours and then jumps to that label's own
    label; the lineage is cut each round. It ends when no label changes, or fails after ``rounds``.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        better = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", "least").alias("new"))
        parents = labels.select(F.col("node").alias("p"), F.col("component").alias("up"))
        jumped = better.join(parents, F.col("new") == F.col("p"), "left").select("node", F.col("component").alias("old"), F.least("new", F.coalesce("up", "new")).alias("component"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
