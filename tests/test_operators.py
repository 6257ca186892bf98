import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from dossier.functions.text import text_features
from dossier.operators import fusion, graph, lexical, scoring, vector


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 500]], "node long")
    rows = graph.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 500: 500}
    assert {r["node"]: r["component"] for r in rows} == want
    assert graph.components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_walk_and_neighborhood(spark):
    mentions = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d1", "b"), ("d2", "b"), ("d2", "c"), ("d3", "c"), (None, "x"), ("d3", None)] + [("big", f"z{i}") for i in range(13)], "document_id string, company_id string")
    edges = graph.co_mentions(mentions)
    assert {tuple(r) for r in edges.collect()} == {("a", "b", "d1"), ("b", "c", "d2")}
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r["node"], r["depth"]) for r in graph.min_depths(seeds, edges, 2).collect()} == {("b", 1), ("c", 2)}
    assert {(r["src"], r["dst"], r["depth"]) for r in graph.neighborhood(seeds, edges, 1).collect()} == {("a", "b", 0), ("a", "b", 1), ("b", "c", 1)}


def test_fusion_keeps_the_tie_order(spark):
    rng = random.Random(1)
    lists = {name: rng.sample(range(60), 30) for name in fusion.ORDER}
    scores, first = defaultdict(float), {}
    for s, name in enumerate(fusion.ORDER):
        for rank, item in enumerate(lists[name], 1):
            scores[item] += 1 / (60 + rank)
            first.setdefault(item, (s, rank))
    want = sorted(scores, key=lambda i: (-scores[i], first[i]))[:10]
    frames = {n: spark.createDataFrame([(1, i, r) for r, i in enumerate(items, 1)], "query_id int, item int, rank int") for n, items in lists.items()}
    got = fusion.fuse(frames, "item", 10).orderBy("rank").collect()
    assert [r["item"] for r in got] == want


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(500, 16)).astype(np.float32)
    data[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None)]
    table = spark.createDataFrame(rows, "item_id long, vector array<float>")
    got = defaultdict(list)
    for r in vector.top_k(table.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), table, 5).orderBy("rank").collect():
        got[r["query_id"]].append(r["item_id"])
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    for q in range(0, 500, 100):
        s = np.round(unit @ unit[q].astype(float), 6)
        assert got[q] == sorted(range(500), key=lambda i: (-s[i], i))[:5]
    assert vector.top_k(table.limit(0).withColumnRenamed("item_id", "query_id"), table, 5).count() == 0


def test_leaders(spark):
    rows = [("g", 1, 0.9, [1.0, 0.0]), ("g", 2, 0.8, [1.0, 0.01]), ("g", 3, 0.7, [0.0, 1.0]), ("g", 4, 0.6, None), ("h", 5, 0.1, [1.0, 0.0])]
    got = vector.leader_clusters(spark.createDataFrame(rows, "group string, item int, score double, vector array<double>"), 0.97).collect()
    assert {tuple(r) for r in got} == {("g", 1), ("g", 3), ("g", 4), ("h", 5)}


def test_search_needs_all_terms(spark):
    texts = spark.createDataFrame([("a", "the red car and the blue car"), ("b", "a red bicycle"), ("c", None), ("d", "car car red red"), ("e", "")], "key string, text string")
    queries = spark.createDataFrame([(1, "the Red car"), (2, "the of"), (3, "green"), (4, None)], "query_id int, query string")
    index = text_features(texts, "text", "key")
    got = queries.join(lexical.scores(queries, index, "key"), "query").orderBy("query_id", F.desc("score")).collect()
    assert [(r["query_id"], r["key"]) for r in got] == [(1, "d"), (1, "a")]


def test_group_tops_against_brute_force(spark, monkeypatch):
    """Items in several groups, kinds, ties, more blocks than one."""
    monkeypatch.setattr(vector, "ITEM_BLOCK", 20)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    unit = lambda: (v := rng.integers(-2, 3, 6).astype(float)) / max(np.linalg.norm(v), 1)
    items = [(f"i{n:03d}", "xyz"[n % 3], sorted(rng.choice(["a", "b", "c"], rng.integers(0, 4), replace=False).tolist()), list(range(6)), unit().tolist()) for n in range(100)] + [("none", "x", ["a"], [], [])]
    asks = [(f"q{n}", (None, ["x"], ["y", "z"])[n % 3], list(range(6)), unit().tolist(), [("a", 3), ("c", 1), ("absent", 5)]) for n in range(7)]
    table = spark.createDataFrame(asks, "ask_id string, kinds array<string>, dims array<int>, weights array<double>, wanted array<struct<group: string, share: int>>")
    known = spark.createDataFrame(items, "item_id string, kind string, groups array<string>, dims array<int>, weights array<double>")
    got = {(r["ask_id"], r["group"], r["place"]): r["item_id"] for r in vector.group_tops(table, known, 6).collect()}
    want = {}
    for ask, kinds, _, q, wanted in asks:
        for group, share in wanted:
            scored = sorted((-round(float(np.dot(q, w)), 6) + 0.0, i) for i, kind, groups, dims, w in items if dims and group in groups and (kinds is None or kind in kinds))
            want |= {(ask, group, n): i for n, (_, i) in enumerate(scored[:share], 1)}
    assert got == want


def test_merged_hits_name_other_documents(spark):
    v = lambda *w: (list(range(len(w))), [float(x) for x in w])
    rows = [
        ("g", "c1", "d1", "h1", 0.9, 1, *v(1, 0)), ("g", "c2", "d2", "h2", 0.8, 2, *v(0.97, 0.2431)), ("g", "c3", "d1", "h3", 0.8, 3, *v(1, 0)), ("g", "c4", "d4", "h4", 0.7, 4, *v(0.9699, 0.2435)),
        ("g", "c5", "d5", "h4", 0.6, 5, *v(0, 1)), ("g", "c6", "d6", None, 0.5, 6, None, None), ("g", "c7", "d7", "h4", 0.4, 7, [], []), ("f", "c1", "d1", "h1", 0.1, 1, *v(1, 0)),
    ]
    table = spark.createDataFrame(rows, "group string, item_id string, document_id string, checksum string, score double, place int, dims array<int>, weights array<double>")
    got = {(r["group"], r["item_id"]): r["corroborated_by"] for r in vector.merge_near(table, 0.97, 2).collect()}
    assert got == {("g", "c1"): ["d2"], ("g", "c4"): ["d5", "d7"], ("g", "c6"): [], ("f", "c1"): []}
    assert vector.merge_near(table.limit(0), 0.97, 2).count() == 0


def test_confidence_cases(spark):
    schema = "investigation_id string, document_id string, source string, doc_type string, published date, stance string, review string"
    from datetime import date

    rows = [("i", "1", "s1", "filing", date(2024, 1, 1), "supporting", None), ("i", "2", "s2", "news", date(2020, 1, 1), "supporting", "approved"), ("i", "3", "s2", "news", None, "contradicting", None), ("i", "4", "s3", "news", None, "contradicting", "rejected"), ("j", "1", "s", "odd", None, "unknown", None)]
    got = {r["investigation_id"]: r for r in scoring.confidence(spark.createDataFrame(rows, schema), "2024-06-01").collect()}
    assert got["i"]["agreement"] == pytest.approx(2 / 3) and got["i"]["diversity"] == pytest.approx(2 / 3) and got["i"]["recency"] == 0.5
    assert (got["j"]["agreement"], got["j"]["quality"], got["j"]["recency"]) == (0.5, 0.5, 0.0)
