"""Searches over packed blocks: what a task passes on stays small, and nothing is lost by it."""

from pyspark.sql import functions as F

from dossier.operators import blocks, search, vector

ASK = "ask_id string, query string, company_id string, kinds array<string>"


def test_a_task_passes_on_no_more_than_the_shares(spark):
    items = spark.range(200, numPartitions=2).select(F.format_string("i%03d", "id").alias("item_id"), F.lit("x").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("groups"), F.array(F.lit(0)).alias("dims"), F.array(F.lit(1.0)).alias("weights"))
    asks = spark.createDataFrame([("q", None, [0], [1.0], [("a", 1), ("b", 3)])], "ask_id string, kinds array<string>, dims array<int>, weights array<double>, wanted array<struct<group: string, share: int>>")
    passed = vector._round(asks, blocks.gathered(blocks.pack(items, 10)), 2)  # ten blocks in each of two tasks, all scores tied
    assert passed.count() == 2 * (1 + 3)
    got = {(r["group"], r["place"], r["item_id"]) for r in vector.group_tops(asks, blocks.pack(items, 10), 2).collect()}
    assert got == {("a", 1, "i000"), ("b", 1, "i000"), ("b", 2, "i001"), ("b", 3, "i002")}


def test_companies_that_share_their_chunks_bring_up_further_ones(spark):
    """The first eight neighbours have one chunk in common: the pool is filled from those after them."""
    names = [f"c{n:02d}" for n in range(20)]
    edges = spark.createDataFrame([("a", n) for n in names], "src string, dst string")
    rows = [("k-all", "x", [*names[:8], search.ALL], [1], [1.0])] + [(f"k{n:02d}", "x", [c, search.ALL], [2], [1.0]) for n, c in enumerate(names) if n >= 8]
    items = spark.createDataFrame(rows, "item_id string, kind string, groups array<string>, dims array<int>, weights array<double>")
    asks = spark.createDataFrame([("q", "rail", "a", None)], ASK)
    _, near = search.by_vector(asks, blocks.pack(items, 4), edges, 4)
    assert [r["chunk_id"] for r in near.orderBy("rank").collect()] == ["k-all", "k08", "k09", "k10"]


def test_the_newer_delivery_of_a_chunk_is_the_one_indexed(spark, tmp_path):
    from datetime import datetime

    from dossier import views

    rows = [("k", "d", "old text", datetime(2025, 1, 1)), ("k", "d", "new margin text", datetime(2026, 1, 1)), ("l", "d", None, datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "chunk_id string, document_id string, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    held = views.chunk_index(spark, str(tmp_path), ["margin", "old"], vectors=False)
    found = [b for r in held.collect() for b in blocks.Block(__import__("pyarrow").ipc.open_stream(bytes(r["packed"])).read_all()).table.to_pylist()]
    assert {(b["item_id"], tuple(b["codes"]), b["length"]) for b in found} == {("k", (0,), 3), ("l", (), 0)}


def test_the_semantic_signal_alone_builds_no_graph(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from dossier.operators import graph
    from dossier.plans import retrieval

    seen = datetime(2026, 1, 1)
    companies = [("c1", "Alphazon Systems", [], ["Alphazon"]), ("c2", "Betacorp Holdings", [], [])]
    spark.createDataFrame(companies, "company_id string, name string, tickers array<string>, aliases array<string>").write.parquet(f"{tmp_path}/companies.parquet")
    texts = [(1, "d1", "Alphazon met Betacorp Holdings over rail"), (2, "d2", "Betacorp Holdings on rail")]
    spark.createDataFrame([(n, d, "news", seen, t) for n, d, t in texts], "doc_id long, document_id string, doc_type string, ingested_at timestamp, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"k{n}", d, seen, t) for n, d, t in texts], "chunk_id string, document_id string, loaded_at timestamp, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    plans = [(100, ["Alphazon"], None, ["rail"], seen, seen), (200, [], None, ["rail"], seen, seen)]
    spark.createDataFrame(plans, "plan_id long, companies array<string>, doc_types array<string>, queries array<string>, created_at timestamp, loaded_at timestamp").write.parquet(f"{tmp_path}/research_plans.parquet")
    monkeypatch.setattr(graph, "co_mentions", None)  # whoever calls it fails
    got = {(r["ask_id"], r["rank"], r["chunk_id"]) for r in retrieval.semantic_signal(spark, str(tmp_path)).collect()}
    assert got == {("100-0-c1", 1, "k1"), ("200-0", 1, "k2"), ("200-0", 2, "k1")}


def test_companies_named_together_are_found_without_a_join(spark):
    from dossier.operators import graph

    rows = [("d1", "b"), ("d1", "a"), ("d1", "a"), ("d1", "c"), ("d2", "a"), ("d3", None), (None, "a"), *[("d4", f"x{n:02d}") for n in range(13)]]
    edges = graph.co_mentions(spark.createDataFrame(rows, "document_id string, company_id string"))
    assert {tuple(r) for r in edges.collect()} == {("a", "b", "d1"), ("a", "c", "d1"), ("b", "c", "d1")}
    assert "Join" not in edges._jdf.queryExecution().toString()


def test_a_block_holds_whole_numbers_and_scores_as_weights_do(spark, tmp_path):
    """The index shuffles and stores no fractions; its vectors are those of ``text_features`` to the last bit."""
    from datetime import datetime

    import numpy as np
    import pyarrow as pa

    from dossier import views
    from dossier.functions import text

    rows = [(f"k{n}", "d", t, datetime(2026, 1, 1)) for n, t in enumerate(["rail rail freight of copper", "", None, "margin " * 70_000, *(" ".join(f"w{n * m % 97}" for m in range(60)) for n in range(5))])]
    spark.createDataFrame(rows, "chunk_id string, document_id string, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    held = [blocks.Block(pa.ipc.open_stream(bytes(r["packed"])).read_all()) for r in views.chunk_index(spark, str(tmp_path), []).collect()]
    assert all(b.table["weights"].null_count == len(b.ids) and b.table["counts"].type == pa.list_(pa.int32()) for b in held)
    got = {k.decode(): column for b in held for k, column in zip(b.ids.tolist(), b.columns(text.DIMENSIONS).T)}
    want = {r["chunk_id"]: dict(zip(r["dims"], r["weights"])) for r in text.text_features(spark.read.parquet(f"{tmp_path}/chunks.parquet"), "text", "chunk_id").collect()}
    assert got.keys() == want.keys()
    assert all(np.array_equal(got[k], [want[k].get(d, 0.0) for d in range(text.DIMENSIONS)]) for k in want)


def test_asks_of_many_groups_are_sent_in_parts(spark, monkeypatch):
    """What a task holds of the asks is bounded by their groups, too; the result doesn't depend on it."""
    items = spark.range(50).select(F.format_string("i%03d", "id").alias("item_id"), F.lit("x").alias("kind"), F.array(F.concat(F.lit("g"), F.col("id") % 5)).alias("groups"), F.array(F.lit(0)).alias("dims"), F.array(F.lit(1.0)).alias("weights"))
    asks = spark.createDataFrame([(f"q{n}", None, [0], [1.0], [(f"g{m}", 2) for m in range(5)]) for n in range(12)], "ask_id string, kinds array<string>, dims array<int>, weights array<double>, wanted array<struct<group: string, share: int>>")
    packed = blocks.pack(items, 10)
    whole = {tuple(r) for r in vector.group_tops(asks, packed, 2).collect()}
    sent, one = [], vector._round
    monkeypatch.setattr(vector, "_round", lambda some, *rest: (sent.append(some.count()), one(some, *rest))[1])
    monkeypatch.setattr(vector, "WANTED_BLOCK", 20)
    assert {tuple(r) for r in vector.group_tops(asks, packed, 2).collect()} == whole
    assert len(whole) == 12 * 5 * 2 and len(sent) == 3 and sum(sent) == 12


def test_a_search_moves_no_texts_to_show_its_few_hits(spark, tmp_path):
    from dossier.plans import retrieval

    spark.createDataFrame([("k1", "d", "rail"), ("k2", "d", "freight"), ("k1", "d", "rail")], "chunk_id string, document_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = retrieval.among(spark, str(tmp_path), spark.createDataFrame([("k1",), ("k1",)], "chunk_id string"), "text")
        assert [tuple(r) for r in shown.collect()] == [("k1", "rail")] * 2
        assert "SortMergeJoin" not in shown._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_keys_of_companies_sort_as_their_ids(spark, tmp_path):
    from dossier import views

    ids = [f"{n * 7919 % 300:x}-c" for n in range(300)]
    spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "company_id string").write.parquet(f"{tmp_path}/companies.parquet")
    keys = {r["company_id"]: r["key"] for r in views.company_keys(spark, str(tmp_path)).collect()}
    assert sorted(keys, key=keys.get) == sorted(set(ids)) and len(set(keys.values())) == 300
