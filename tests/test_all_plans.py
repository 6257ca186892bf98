"""Searches of all plans, whatever their ids, on small tables."""

from datetime import datetime

import pytest

from dossier.plans import evidence, retrieval

SEEN = datetime(2024, 6, 1)
PLANS = "plan_id long, investigation_id string, version int, companies array<string>, doc_types array<string>, queries array<string>, created_at timestamp, loaded_at timestamp, question string"
DOCUMENTS = "doc_id long, document_id string, feed_id int, source string, publisher string, doc_type string, title string, published_at string, ingested_at timestamp, text string, url string"
CHUNKS = "chunk_id string, document_id string, position int, pipeline_version int, text string, loaded_at timestamp, deleted_at timestamp"
EVIDENCE = "evidence_id long, investigation_id string, chunk_id string, document_id string, stance string, query string, created_at timestamp, loaded_at timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    """Plans 7, 100 and 101 on two companies, of which each has one document."""
    texts = {"d1": "Alphazon rail freight", "d2": "Betacorp copper mine"}
    plans = [(7, "i", ["Alphazon"], ["rail freight"], "rail freight"), (100, "j", ["Betacorp"], ["copper mine"], "copper mine"), (101, "k", ["Betacorp"], ["mine", "copper"], "Betacorp copper")]
    tables = {
        "documents": ([(i, d, 1, "rss", "p", "news", "t", None, SEEN, t, None) for i, (d, t) in enumerate(texts.items())], DOCUMENTS),
        "chunks": ([(f"k-{d}", d, 0, 1, t, SEEN, None) for d, t in texts.items()], CHUNKS),
        "companies": ([("c1", "Alphazon Systems Inc.", ["ALZ"], ["Alphazon"]), ("c2", "Betacorp", ["BET"], [])], "company_id string, name string, tickers array<string>, aliases array<string>"),
        "feeds": ([(1, "UTC", "en-GB")], "feed_id int, time_zone string, locale string"),
        "research_plans": ([(p, i, 1, c, [], q, SEEN, SEEN, asked) for p, i, c, q, asked in plans], PLANS),
        "evidence": ([(1, "i", "k-d1", "d1", "supporting", "rail freight", SEEN, SEEN), (2, "k", "k-d1", "d1", "unknown", "mine", SEEN, SEEN)], EVIDENCE),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


ASKED = {("7-0-c1", "k-d1"), ("100-0-c2", "k-d2"), ("101-0-c2", "k-d2"), ("101-1-c2", "k-d2")}


def test_the_search_takes_every_plan(spark, folder):
    assert {(r["ask_id"], r["chunk_id"]) for r in retrieval.hybrid_search(spark, folder).collect()} == ASKED


def test_a_replay_takes_every_plan(spark, folder):
    got = {tuple(r) for r in evidence.replay_match(spark, folder).select("plan_id", "recorded", "again", "both", "same").collect()}
    assert got == {(7, 1, 1, 1, True), (100, 0, 1, 0, False), (101, 1, 1, 0, False)}  # of 101's two queries the first brings up the chunk


def test_an_evaluation_takes_every_plan(spark, folder):
    got = evidence.retrieval_eval(spark, folder).first().asDict()
    assert (got["questions"], got["skipped"], got["hit_rate_3"], got["mrr"]) == (3, 0, 1.0, 1.0)


def test_the_semantic_signal_takes_every_plan(spark, folder):
    assert {(r["ask_id"], r["chunk_id"]) for r in retrieval.semantic_signal(spark, folder).collect()} == ASKED
