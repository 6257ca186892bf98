from datetime import datetime

import pytest

from dossier.operators.references import dangling_by_period, dangling_references, record_references

T = [datetime(2024, m, 1) for m in range(1, 13)]


def tables(spark, refs, targets):
    return (
        spark.createDataFrame(refs, "target string, target_id string, created_at timestamp, deleted string, state int"),
        spark.createDataFrame(targets, "target string, target_id string, deleted boolean, since timestamp"),
    )


def test_states_hot_and_cold_alike(spark):
    targets = [("chunk", "hot", False, T[5]), ("chunk", "hot", False, T[3]), ("chunk", "gone", True, T[0]), ("chunk", "gone", False, T[0]), ("chunk", "ok", False, None), ("document", "miss", False, T[0]), ("chunk", None, False, T[0])]
    refs = [("chunk", "hot", T[2], "x", 1)] * 3000 + [("chunk", "hot", T[4], "x", 1)] * 3000 + [("chunk", "miss", T[4], "x", 1)] * 2000
    refs += [("chunk", f"n{i}", T[1], None, 1) for i in range(500)] + [("chunk", "gone", T[4], "x", 1), ("chunk", "ok", T[0], "x", 1), ("document", "miss", T[4], "x", 1), (None, None, T[0], "x", 1), ("chunk", "hot", None, "x", 1), ("chunk", "absent", None, "x", None)]
    found = dangling_references(*tables(spark, refs, targets)).groupBy("target", "target_id", "state", "period").count().collect()
    got = {(r["target"], r["target_id"], r["state"], r["period"]): r["count"] for r in found if not r["target_id"].startswith("n")}
    assert got == {("chunk", "hot", "late", "2024-03"): 3000, ("chunk", "miss", "missing", "2024-05"): 2000, ("chunk", "gone", "deleted", "2024-05"): 1, ("chunk", "absent", "missing", None): 1}
    assert sum(r["count"] for r in found if r["target_id"].startswith("n")) == 500


def test_empty(spark):
    assert dangling_references(*tables(spark, [], [])).count() == 0
    assert [r["state"] for r in dangling_references(*tables(spark, [("chunk", "a", T[0], None, 1)], [])).collect()] == ["missing"]


def test_markers_and_spellings(spark):
    evidence = spark.createDataFrame([(1, " AbC ", "", T[0], T[1]), (1, " AbC ", "", T[0], T[2]), (2, None, "d", T[0], T[1])], "evidence_id long, chunk_id string, document_id string, created_at timestamp, loaded_at timestamp")
    text = "x [chunk:A1] (chunk:no) [Chunk: b2 , CHUNK:c3;chunk:d4 ] [doc:zz] [chunk:] [see chunk:e5] chunk:no2 [chunk:A1] [[chunk:f6]"
    reports = spark.createDataFrame([(7, text, T[0], T[1]), (8, None, T[0], T[1]), (9, "", None, T[1])], "report_id long, narrative string, created_at timestamp, loaded_at timestamp")
    got = {(r["src_table"], r["row_id"], r["src_field"], r["target_id"]) for r in record_references(evidence, reports).collect()}
    assert got == {("evidence", 1, "chunk_id", "abc"), ("evidence", 2, "document_id", "d")} | {("reports", 7, "narrative", i) for i in ("a1", "b2", "c3", "d4", "e5", "f6")}
    assert record_references(evidence, reports).count() == len(got)


def test_counts_by_period_are_those_of_the_rows(spark):
    """Keys of every state, hot and cold, with references before, in and after the month of arrival; in any session's time zone."""
    late = datetime(2024, 5, 10)
    targets = [("chunk", "late", False, late), ("chunk", "cold", False, late), ("chunk", "gone", True, T[0]), ("chunk", "ok", False, None)]
    days = [datetime(2024, m, d, 23, 30) for m in (4, 5, 6) for d in (1, 9, 11, 30)]
    refs = [("chunk", k, day) for day in days for k in ["late"] * 400 + ["cold", "gone", "miss", "ok"]] + [("chunk", "miss", None), ("chunk", "late", None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    table = spark.createDataFrame([(*r, "t", "f") for r in refs], "target string, target_id string, created_at timestamp, src_table string, src_field string")
    known = spark.createDataFrame(targets, "target string, target_id string, deleted boolean, since timestamp")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = {(r["period"], r["state"]): (r["orphans"], r["targets"]) for r in dangling_by_period(table, known).collect()}
        rows = dangling_references(table, known).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = {}
    for r in rows:
        want.setdefault((r["period"], r["state"]), []).append(r["target_id"])
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert got["2024-04", "late"] == (4 * 401, 2) and got["2024-05", "late"] == (2 * 401, 2) and ("2024-06", "late") not in got and got[None, "missing"] == (1, 1)
