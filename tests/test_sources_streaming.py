import json

from dossier import views
from dossier.sources import feeds
from dossier.streaming import runs

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Wire</title>
<item><title>One</title><link>https://example.com/1</link><guid>g1</guid><pubDate>Mon, 06 Jul 2026 10:00:00 GMT</pubDate><description>Body one</description></item>
<item><title>Two</title><link>https://example.com/2</link><description>Body two</description></item>
<item><guid>g3</guid></item><item><title>No id</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    rows = {r["native_id"]: r for r in feeds.read_rss(spark, str(tmp_path / "f.xml")).collect()}
    assert set(rows) == {"g1", "https://example.com/2"}
    assert rows["g1"]["body"] == "<h1>One</h1>\nBody one" and str(rows["g1"]["published_at"]) == "2026-07-06 10:00:00"


def test_registry(spark, tmp_path):
    entries = {"0": {"cik_str": 7, "ticker": "AAA", "title": "Acme Widgets Inc."}, "1": {"cik_str": 8, "ticker": "B", "title": "Bcd"}, "2": {"cik_str": 7, "ticker": "AAB", "title": "Acme Widgets Inc. B"}}
    (tmp_path / "r.json").write_text(json.dumps(entries))
    rows = {r["cik"]: r for r in feeds.read_registry(spark, str(tmp_path / "r.json")).collect()}
    assert rows["7"]["name"] == "Acme Widgets Inc." and rows["7"]["tickers"] == ["AAA", "AAB"] and rows["7"]["aliases"] == ["Acme Widgets"] and rows["8"]["aliases"] == []


def test_filings(spark):
    n = 9
    body = json.dumps({"filings": {"recent": {"form": ["10-K", "4"] * 4 + ["10-K"], "accessionNumber": [f"00-{i}" for i in range(n)], "primaryDocument": ["a.htm"] * 2 + [""] + ["a.htm"] * 6, "filingDate": ["2024-01-01"] * n}}})
    rows = feeds.read_filings(spark.createDataFrame([("0007", body), ("8", "{broken")], "cik string, body string"), ["10-K"], 3).collect()
    assert [r["accession"] for r in rows] == ["00-0", "00-4", "00-6"] and rows[0]["url"].endswith("/data/7/000/a.htm")


def test_content_addressed(spark, tmp_path):
    pages = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    for _ in range(2):
        feeds.write_content_addressed(pages, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_streaks(spark, tmp_path):
    rows = [(1, 0, "failure"), (1, 1, "failure"), (2, 0, "failure"), (1, 2, "success"), (2, 1, "failure")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "document long, at long, status string").coalesce(1).write.parquet(source)
    stream = runs.failure_streaks(spark.readStream.schema("document long, at long, status string").parquet(source))
    query = stream.writeStream.outputMode("update").format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from streaks").collect()} == {(1, 0), (2, 2)}


def test_files_in_any_order_lose_nothing(spark, tmp_path):
    """Days in separate files, the last one first: hours in the stream are those of the table."""
    from datetime import datetime, timedelta

    first = datetime(2024, 1, 1)
    for day in (9, 0, 5, 2):
        rows = [(day * 100 + i, first + timedelta(days=day, minutes=37 * i), 1, "error" if i % 3 else "view", 1.0) for i in range(30)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    counted = {(r["stage"], str(r["window"]["start"])): (r["runs"], r["failures"]) for r in runs.hourly_stream(spark, str(tmp_path)).collect()}
    table = runs.hourly(views.runs(spark, str(tmp_path)))
    assert counted == {(r["stage"], str(r["window"]["start"])): (r["runs"], r["failures"]) for r in table.collect()} and len(counted) > 60
