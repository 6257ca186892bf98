"""Every registered query on the smallest data, against its SQL where it has one."""

import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = sorted(entry.plans.QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    rows = entry.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name in entry.oracle_sql():
        found = duck.sql(entry.oracle_sql()[name])
        assert sorted(found.columns) == columns
        assert got == sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["ask_id", "rank", "chunk_id", "document_id", "title", "url", "source", "doc_type", "text", "score", "signals", "places"]
    assert found.count() > 0


def test_core_does_not_need_llm():
    package = os.path.join(os.path.dirname(entry.__file__), "dossier")
    for path in glob.glob(f"{package}/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "dossier.llm" not in open(path).read(), path
