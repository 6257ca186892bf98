"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.operators import references, timestamps
from dossier.plans import evidence, graph, ingest, metrics, retrieval, text
from dossier.view_sql import with_views

MODULES = (text, retrieval, graph, evidence, metrics, ingest)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": references.p2_found,
    "p2_by_period": references.p2_by_period,
    "p3_found": timestamps.p3_found,
    "p3_states": timestamps.p3_states,
    "p3_ambiguous": timestamps.p3_ambiguous,
}

SQL: dict[str, str] = {
    "p3_found": with_views("time", "select src_table, row_id, published_us from usable"),
    "p2_found": references.P2_FOUND_SQL,
    "p2_by_period": references.P2_BY_PERIOD_SQL,
}

for module in MODULES:
    QUERIES |= module.QUERIES
    SQL |= module.SQL
