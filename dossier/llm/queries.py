"""Queries of this subpackage and, where SQL can state them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.entity_names import p1_found, p1_unmatched
from dossier.llm.keyword_pages import p8_found, p8_scores
from dossier.llm.mixing import p7_mix, p7_shares
from dossier.llm.near_duplicates import P5_FOUND_SQL, p5_found, p5_groups
from dossier.llm.packing import p6_fill, p6_pack
from dossier.llm.repeated_lines import P4_FOUND_SQL, p4_clean, p4_found, p4_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p4_lines": p4_lines,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}

SQL: dict[str, str] = {
    "p4_found": P4_FOUND_SQL,
    "p5_found": P5_FOUND_SQL,
}
