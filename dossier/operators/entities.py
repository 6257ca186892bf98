"""Mentions of listed companies in texts, with their places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.views import CASHTAG, EXCHANGE_TAG

SHORTEST = 4
MOST = 100_000  # listed companies that are sent to every task


class Matcher:
    """Names and aliases (longest first, not inside a word, starting with a capital), then tickers in tags.

    A surface that two companies share belongs to the smaller id.
    """

    def __init__(self, listed: list[tuple[str, str, list[str], list[str]]]) -> None:
        self.names: dict[str, str] = {}
        self.tickers: dict[str, str] = {}
        for company, name, tickers, aliases in sorted(listed, key=lambda row: row[0]):
            for surface in (name, *(aliases or [])):
                if surface and len(surface.strip()) >= SHORTEST:
                    self.names.setdefault(surface.strip().lower(), company)
            for ticker in tickers or []:
                self.tickers.setdefault(ticker, company)
        by_head: dict[str, list[str]] = {}
        for surface in self.names:
            by_head.setdefault(re.match(r"\w*", surface)[0], []).append(surface)
        self.by_head = {head: sorted(found, key=lambda s: (-len(s), s)) for head, found in by_head.items()}

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Half-open places in order; an earlier pass claims its characters."""
        low = text.lower()
        if len(low) != len(text):  # lower case of a few letters is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: list[tuple[int, int, str]] = []
        end = 0
        for word in re.finditer(r"\w+", low):
            start = word.start()
            if start < end or word[0] not in self.by_head or not text[start].isupper():
                continue
            for surface in self.by_head[word[0]]:
                stop = start + len(surface)
                if low.startswith(surface, start) and not (stop < len(low) and (low[stop].isalnum() or low[stop] == "_")):
                    hits.append((start, stop, self.names[surface]))
                    end = stop
                    break
        for pattern in (CASHTAG, EXCHANGE_TAG):
            for tag in re.finditer(pattern, text):
                company = self.tickers.get(tag[1])
                if company and not any(a < tag.end() and tag.start() < b for a, b, _ in hits):
                    hits.append((tag.start(), tag.end(), company))
        return sorted(hits)


def _mentions(matcher: Matcher, key, text: str | None) -> list[tuple]:
    return [(key, company, start, end) for start, end, company in matcher.find(text)] if text else []


def _batch(found: list[tuple], key: str) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[], [], [], []]
    types = (pa.string(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "company_id", "char_start", "char_end"])


def _candidates(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """``texts`` with ``listed``: the companies of whose surfaces or tickers a text has the first word."""
    surfaces = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("tickers", F.array().cast("array<string>")))
    first_word = lambda c: F.regexp_extract(F.lower(F.trim(c)), r"^[\p{L}\p{N}_]*", 0)
    heads = listed.select(F.explode(surfaces).alias("s"), F.struct("company_id", "name", "tickers", "aliases").alias("company")).select(first_word(F.col("s")).alias("head"), "company").distinct()
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("head"))
    return texts.join(words.join(heads, "head").groupBy(key).agg(F.collect_set("company").alias("listed")), key)


def find_entities(texts: DataFrame, key: str, text: str, listed: DataFrame, most: int = MOST) -> DataFrame:
    """(key, company_id, char_start, char_end) for ``listed(company_id, name, tickers, aliases)``; ``key`` is unique.

    A list of up to ``most`` companies is sent to every task. Of a longer one, each text gets the companies that have a
    surface or ticker whose first word it has, by an equality join.
    """
    schema = f"{key} string, company_id string, char_start int, char_end int"
    head = listed.limit(most + 1).collect()
    if len(head) > most:

        def run_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k, t, rows in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), batch.column("listed").to_pylist()):
                    found += _mentions(Matcher([(r["company_id"], r["name"], r["tickers"], r["aliases"]) for r in rows]), k, t)
                yield _batch(found, key)

        return _candidates(texts.select(F.col(key).cast("string").alias(key), text), key, text, listed).select(key, text, "listed").mapInArrow(run_each, schema)
    shared = texts.sparkSession.sparkContext.broadcast([(r["company_id"], r["name"], r["tickers"], r["aliases"]) for r in head])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            yield _batch([m for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()) for m in _mentions(matcher, k, t)], key)

    return texts.select(key, text).mapInArrow(run, schema)
