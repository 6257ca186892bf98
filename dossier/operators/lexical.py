"""Full-text search over an inverted table: all terms must match, BM25 ranks.

The index is one row per text with its terms and their counts (``functions.text.text_features``), packed in blocks with those
terms only that are asked for. A block is inverted and its lists of texts are intersected where it lies; what passes on is an ask's best. Stop words match nothing and are ignored in queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import terms_of
from dossier.operators import blocks
from dossier.session import cut_lineage

K1, B = 1.2, 0.75
QUERY_BLOCK, ITEM_BLOCK = 16384, 16384  # asks sent to the tasks at once; texts of a block

# Common English words that a search ignores.
STOP_WORDS = "a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was will with".split()


def _terms(queries: DataFrame) -> DataFrame:
    """``queries`` with ``terms``, the distinct ones that a text must have."""
    return queries.withColumn("terms", F.filter(F.array_distinct(terms_of(F.col("query"))), lambda t: ~t.isin(STOP_WORDS)))


def vocabulary(queries: DataFrame) -> list[str]:
    """All terms of ``queries(query)``, which go to every task: no more than the questions of a search have different words."""
    return sorted(r["term"] for r in _terms(queries.select("query").distinct()).select(F.explode("terms").alias("term")).distinct().collect())


def _coded(index: DataFrame, words: list[str]) -> DataFrame:
    """``index(item_id, terms, tfs, length)`` with the codes of the terms among ``words`` instead of all terms."""
    shared = index.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = pa.array(shared.value, pa.string())
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            code = pc.index_in(terms.flatten(), sought).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[code >= 0], minlength=len(terms))))), pa.int32())
            made = (pa.ListArray.from_arrays(ends, pa.array(x[code >= 0], pa.int32())) for x in (code, tfs.flatten().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *made, batch.column("length").cast(pa.int32())], names=["item_id", "codes", "tfs", "length"])

    return index.select("item_id", "terms", "tfs", "length").mapInArrow(run, "item_id string, codes array<int>, tfs array<int>, length int")


def _statistics(held: DataFrame, words: int) -> tuple[np.ndarray, float, float]:
    """Texts per code, the number of texts and their mean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(words + 2, np.int64)
        for block in blocks.unpack(batches):
            totals[:words] += np.bincount(block.lists("codes")[1].to_numpy(zero_copy_only=False), minlength=words)
            totals[words:] += len(block.ids), pc.sum(block.table["length"]).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words + 2)), pa.array(totals)], names=["code", "n"])

    sums = np.zeros(words + 2)
    for r in held.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most two more than there are terms
        sums[r["code"]] = r["n"]
    return sums[:words], sums[words], sums[words + 1] / max(sums[words], 1)


def tops(asks: DataFrame, held: DataFrame, words: list[str], limit: int | None) -> DataFrame:
    """(ask_id, item_id, score): for each of ``asks(ask_id, query, company_id, kinds)`` the texts that have all its terms and pass its filters.

    ``held`` has the texts in blocks (``blocks.pack``) with codes among ``words``. With a ``limit``, a task passes on that many of the
    best of an ask, so that the best of all are among the rows. Scores are rounded to 6 digits. A query without terms finds nothing.
    """
    held = blocks.gathered(held)
    df, texts, mean = _statistics(held, len(words))
    asks = cut_lineage(_terms(asks).where(F.size("terms") > 0).select("ask_id", "terms", "company_id", "kinds"))
    rounds = max(1, -(-asks.count() // QUERY_BLOCK))
    idf = np.log(1 + (texts - df + 0.5) / (df + 0.5))
    return reduce(DataFrame.union, (_round(asks.where(F.pmod(F.xxhash64("ask_id"), F.lit(rounds)) == n), held, words, idf, mean, limit) for n in range(rounds)))


def _round(asks: DataFrame, held: DataFrame, words: list[str], idf: np.ndarray, mean: float, limit: int | None) -> DataFrame:
    shared = asks.sparkSession.sparkContext.broadcast((asks.toArrow(), words, idf, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, idf, mean = shared.value
        code_of = {w: n for n, w in enumerate(words)}
        of_terms: dict[tuple, list] = {}
        for ask, terms, company, kinds in zip(*(table[c].to_pylist() for c in ("ask_id", "terms", "company_id", "kinds"))):
            of_terms.setdefault(tuple(code_of[t] for t in terms), []).append((ask, company, None if kinds is None else tuple(kinds)))
        companies = sorted({c for asked in of_terms.values() for _, c, _ in asked if c is not None})
        number = {c: n for n, c in enumerate(companies)}
        all_kinds = {k for asked in of_terms.values() for _, _, k in asked if k is not None}
        best: dict[str, list] = {}

        def cut(rows: list) -> list:
            scores, ids = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((ids, -scores))[:limit]
            return [(scores[order], ids[order])]

        def out(ask: str, rows: list) -> pa.RecordBatch:
            scores, ids = (np.concatenate(x) for x in zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array([ask] * len(ids), pa.string()), pa.array([i.decode() for i in ids.tolist()], pa.string()), pa.array(scores)], names=["ask_id", "item_id", "score"])

        for block in blocks.unpack(batches):
            row, code = block.lists("codes")
            code, tf = code.to_numpy(zero_copy_only=False), block.lists("tfs")[1].to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            row, tf = row[order], tf[order]
            starts = np.searchsorted(code[order], np.arange(len(words) + 1))
            rest = K1 * (1 - B + B * block.table["length"].to_numpy() / (mean or 1))
            block.group_by(pa.array(companies, pa.string()), vectors=False)
            fits = {k: block.of_kinds(k) for k in all_kinds}
            for codes, asked in of_terms.items():
                found = min((row[starts[c] : starts[c + 1]] for c in codes), key=len)
                for c in codes:
                    mine = row[starts[c] : starts[c + 1]]
                    if not len(found):
                        break
                    found = found[mine[np.minimum(np.searchsorted(mine, found), len(mine) - 1)] == found]
                if not len(found):
                    continue
                places = [starts[c] + np.searchsorted(row[starts[c] : starts[c + 1]], found) for c in codes]
                scores = np.round(sum(idf[c] * tf[p] * (K1 + 1) / (tf[p] + rest[found]) for c, p in zip(codes, places)), 6)
                for ask, company, kinds in asked:
                    fit = np.ones(len(found), bool) if kinds is None else fits[kinds][found]
                    if company is not None:
                        fit &= np.isin(found, block.items(np.array([number[company]]))[1])
                    if not fit.any():
                        continue
                    rows = [(scores[fit], block.ids[found[fit]])]
                    if limit is None:
                        yield out(ask, rows)
                        continue
                    held = best.setdefault(ask, [])
                    held += rows
                    if sum(len(r[0]) for r in held) > 4 * limit:
                        best[ask] = cut(held)
        for ask, rows in best.items():
            yield out(ask, cut(rows))

    return held.mapInArrow(run, "ask_id string, item_id string, score double")


def scores(queries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(query, key, score): all texts of ``index(key, terms, tfs, length)`` that have all terms of each distinct ``query``."""
    words = vocabulary(queries)
    held = cut_lineage(blocks.pack(_coded(index.withColumnRenamed(key, "item_id"), words), ITEM_BLOCK))
    none = [F.lit(None).cast("string").alias("company_id"), F.lit(None).cast("array<string>").alias("kinds")]
    found = tops(queries.where("query is not null").select(F.col("query").alias("ask_id"), "query", *none).distinct(), held, words, None)
    return found.select(F.col("ask_id").alias("query"), F.col("item_id").alias(key), "score")
