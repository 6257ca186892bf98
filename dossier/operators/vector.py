"""Exact vector search in blocks of queries, and the cosine as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators import blocks

QUERY_BLOCK, ITEM_BLOCK = 16384, 8192  # asks sent to the tasks at once; items of a block
WANTED_BLOCK = 2**20  # groups of all asks sent at once
PASSED = 256  # asks whose best items a task passes on in one row
SLACK = 1e-6  # twice what rounding to 6 digits changes
PRODUCT_BLOCKS = 512, 2048  # queries and items of one matrix product


def dot(a: Column, b: Column) -> Column:
    """Sequential dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a length is 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows gathered in lists of about ``size``: (block, rows)."""
    count = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("block")).agg(F.collect_list(F.struct(key, "vector")).alias("rows"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar ``vectors(item_id, vector)`` of each of ``queries(query_id, vector)``.

    Exact. Queries and items are gathered in blocks of bounded size, the few query blocks are copied to every
    block of items; each pair of blocks is one
    matrix product, which passes on at most k candidates per query. NULL vectors take no part, a
    vector of length 0 has similarity 0. Scores are rounded to 6 digits, ties go to the smaller item.
    """
    asked = _blocks(queries.where("vector is not null").select("query_id", "vector"), "query_id", PRODUCT_BLOCKS[0])
    held = _blocks(vectors.where("vector is not null").select("item_id", "vector"), "item_id", PRODUCT_BLOCKS[1]).withColumnRenamed("rows", "items")
    last = held.agg(F.max("block")).first()[0]
    pairs = asked.select("rows", F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("block")).join(held, "block")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matrix(rows) -> np.ndarray:
            m = np.array([r["vector"] for r in rows], float)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

        for batch in batches:
            for ask, items in zip(batch["rows"], batch["items"]):
                ids = np.array([r["item_id"] for r in items])
                scores = np.round(matrix(ask) @ matrix(items).T, 6) + 0.0
                for query, row in zip(ask, scores):
                    order = np.lexsort((ids, -row))[:k]
                    yield pd.DataFrame({"query_id": query["query_id"], "item_id": ids[order], "score": row[order]})

    types = dict(queries.dtypes) | dict(vectors.dtypes)
    found = pairs.select("rows", "items").mapInPandas(product, f"query_id {types['query_id']}, item_id {types['item_id']}, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _dense(rows: pa.StructArray, size: int) -> np.ndarray:
    """The matrix of rows (..., dims, weights)."""
    dims, weights = rows.field("dims"), rows.field("weights")
    lengths = dims.value_lengths().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(rows), size))
    matrix[np.repeat(np.arange(len(rows)), lengths), dims.flatten().to_numpy()] = weights.flatten().to_numpy()
    return matrix


class _Tops:
    """The best items seen so far of one ask in each of its groups. Groups of one place hold it in ``least`` and ``last``, others in a list that is cut now and then."""

    def __init__(self, groups: np.ndarray, shares: np.ndarray) -> None:
        self.groups, self.shares = groups, shares
        self.least, self.last = np.full(len(groups), -np.inf), np.zeros(len(groups), "S1")  # what an item must beat
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many, self.listed = 2 * int(shares[shares > 1].sum()) + 64, 0

    def add(self, of: np.ndarray, scores: np.ndarray, names: np.ndarray, item: np.ndarray) -> None:
        """Items of the groups ``of``, in order of group and id; the ids are those of ``item`` in ``names``."""
        if self.last.dtype.itemsize < names.dtype.itemsize:
            self.last = self.last.astype(names.dtype)
        near = np.flatnonzero(scores >= self.least[of])
        of, scores, ids = of[near], scores[near], names[item[near]]  # few, in most blocks
        at = np.flatnonzero((scores > self.least[of]) | (ids < self.last[of]))
        if not len(at):
            return
        at = at[np.lexsort((-scores[at], of[at]))]  # stable: ids stay in order
        at = at[np.arange(len(at)) - np.searchsorted(of[at], of[at]) < self.shares[of[at]]]
        single = self.shares[of[at]] == 1
        one, more = at[single], at[~single]
        self.least[of[one]], self.last[of[one]] = scores[one], ids[one]
        if len(more):
            self.lists.append((of[more], scores[more], ids[more]))
            self.listed += len(more)
            if self.listed > self.many:
                self.cut()

    def cut(self) -> None:
        of, scores, ids = (np.concatenate(x) for x in zip(*self.lists))
        order = np.lexsort((ids, -scores, of))
        of, scores, ids = of[order], scores[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        full = place == self.shares[of] - 1
        self.least[of[full]], self.last[of[full]] = scores[full], ids[full]
        kept = place < self.shares[of]
        self.lists = [(of[kept], scores[kept], ids[kept])]
        self.listed = int(kept.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.lists:
            self.cut()
        one = np.flatnonzero((self.shares == 1) & (self.least > -np.inf))
        return tuple(np.concatenate(x) for x in zip((one, self.least[one], self.last[one]), *self.lists))


def group_tops(asks: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(ask_id, group, score, item_id, place): in each group of ``wanted``, its ``share`` best items for each ask.

    Needs asks(ask_id, kinds, dims, weights, wanted: [(group, share)]), where ``kinds`` are the kinds of items asked for (NULL: any),
    and items(item_id, kind, groups, dims, weights) with vectors of length 1, or what ``blocks.pack`` makes of them. Items lie in blocks of
    bounded size, whatever groups they are in, so that no group is ever in one place. Asks are sent to all tasks, ``QUERY_BLOCK`` of them and ``WANTED_BLOCK`` of their groups at a time; a task
    scores the items of an ask's groups block by block and passes on no more than ``share`` items per ask and group when it ends, ``PASSED`` asks to a compressed row. Every item
    with a vector takes part, also at similarity 0 or below. Scores are rounded to 6 digits, ties go to the smaller item.
    """
    held = blocks.gathered(items if items.columns == [blocks.PACKED] else blocks.pack(items, ITEM_BLOCK))
    count, wanted = asks.agg(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    rounds = max(1, -(-count // QUERY_BLOCK), -(-wanted // WANTED_BLOCK))
    sent = asks.select("ask_id", "kinds", "dims", "weights", "wanted")
    found = [_round(sent.where(F.pmod(F.xxhash64("ask_id"), F.lit(rounds)) == n), held, size, True).withColumn("round", F.lit(n)) for n in range(rounds)]
    passed = reduce(DataFrame.union, found).repartition(4 * rounds, "round", "some").sortWithinPartitions("round", "some")
    return passed.select("round", "some", "tops").mapInArrow(_merged, "ask_id string, group string, score double, item_id string, place long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of all tasks, of rows (round, some, tops) that are sorted."""

    def best(held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).unify_dictionaries().combine_chunks()
        ask, group, item = (rows[c].combine_chunks() for c in ("ask_id", "group", "item_id"))
        score = rows["score"].to_numpy()
        one = ask.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(group.dictionary) + 1) + group.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((np.array([i.encode() for i in item.to_pylist()], "S"), -score, one))
        one = one[order]
        place = np.arange(1, len(one) + 1) - np.searchsorted(one, one)
        kept = place <= rows["share"].to_numpy()[order]
        at = pa.array(order[kept])
        return pa.RecordBatch.from_arrays([ask.take(at).dictionary_decode(), group.take(at).dictionary_decode(), pa.array(score[order[kept]]), item.take(at), pa.array(place[kept])], names=["ask_id", "group", "score", "item_id", "place"])

    key, held = None, []
    for batch in batches:
        for *of, packed in zip(batch.column("round").to_pylist(), batch.column("some").to_pylist(), batch.column("tops")):
            if of != key and held:
                yield best(held)
                held = []
            key = of
            held.append(pa.ipc.open_stream(packed.as_buffer()).read_all())
    if held:
        yield best(held)


def _round(asks: DataFrame, held: DataFrame, size: int, packed: bool = False) -> DataFrame:
    """(ask_id, group, share, item_id, score): the best of every task for ``asks``; ``packed``, (some, tops): ``PASSED`` asks' rows at a time as a compressed table."""
    table = asks.toArrow().combine_chunks()
    column = lambda name: pa.concat_arrays(table[name].chunks) if table[name].chunks else pa.array([], table[name].type)
    lists = lambda c: np.concatenate(([0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    plain = lambda c: c.to_numpy(zero_copy_only=False)
    each = column("wanted").flatten()
    coded = each.field("group").dictionary_encode()
    codes, shares, ends = plain(coded.indices).astype(np.int32), plain(each.field("share")), lists(column("wanted"))
    kinds: dict = {}  # asks of the same kinds and groups follow each other and share what is looked up for these
    wants: dict = {}
    kind_of = np.array([kinds.setdefault(None if k is None else tuple(k), len(kinds)) for k in table["kinds"].to_pylist()], np.int64)
    want_of = np.array([wants.setdefault((codes[a:b].tobytes(), shares[a:b].tobytes()), (len(wants), codes[a:b], shares[a:b]))[0] for a, b in zip(ends[:-1], ends[1:])], np.int64)
    order = np.lexsort((want_of, kind_of))
    numbers = lists(column("dims")), plain(column("dims").flatten()), plain(column("weights").flatten())
    shared = asks.sparkSession.sparkContext.broadcast((column("ask_id"), order, kind_of, want_of, list(kinds), [(c, s) for _, c, s in wants.values()], coded.dictionary, *numbers))  # names of groups once, no copies in the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, order, kind_of, want_of, kinds, wants, names, ends, dim, weight = shared.value
        tops = [_Tops(*wants[want_of[n]]) for n in order]
        for block in blocks.unpack(batches):
            block.group_by(names)
            columns, by_id = block.columns(size), np.argsort(block.rank)
            kind = want = None
            for n, top in zip(order, tops):
                if kind_of[n] != kind:
                    kind, want = kind_of[n], None
                    fit = by_id if kinds[kind] is None else by_id[block.of_kinds(kinds[kind])[by_id]]
                    fitting, named = columns[:, fit], block.ids[fit]
                    at = np.full(len(by_id), -1)
                    at[fit] = np.arange(len(fit))
                if want_of[n] != want:
                    want = want_of[n]
                    members = _Members(block, top, at)
                if not len(members.item):
                    continue
                v = slice(ends[n], ends[n + 1])
                scores = members.scores(dim[v], weight[v], fitting)
                near = members.near(scores, top)
                if len(near):
                    top.add(members.of[near], np.round(scores[near], 6) + 0.0, named, members.item[near])
        for first in range(0, len(tops), PASSED):
            some = tops[first : first + PASSED]
            rows = [t.rows() for t in some]
            of = np.concatenate([t.groups[r[0]] for t, r in zip(some, rows)])
            share = np.concatenate([t.shares[r[0]] for t, r in zip(some, rows)])
            ask = ids.take(pa.array(np.repeat(order[first : first + PASSED], [len(r[0]) for r in rows])))
            item = pa.array([i.decode() for r in rows for i in r[2].tolist()], pa.string())
            best = [ask, names.take(pa.array(of)), pa.array(share, pa.int32()), item, pa.array(np.concatenate([r[1] for r in rows]))]
            if not packed:
                yield pa.RecordBatch.from_arrays(best, names=["ask_id", "group", "share", "item_id", "score"])
                continue
            best = pa.table([best[0].dictionary_encode(), best[1].dictionary_encode(), *best[2:]], names=["ask_id", "group", "share", "item_id", "score"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, best.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(best)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["some", "tops"])

    return held.mapInArrow(run, "some int, tops binary" if packed else "ask_id string, group string, share int, item_id string, score double")


class _Members:
    """The items of a block that are in the groups of an ask, and of its kinds: ``item`` are their places, -1 in ``at`` for those of other kinds."""

    def __init__(self, block: blocks.Block, top: _Tops, at: np.ndarray) -> None:
        of, item = block.items(top.groups)
        item = at[item]
        self.of, self.item = of[item >= 0], item[item >= 0]
        self.starts = np.flatnonzero(np.diff(self.of, prepend=-1))
        self.present = self.of[self.starts]
        self.counts = np.diff(self.starts, append=len(self.of))
        self.single = top.shares[self.present] == 1
        self.all = len(self.item) == (at >= 0).sum() and len(self.present) == 1

    def scores(self, dim: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if not len(dim):
            return np.zeros(len(self.item))
        if self.all:
            return weight @ columns[dim]
        if 4 * len(self.item) < columns.shape[1]:
            return weight @ columns[dim[:, None], self.item]
        return (weight @ columns[dim])[self.item]  # each item once, whatever groups it is in

    def near(self, scores: np.ndarray, top: _Tops) -> np.ndarray:
        """Those that may, when rounded, be among the best of their groups."""
        bound = top.least[self.present] - SLACK
        if self.single.any():
            best = np.maximum.reduceat(scores, self.starts) - SLACK
            bound = np.where(self.single, np.maximum(bound, best), bound)
        return np.flatnonzero(scores >= (bound[0] if len(bound) == 1 else np.repeat(bound, self.counts)))


def leader_clusters(rows: DataFrame, threshold: float) -> DataFrame:
    """Greedy near-duplicate removal within small groups: (group, kept).

    ``rows(group, item, score, vector)``: items are visited by score, then id; one is kept unless
    its cosine to an item kept before reaches ``threshold`` (inclusive). NULL vectors are always
    kept. A group is one query's hits, which are bounded by the k of the search.
    """
    ordered = rows.groupBy("group").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item", "vector"))).alias("hits"))
    kept = F.aggregate(
        "hits",
        F.filter("hits", lambda h: F.lit(False)),
        lambda keep, h: F.when(F.exists(keep, lambda x: F.coalesce(F.round(cosine(x.vector, h.vector), 6) >= threshold, F.lit(False))), keep).otherwise(F.concat(keep, F.array(h))),
    )
    return ordered.select("group", F.explode(kept).alias("k")).select("group", F.col("k.item").alias("kept"))


def merge_near(hits: DataFrame, threshold: float, size: int) -> DataFrame:
    """Near-duplicate removal within each search's hits: (group, item_id, corroborated_by).

    ``hits(group, item_id, document_id, checksum, score, place, dims, weights)``: hits are visited by score, best first, then by ``place``; one is
    kept unless it has the checksum of a hit kept before, or a cosine of at least ``threshold`` to one (a NULL or empty vector is similar
    to nothing). ``corroborated_by`` are the other documents of what a kept hit stands for, sorted; of the same document leaves no trace. A
    group is the hits of one question, a few dozen.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks().sort_by([("score", "descending"), ("place", "ascending")])
        vectors = _dense(rows.select(["dims", "weights"]).to_struct_array().combine_chunks(), size) if len(rows) else np.zeros((0, size))
        same = np.round(vectors @ vectors.T, 6) >= threshold
        checksums, documents = rows["checksum"].to_pylist(), rows["document_id"].to_pylist()
        kept: list[int] = []
        others: dict[int, set] = {}
        for n in range(len(rows)):
            of = next((k for k in kept if checksums[k] == checksums[n] or same[k, n]), None)
            if of is None:
                kept.append(n)
            elif documents[n] != documents[of]:
                others.setdefault(of, set()).add(documents[n])
        taken = rows.take(pa.array(kept, pa.int64()))
        return pa.table({"group": taken["group"], "item_id": taken["item_id"], "corroborated_by": pa.array([sorted(others.get(n, ())) for n in kept], pa.list_(pa.string()))})

    filled = hits.select("group", "item_id", "document_id", "checksum", "score", "place", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("dims", "array<int>"), ("weights", "array<double>"))))
    return filled.groupBy("group").applyInArrow(run, "group string, item_id string, corroborated_by array<string>")
