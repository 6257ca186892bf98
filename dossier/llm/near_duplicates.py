"""Near-duplicate records by Golay-code fuzzy hashing.

A record's fingerprint has ``segments`` segments. A segment is a 23-bit word, each bit the parity
of the smallest hash of the record's words under its own hash function, so that two records differ
in a bit with half the probability that they differ in a minimum, and a prefix of ``prefix_bits``
bits of the smallest hash of their two-word sequences, which spreads the records. A word is decoded
to the codeword indices near it (``golay.nearby_indices``): words that differ in at most two bits
always share one. The differing bits of two similar records are spread over all segments, so that,
by the pigeonhole principle, some segments have at most two of them. Records that share (segment,
prefix, index) are compared by ``TAGS`` bytes, the smallest hashes of their word sequences;
what passes is verified on the full sets of word sequences. No bucket is cut off.

The prefix has the same number of bits at every size, so that whether a pair is found depends on its
two records alone. It is long: two records hardly ever share it unless they share the minimum.

Records with equal words form a class. Pairs are found between classes, so that a group of copies,
however large, is one record here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.golay import LENGTH, nearby_indices
from dossier.llm.words import MIX, MIX2, batch_shingles, batch_words, scramble
from dossier.operators.graph import components
from dossier.session import cut_lineage, read_table, spread

TAGS = 32  # bytes of a record that candidates are compared by
NEAR = 4  # bits in which the words of candidates differ at most
PREFIX_BITS = 30  # of a segment, at every size
HOT_ROWS = 200_000  # records of one segment and prefix from which they are decoded before they are shuffled
SKETCH = "id string, cls long, n int, words array<int>, prefixes array<int>, tags binary"
ROWS = "key long, word int, cls long, tags binary"


def least_tags(threshold: float) -> int:
    """How many tags records of this similarity share, but for one pair in a thousand."""
    below = 0.0
    for k in range(TAGS + 1):
        below += math.comb(TAGS, k) * threshold**k * (1 - threshold) ** (TAGS - k)
        if below > 0.001:
            return k
    return TAGS


def _minima(rows: np.ndarray, values: np.ndarray, count: int, functions: int, seed: int, kind=np.uint16) -> np.ndarray:
    """Smallest hash of each row's values under each of ``functions`` hash functions: (count, functions); rows in order, none empty."""
    each = 8 // np.dtype(kind).itemsize
    names, at = np.unique(values, return_inverse=True)
    starts = np.searchsorted(rows, np.arange(count))
    found = np.empty((count, functions), kind)
    for first in range(0, functions, 64):
        most = min(64, functions - first)
        salts = scramble(np.arange(first // each, -(-(first + most) // each), dtype=np.uint64) + np.uint64(seed << 32))
        hashes = scramble(names[:, None] ^ salts[None, :]).view(kind)[:, :most]
        for a in range(0, count, 256):  # so many rows' hashes at once
            b = min(count, a + 256)
            low, high = starts[a], starts[b] if b < count else len(at)
            found[a:b, first : first + most] = np.minimum.reduceat(hashes[at[low:high]], starts[a:b] - low, axis=0)
    return found


def sketches(records: DataFrame, words: int, segments: int) -> DataFrame:
    """Fingerprints of ``records(id string, record string)``: class, number of word sequences, segment words, prefixes, tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, _ = batch_words(batch.column("record"))
            count = batch.num_rows
            starts = np.searchsorted(rows, np.arange(count + 1))
            cls = np.fromiter((xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])), np.uint64, count).view(np.int64)
            row, grams, _ = batch_shingles(rows, hashes, words)
            sizes = np.bincount(row, minlength=count).astype(np.int32)
            full = np.flatnonzero(sizes)  # the records that have word sequences
            place = np.cumsum(sizes > 0) - 1
            word, prefix, tags = np.zeros((count, segments), np.int32), np.zeros((count, segments), np.int32), np.zeros((count, TAGS), np.uint8)
            if len(full):
                mine = sizes[rows] > 0
                single, one, _ = batch_shingles(rows[mine], hashes[mine], 1)
                bits = _minima(place[single], one, len(full), segments * LENGTH, 1) & np.uint16(1)
                word[full] = bits.reshape(len(full), segments, LENGTH) @ (1 << np.arange(LENGTH))
                double, two, _ = batch_shingles(rows[mine], hashes[mine], min(2, words))
                prefix[full] = _minima(place[double], two, len(full), segments, 2, np.uint32).view(np.int32)
                tags[full] = (_minima(place[row], grams, len(full), TAGS, 3) & np.uint16(255)).astype(np.uint8)
            ends = np.arange(0, (count + 1) * segments, segments, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(cls),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(word.ravel())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.ravel())),
                    pa.array([t.tobytes() for t in tags], pa.binary()),
                ],
                names=["id", "cls", "n", "words", "prefixes", "tags"],
            )

    return records.mapInArrow(run, SKETCH)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per codeword index near the word; the index becomes a part of the key."""
    for batch in batches:
        at, code = nearby_indices(batch.column("word").to_numpy().astype(np.uint32))
        take = pa.array(at)
        key = scramble(batch.column("key").to_numpy().view(np.uint64)[at] ^ (code.astype(np.uint64) * MIX)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c).take(take) for c in ("word", "cls", "tags"))], names=["key", "word", "cls", "tags"])


def _matches(least: int, decoded: bool):
    """Pairs (a, b) that share a key and, unless rows are ``decoded``, an index; the rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, (None,)):
            table = pa.concat_tables([t for t in (held, batch and pa.Table.from_batches([batch])) if t is not None]) if held or batch else None
            if table is None or not len(table):
                continue
            key = table["key"].to_numpy()
            done = len(key) if batch is None else int(np.searchsorted(key, key[-1]))  # the last key may go on
            if batch is not None:
                held = table.slice(done)
            if not done:
                continue
            word, cls = table["word"].to_numpy()[:done].astype(np.uint32), table["cls"].to_numpy()[:done]
            tags = np.frombuffer(b"".join(table["tags"].slice(0, done).to_pylist()), np.uint8).reshape(done, TAGS)
            run_of = np.cumsum(np.concatenate(([True], key[1:done] != key[: done - 1])))
            at, code = (np.arange(done), 0) if decoded else nearby_indices(word)
            bucket = run_of[at] * 4096 + code
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            word, cls = word[at], cls[at]
            here, step = np.arange(len(at)), 1
            while len(here):
                here = here[here + step < len(at)]
                here = here[bucket[here] == bucket[here + step]]
                there = here + step
                near = (np.bitwise_count(word[here] ^ word[there]) <= NEAR) & (cls[here] != cls[there])
                a, b = here[near], there[near]
                alike = (tags[at[a]] == tags[at[b]]).sum(1) >= least
                a, b = cls[a[alike]], cls[b[alike]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                step += 1

    return run


def candidates(sketch: DataFrame, threshold: float, prefix_bits: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b), a < b: classes of ``sketch`` that share a segment's prefix and an index near its word, and enough tags.

    Rows are shuffled by segment and prefix and decoded there. Where these have ``hot_rows`` records
    or more, rows are decoded first and shuffled by the index too.
    """
    one = sketch.where("n > 0").groupBy("cls").agg(F.first(F.struct("words", "prefixes", "tags")).alias("s")).select("cls", "s.*")
    each = one.select("cls", "tags", F.posexplode(F.arrays_zip("words", "prefixes")).alias("segment", "s"))
    key = F.shiftleft(F.col("segment").cast("long"), 32) + F.col("s.prefixes").bitwiseAND(F.lit((1 << prefix_bits) - 1))
    rows = each.select(key.alias("key"), F.col("s.words").alias("word"), "cls", "tags")
    least = least_tags(threshold)
    keys = sketch.where("n > 0").select(F.posexplode("prefixes").alias("segment", "prefix")).groupBy("segment", F.col("prefix").bitwiseAND(F.lit((1 << prefix_bits) - 1)).alias("prefix")).agg(F.count("*").alias("rows"))
    hot = [(r["segment"] << 32) + r["prefix"] for r in keys.where(F.col("rows") >= hot_rows).collect()]  # at most segments * records / hot_rows
    found = rows.where(~F.col("key").isin(hot)).repartition("key").sortWithinPartitions("key").mapInArrow(_matches(least, False), "a long, b long")
    if hot:
        split = rows.where(F.col("key").isin(hot)).mapInArrow(_decode, ROWS).repartition("key").sortWithinPartitions("key")
        found = found.union(split.mapInArrow(_matches(least, True), "a long, b long"))
    return found.distinct()


def _shingle_sets(records: DataFrame, words: int) -> DataFrame:
    """(id, grams): all distinct word sequences of ``records(id long, record string)``, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, _ = batch_words(batch.column("record"))
            row, h, _ = batch_shingles(rows, hashes, words)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["id", "grams"])

    return records.mapInArrow(run, "id long, grams array<long>")


def near_duplicates(
    records: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    segments: int = 24,
    hot_rows: int = HOT_ROWS,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Classes and similar pairs of ``records(id string, record string)``.

    Returns ``members(id, cls)``, one row per id, and ``pairs(a, b, shared, united)`` of
    classes ``a < b`` whose distinct ``words``-word sequences have a Jaccard similarity of at
    least ``threshold``. Records with fewer than ``words`` words (NULL and empty ones too) have
    no sequences, are in no pair and have a NULL class. Rows repeated with the same id count
    once; other columns of ``records`` are ignored. An empty table gives empty results. ``fetch`` gives the records of a
    table of ids, where that is cheaper than a semi-join with ``records``.
    """
    fetch = fetch or (lambda ids: records.join(ids, "id", "left_semi"))
    records = records.select(F.col("id").cast("string").alias("id"), F.col("record").cast("string").alias("record"))
    sketch = cut_lineage(sketches(records, words, segments))
    found = cut_lineage(candidates(sketch, threshold, PREFIX_BITS, hot_rows))
    wanted = found.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    ids = cut_lineage(sketch.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")))
    texts = fetch(ids.select("id")).select("id", "record").join(ids, "id").select(F.col("cls").alias("id"), "record")
    sets = cut_lineage(_shingle_sets(texts, words).dropDuplicates(["id"]))
    pairs = (
        found.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("shared"), (F.size("ga") + F.size("gb")).alias("total"))
        .select("a", "b", "shared", (F.col("total") - F.col("shared")).alias("united"))
        .where(F.col("shared") >= threshold * F.col("united"))
    )
    members = sketch.select("id", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).distinct()
    return members, pairs


def chunk_records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, record): the title of a chunk's document, a line break and the chunk's text."""
    titles = documents.groupBy("document_id").agg(F.min("title").alias("title"))
    return chunks.join(titles, "document_id", "left").select(F.col("chunk_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("record"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of different chunks whose records share at least half of their three-word sequences."""
    chunks, documents = spread(read_table(spark, folder, "chunks").select("chunk_id", "document_id", "text")), read_table(spark, folder, "documents")

    def some(ids: DataFrame) -> DataFrame:
        return chunk_records(chunks.join(ids.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi"), documents)

    members, pairs = near_duplicates(chunk_records(chunks, documents), words=3, threshold=0.5, fetch=some)
    members = members.where("cls is not null")
    one = members.select(F.col("id").alias("x"), F.col("cls").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))
    copies = one.join(two, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("chunk_id_a"), F.col("y").alias("chunk_id_b"))
    return across.union(copies)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its class, its group of directly or indirectly similar classes, and the number of similar classes.

    By the general rule for near duplicates: five words, similarity 0.8. Chunks without word
    sequences have NULLs.
    """
    members, pairs = near_duplicates(chunk_records(spread(read_table(spark, folder, "chunks").select("chunk_id", "document_id", "text")), read_table(spark, folder, "documents")))
    members, pairs = cut_lineage(members), cut_lineage(pairs.select("a", "b"))
    links = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = components(links.select(F.col("cls").alias("node")), pairs).select(F.col("node").alias("cls"), F.col("component").alias("group_id"))
    joined = members.join(links, "cls", "left").join(groups, "cls", "left")
    known = F.col("cls").isNotNull()
    return joined.select(F.col("id").alias("chunk_id"), "cls", F.when(known, F.coalesce("group_id", "cls")).alias("group_id"), F.when(known, F.coalesce("links", F.lit(0))).alias("links"))


P5_FOUND_SQL = r"""
with titles as (select document_id, min(title) title from documents group by 1),
records as (select distinct chunk_id, coalesce(title, '') || chr(10) || coalesce(text, '') record from chunks left join titles using (document_id)),
words as (select chunk_id, regexp_extract_all(lower(record), '[\p{L}\p{N}]+') w from records),
grams as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] gram from (select chunk_id, w, unnest(range(1, len(w) - 1)) i from words)),
sizes as (select chunk_id, count(*) n from grams group by 1),
shared as (select a.chunk_id x, b.chunk_id y, count(*) n from grams a join grams b on a.gram = b.gram and a.chunk_id < b.chunk_id group by 1, 2)
select x chunk_id_a, y chunk_id_b from shared s join sizes a on a.chunk_id = x join sizes b on b.chunk_id = y where s.n >= 0.5 * (a.n + b.n - s.n)
"""
