"""Text functions, as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 250  # words after which a chunk is closed
DIMENSIONS = 384
FEATURE_ROWS = 2048  # texts whose features are computed at once
BLANKS = r"[\s\p{Z}]+"

# Legal endings of registered names, of which one is stripped to get an alias.
ENDINGS = "inc corp corporation co company ltd plc sa nv ag holding holdings group lp llc"
SUFFIX = rf"(?i)\s+({'|'.join(ENDINGS.split())})\.?$"


def words_of(text: Column) -> Column:
    """Words between blanks of any kind; an empty array for NULL."""
    return F.coalesce(F.filter(F.split(text, BLANKS), lambda w: w != ""), F.array().cast("array<string>"))


def terms_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def packed_spans(text: Column, budget: int = BUDGET) -> Column:
    """Chunks of a text as an array of (start, end): whole paragraphs until at least ``budget`` words, half-open, in code points."""
    paragraph = F.split(text, "\n", -1)
    state = F.struct(
        F.lit(0).alias("offset"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("words"), F.lit(0).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(s: Column, p: Column) -> Column:
        count = F.size(words_of(p))
        start, words, end = F.coalesce(s.start, s.offset), s.words + count, s.offset + F.length(p)
        full = words >= budget
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.when(
            count > 0,
            F.struct(
                (end + 1).alias("offset"), F.when(~full, start).alias("start"), F.when(full, 0).otherwise(words).alias("words"), end.alias("end"),
                F.when(full, F.concat(s.out, F.array(span))).otherwise(s.out).alias("out"),
            ),
        ).otherwise(F.struct((end + 1).alias("offset"), s.start.alias("start"), s.words.alias("words"), s.end.alias("end"), s.out.alias("out")))

    def finish(s: Column) -> Column:
        return F.when(s.start.isNotNull(), F.concat(s.out, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))).otherwise(s.out)

    return F.when(text.isNotNull(), F.aggregate(paragraph, state, step, finish))


def alias_of(name: Column) -> Column:
    """A name without one legal suffix; NULL if that is too short or changes nothing."""
    short = F.trim(F.regexp_replace(name, SUFFIX, ""))
    return F.when((F.length(short) >= 4) & (short != name), short)


def timeframe(label: Column) -> tuple[Column, Column]:
    """First day of a year, quarter or month, and of the next one; NULL for anything else."""
    clean = F.trim(label)
    year = F.regexp_extract(clean, r"^(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(clean, r"^\d{4}Q([1-4])$", 1).try_cast("int")
    month = F.regexp_extract(clean, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    whole = clean.rlike(r"^\d{4}$")
    first = F.when(quarter.isNotNull(), quarter * 3 - 2).when(month.between(1, 12), month).when(whole, 1)
    span = F.when(quarter.isNotNull(), 3).when(month.between(1, 12), 1).when(whole, 12)
    valid = first.isNotNull() & year.between(1, 9998)
    start = F.when(valid, F.make_date(F.when(valid, year), F.when(valid, first), F.lit(1)))
    return start, F.add_months(start, span)


def _counts(lists: pa.ListArray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n): how often each row's list has each code."""
    rows = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    most = int(code.max()) + 1 if len(code) else 1
    key, n = np.unique(rows * most + code, return_counts=True)
    return key // most, key % most, n


def scaled_to_one(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The values of each row's vector, scaled to length 1."""
    return value / np.sqrt(np.bincount(row, value * value, rows))[row]


def _lists(rows: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=count)))), pa.int32()), values)


def text_features(texts: DataFrame, text: str, *keep: str, vectors: bool = True, vocabulary: list[str] | None = None, scaled: bool = True) -> DataFrame:
    """(keep, dims, weights, terms, tfs, length), one row per row of ``texts``; all of it depends on that row alone, nothing is shuffled.

    ``dims`` and ``weights`` are the signed feature hashing of the words in lower case, scaled to length 1: a
    word's dimension comes from the first four bytes of its SHA-256, its sign from the fifth. ``terms`` are
    the distinct runs of ASCII letters and digits with their counts, ``length`` is the number of all. A NULL
    or empty text has empty lists. With a ``vocabulary``, ``terms`` gives way to ``codes``, the places in it of those terms that it has, and
    ``tfs`` counts these alone; ``vectors`` tells whether vectors are wanted. Without ``scaled``, ``weights`` gives way to ``counts``, the
    whole numbers that ``scaled_to_one`` makes weights of.
    """
    terms_type = "terms array<string>, tfs array<long>" if vocabulary is None else "codes array<int>, tfs array<int>"
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = pa.array(shared.value, pa.string()) if shared else None
        for batch in (b.slice(n, FEATURE_ROWS) for b in batches for n in range(0, b.num_rows, FEATURE_ROWS)):
            count = batch.num_rows
            words = batch.column("words").flatten().dictionary_encode()
            digests = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
            dim = np.array([int.from_bytes(d[:4]) % DIMENSIONS for d in digests], np.int64)
            sign = np.array([1 if d[4] % 2 else -1 for d in digests], np.int64)
            row, code, n = _counts(batch.column("words"), words.indices.to_numpy(zero_copy_only=False))
            places, at = np.unique(row * DIMENSIONS + dim[code], return_inverse=True) if len(row) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            value = np.bincount(at, n * sign[code], len(places)) if len(row) else np.zeros(0)
            places, value = places[value != 0], value[value != 0]
            row = places // DIMENSIONS
            terms = batch.column("terms").flatten().dictionary_encode()
            owner, term, tf = _counts(batch.column("terms"), terms.indices.to_numpy(zero_copy_only=False))
            length = np.bincount(owner, tf, count)
            if sought is None:
                named = terms.dictionary.take(pa.array(term))
            else:
                place = pc.index_in(terms.dictionary, sought).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                owner, tf, named = owner[place >= 0], tf[place >= 0], pa.array(place[place >= 0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    _lists(row, count, pa.array(places % DIMENSIONS, pa.int32() if scaled else pa.int16())),
                    _lists(row, count, pa.array(scaled_to_one(row, value, count)) if scaled else pa.array(value.astype(np.int32))),
                    _lists(owner, count, named),
                    _lists(owner, count, pa.array(tf, pa.int64() if sought is None else pa.int32())),
                    pa.array(length, pa.int32()),
                ],
                names=[*keep, "dims", "weights" if scaled else "counts", "terms" if sought is None else "codes", "tfs", "length"],
            )

    words = words_of(F.lower(F.col(text))) if vectors else F.array().cast("array<string>")
    vector = "dims array<int>, weights array<double>" if scaled else "dims array<smallint>, counts array<int>"
    split = texts.select(*keep, words.alias("words"), terms_of(F.col(text)).alias("terms"))
    return split.mapInArrow(run, ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in keep) + f", {vector}, {terms_type}, length int")


def feature_hash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, weight): the vectors of ``text_features`` as rows; none for a text without words."""
    rows = text_features(texts, text, key).select(key, F.explode(F.arrays_zip("dims", "weights")).alias("v"))
    return rows.select(key, F.col("v.dims").alias("dim"), F.col("v.weights").alias("weight"))


def truncated(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def citation_ids(narrative: Column) -> Column:
    """Ids of the strict citation markers, in order, with repeats."""
    return F.coalesce(F.regexp_extract_all(narrative, F.lit(r"\[chunk:([0-9a-f-]{36})\]"), F.lit(1)), F.array().cast("array<string>"))
