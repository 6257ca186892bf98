"""Near duplicates against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from dossier.llm import near_duplicates as near
from dossier.llm.golay import decoder, nearby_indices
from dossier.llm.near_duplicates import near_duplicates

WORD = re.compile(r"[^\W_]+")


def grams(text, k):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold):
    sets = {i: grams(t or "", k) for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def found(spark, rows, **options):
    members, pairs = near_duplicates(spark.createDataFrame(rows, "id string, record string"), **options)
    classes = {}
    for r in members.collect():
        if r["cls"] is not None:
            classes.setdefault(r["cls"], set()).add(r["id"])
    result = {tuple(sorted((x, y))) for c in classes.values() for x in c for y in c if x < y}
    for r in pairs.collect():
        result |= {tuple(sorted((x, y))) for x in classes[r["a"]] for y in classes[r["b"]]}
    return result


def corpus(seed, families, size, notice=""):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for v in range(4):
            words = [w if rng.random() > 0.05 * v else rng.choice(vocabulary) for w in base]
            rows.append((f"{f:03d}-{v}", " ".join(words) + "\n" + notice))
    return rows


def test_code_is_perfect():
    table = decoder()
    counts = np.bincount(table, minlength=4096)
    assert len(counts) == 4096 and (counts == 2048).all()


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    keys = {}
    at, key = nearby_indices(words)
    for a, k in zip(at, key):
        keys.setdefault(a, set()).add(k)
    assert {len(k) for k in keys.values()} <= {1, 6}
    for i, w in enumerate(words):
        bits = rng.choice(23, 2, replace=False)
        _, other = nearby_indices(np.array([w ^ np.uint32((1 << bits[0]) | (1 << bits[1]))], np.uint32))
        assert keys[i] & set(other)


def test_all_pairs_are_found(spark):
    rows = corpus(3, 60, 120)
    want = brute(rows, 3, 0.5)
    assert len(want) > 130
    assert found(spark, rows, words=3, threshold=0.5) == want


def test_default_is_five_words_and_four_fifths(spark):
    rows = corpus(4, 40, 200)
    assert found(spark, rows) == brute(rows, 5, 0.8)


def test_records_that_share_a_notice(spark):
    """Records that share only a notice, which is most of each; also where hot keys are split by index."""
    rng = random.Random(5)
    notice = " ".join(f"n{i}" for i in range(60))
    rows = [(f"{i:03d}", " ".join(f"u{rng.randrange(10**6)}" for _ in range(10)) + " " + notice) for i in range(40)]
    want = brute(rows, 3, 0.5)
    assert len(want) == 40 * 39 // 2
    assert found(spark, rows, words=3, threshold=0.5) == want
    assert found(spark, rows, words=3, threshold=0.5, hot_rows=8) == want


def test_nearby_indices_find_what_equal_words_miss(spark):
    rows = corpus(6, 60, 120)
    want = brute(rows, 3, 0.5)
    assert found(spark, rows, words=3, threshold=0.5) == want
    records = spark.createDataFrame(rows, "id string, record string")
    sketch = near.sketches(records, 3, 24)
    decoded = near.candidates(sketch, 0.5, 0)
    equal = sketch.select("cls", F.posexplode("words").alias("segment", "word"))
    same = equal.join(equal.withColumnRenamed("cls", "other"), ["segment", "word"]).where("cls < other").select("cls", "other").distinct()
    assert same.count() < 0.8 * decoded.count()


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [("a", text), ("a", text), ("b", text), ("c", None), ("d", ""), ("e", "two words"), ("f", text.upper().replace(" ", " - ")), ("g", "x" * 100_000)]
    assert found(spark, rows, words=3, threshold=0.5) == {("a", "b"), ("a", "f"), ("b", "f")}


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, [], words=3, threshold=0.5) == set()
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([("a", text, 1, "x"), ("b", text, 2, "y")], "id string, record string, cls int, n string")
    members, pairs = near_duplicates(rows, words=3, threshold=0.5)
    assert members.select("cls").distinct().count() == 1 and pairs.count() == 0
    assert set(members.columns) == {"id", "cls"}


def test_pairs_with_some_hot_words_are_found(spark):
    """Pairs just above the threshold whose records are a notice of many others to a fifth to a third."""
    rng = random.Random(7)
    rows = []
    for f in range(80):
        notice = [f"n{i}" for i in range((25, 32, 40)[f % 3])]
        base = [f"u{rng.randrange(10**6)}" for _ in range(120 - len(notice))]
        other = list(base)
        for i in rng.sample(range(0, len(base), 3), 13):
            other[i] = f"u{rng.randrange(10**6)}"
        rows += [(f"{f:02d}-a", " ".join(base + notice)), (f"{f:02d}-b", " ".join(other + notice))]
    want = brute(rows, 3, 0.5)
    assert len(want) >= 50
    assert found(spark, rows, words=3, threshold=0.5) == want


def test_whether_a_pair_is_found_does_not_depend_on_other_records(spark):
    """With one segment most pairs are missed: the same ones, alone and among as many others as move log2 of the records."""
    rows = corpus(8, 60, 120)
    others = [(f"x{i:05d}", " ".join(f"x{i}-{j}" for j in range(4))) for i in range(2300)]
    alone, among = (found(spark, r, words=3, threshold=0.5, segments=1) for r in (rows, rows + others))
    assert 0 < len(alone) < len(brute(rows, 3, 0.5))
    assert {p for p in among if p[0][0] != "x"} == alone
