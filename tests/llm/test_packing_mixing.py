import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from dossier.llm.mixing import capped_mean, mix, mixing_rates, shares, thresholds
from dossier.llm.packing import GRID, pack, packing_plan
from dossier.llm.tokens import VOCABULARY, document_tokens


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 500, GRID)
    total = np.zeros(GRID, np.int64)
    for need, times in packing_plan(histogram):
        assert times > 0 and (need * np.arange(1, GRID + 1)).sum() <= GRID
        total += need * times
    assert (total == histogram).all()


@pytest.mark.parametrize("capacity", [1024, 8192])
def test_pack_is_whole_and_tight(spark, capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice([rng.randrange(1, 600), rng.randrange(1, 1500), 3 * capacity + 5 if i % 500 == 0 else 77])) for i in range(4000)]
    items += [(10_000, 0), (10_001, None), (10_002, capacity), (10_003, 2 * capacity)]
    rows = pack(spark.createDataFrame([(*x, "clash") for x in items], "item long, size long, container string"), capacity).collect()
    got, fill = defaultdict(list), Counter()
    for r in rows:
        got[r["item"]].append((r["piece"], r["size"], r["container"]))
        if r["container"] is not None:
            fill[r["container"]] += r["size"]
    assert max(fill.values()) <= capacity
    for item, size in items:
        pieces = sorted(got[item])
        assert sum(p[1] for p in pieces) == (size or 0)
        assert len(pieces) == max(1, -(-(size or 0) // capacity))
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert (pieces[0][2] is None) == (not size)
    assert sum(fill.values()) / (len(fill) * capacity) > 0.93


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "item long, size long"), 1024).count() == 0


@pytest.mark.parametrize("cap", [1, 2, 4])
def test_thresholds_give_the_mean(cap):
    for mean in (0.1, 0.5, 0.9 * cap):
        steps = thresholds(mean, cap)
        assert abs(sum(1 - t for t in steps) - mean) < 1e-6
    assert thresholds(cap, cap) == [0.0] * cap and thresholds(0, cap) == []
    assert abs(capped_mean(50.0, cap) - cap) < 1e-6


def test_rates_keep_shares_within_caps():
    rates = mixing_rates({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.4, 2), "gone": (0.1, 5)})
    assert rates["b"] == (2.0, 2) and abs(rates["a"][0] * 1000 / (rates["b"][0] * 100) - 0.5 / 0.4) < 1e-9


def test_mix_reaches_targets(spark):
    docs = [(i, "a", 10) for i in range(4000)] + [(10_000 + i, "b", 10) for i in range(1500)] + [(90_000, None, 5), (90_001, "other", 5)]
    table = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("gone", 0.2, 3), (None, None, None), ("null", None, None)], "source string, target_share double, max_repeats int")
    mixed = mix(table, targets)
    rows = mixed.collect()
    copies = Counter((r["source"], r["doc_id"]) for r in rows)
    assert max(n for (s, _), n in copies.items() if s == "a") == 1 and max(n for (s, _), n in copies.items() if s == "b") <= 2
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    assert [tuple(r) for r in mix(table, targets).collect()] == [tuple(r) for r in rows]
    reached = {r["source"]: r["reached_share"] for r in shares(mixed, targets).collect()}
    assert abs(reached["a"] - 0.5) < 0.03 and abs(reached["b"] - 0.5) < 0.03 and reached["gone"] == 0
    half = mix(table, targets, total_tokens=20_000)
    assert abs(sum(r["tokens"] for r in half.collect()) - 20_000) < 1500
    assert mix(table.limit(0), targets).count() == 0 and mix(table, targets.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the public vocabulary isn't here")
def test_tokens(spark):
    rows = [(1, "d", "a", "Hello world <|endoftext|>"), (5, "d", "a", "later"), (2, None, None, None), (3, None, "b", ""), (4, "e", "b", "x " * 20_000)]
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in document_tokens(spark.createDataFrame(rows, "doc_id long, document_id string, source string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == (None, 0) and got[3] == ("b", 0) and got[1][1] > 4 and got[4][1] >= 20_000
