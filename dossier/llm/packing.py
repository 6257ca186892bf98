"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

Sizes are put into classes of 1/``GRID`` of the capacity, rounded up, and counted; this
histogram of at most ``GRID`` numbers is all that reaches the driver. There, patterns of up to
``PARTS`` classes that fill a container are enumerated, repeat counts are fitted to the
histogram by non-negative least squares and rounded down to what the histogram holds, and the
residual is packed by greedy patterns on the remaining histogram. Items are then numbered
within their class (in shards, so that a class of any size is spread) and look up the
container of their number.

Items much smaller than the capacity are first packed into bundles of a quarter of it.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.tokens import document_tokens
from dossier.session import cut_lineage, read_table, spread

GRID = 128
PARTS = 4
SHARD_ROWS = 100_000


@lru_cache(maxsize=1)
def patterns() -> np.ndarray:
    """All multisets of up to ``PARTS`` classes that fill ``GRID`` or ``GRID - 1`` units, as counts by class."""
    found = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if left <= 1 and parts:
            found.append(np.bincount(parts, minlength=GRID + 1)[1:])
        if len(parts) < PARTS and left:
            for part in range(1, min(left, parts[-1] if parts else GRID) + 1):
                grow((*parts, part), left - part)

    grow((), GRID)
    return np.asfortranarray(found, float)


def fit_repeats(histogram: np.ndarray, rounds: int = 6000) -> np.ndarray:
    """Non-negative repeat counts x with least squares of patterns' sum to the histogram.

    Coordinate descent that always takes the pattern with the largest step, which keeps the
    solution sparse; it ends when no step reaches half a repeat, or after ``rounds`` steps, of which what
    the histogram has left is packed greedily.
    """
    a = patterns()
    norms = (a * a).sum(1)
    x = np.zeros(len(a))
    gain = a @ histogram.astype(float)
    for _ in range(rounds):
        steps = np.maximum(-x, gain / norms)
        p = int(np.argmax(np.abs(steps) * np.sqrt(norms)))
        if abs(steps[p]) < 0.5:
            break
        x[p] += steps[p]
        used = np.flatnonzero(a[p])
        gain -= steps[p] * (a[:, used] @ a[p, used])
    return x


def packing_plan(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(class counts of a container, repeats); together they hold exactly the histogram."""
    left = histogram.astype(np.int64).copy()
    plan = []
    repeats = np.floor(fit_repeats(left)).astype(np.int64)
    for p in np.argsort(-repeats, kind="stable"):
        need = patterns()[p].astype(np.int64)
        times = int(min(repeats[p], *(left[need > 0] // need[need > 0])))
        if times > 0:
            left -= times * need
            plan.append((need, times))
    while left.any():  # each greedy pattern uses up a class
        need, room = np.zeros(GRID, np.int64), GRID
        for k in range(GRID - 1, -1, -1):
            need[k] = min(left[k], room // (k + 1))
            room -= need[k] * (k + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        plan.append((need, times))
    return plan


def _slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each class: first item number of each run of slots, and what turns an item number into a container."""
    first = [[0] for _ in range(GRID)]
    shift: list[list[int]] = [[] for _ in range(GRID)]
    base = 0
    for need, times in plan:
        for k in np.flatnonzero(need):
            for _ in range(int(need[k])):
                shift[k].append(base - first[k][-1])
                first[k].append(first[k][-1] + times)
        base += times
    return [(np.array(f[:-1], np.int64), np.array(s, np.int64)) for f, s in zip(first, shift)]


def _place(items: DataFrame, capacity: int) -> DataFrame:
    """items(item, size) with 1 <= size <= capacity, plus ``box``: the container of each."""
    spark = items.sparkSession
    items = items.withColumn("class", F.ceil(F.col("size") * GRID / F.lit(capacity)).cast("int"))
    counts = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count("*").alias("n")).collect()}
    histogram = np.array([counts.get(k + 1, 0) for k in range(GRID)], np.int64)
    slots = spark.sparkContext.broadcast(_slots(packing_plan(histogram)))
    shards = max(1, -(-int(histogram.max(initial=0)) // SHARD_ROWS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    sizes = items.groupBy("class", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("class").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("class", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = items.withColumn("at", F.row_number().over(W.partitionBy("class", "shard").orderBy("item")) - 1).join(sizes, ["class", "shard"])

    @F.pandas_udf("long")
    def box(kind: pd.Series, number: pd.Series) -> pd.Series:
        kinds, numbers, result = kind.to_numpy() - 1, number.to_numpy(), np.zeros(len(kind), np.int64)
        for k in np.unique(kinds):
            mine = kinds == k
            first, shift = slots.value[k]
            result[mine] = numbers[mine] + shift[np.searchsorted(first, numbers[mine], "right") - 1]
        return pd.Series(result)

    return ranked.select("item", "size", box("class", F.col("before") + F.col("at")).alias("box"))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Assign ``items(item long, size long)`` to containers: (item, piece, size, container).

    An item larger than the capacity is split into full pieces and a rest; no other is split.
    Items of size 0 or NULL need no place: their container is NULL. ``item`` must be unique.
    An empty table gives an empty result.
    """
    whole = F.floor(F.col("size") / F.lit(capacity)).cast("int")
    cuts = items.where("size > 0").select("item", "size", whole.alias("whole"), (F.col("size") - whole * F.lit(capacity)).alias("rest"))
    full = cuts.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    full = full.select("item", "piece", F.lit(capacity).cast("long").alias("size"), F.concat(F.lit("f"), F.col("item"), F.lit("-"), F.col("piece")).alias("container"))
    parts = cut_lineage(cuts.where("rest > 0").select("item", F.col("whole").alias("piece"), F.col("rest").alias("size")))
    quarter = capacity // 4
    mean = parts.agg(F.avg("size")).first()[0]
    if mean is not None and mean * 8 <= capacity and quarter >= GRID:
        small = _place(parts.where(F.col("size") <= quarter).select("item", "size"), quarter)
        small = cut_lineage(small.select("item", (-1 - F.col("box")).alias("unit"), "size"))
        bundles = small.groupBy(F.col("unit").alias("item")).agg(F.sum("size").alias("size"))
        units = bundles.union(parts.where(F.col("size") > quarter).select("item", "size"))
        placed = _place(units, capacity).select(F.col("item").alias("unit"), "box")
        large = parts.where(F.col("size") > quarter).select("item", F.col("item").alias("unit"))
        boxes = small.select("item", "unit").union(large).join(placed.hint("merge"), "unit").select("item", "box")  # never by broadcast, both sides grow
    else:
        boxes = _place(parts.select("item", "size"), capacity).select("item", "box")
    rest = parts.join(boxes, "item").select("item", "piece", "size", F.concat(F.lit("p"), F.col("box")).alias("container"))
    nothing = items.where("size is null or size <= 0").select("item", F.lit(0).alias("piece"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(None).cast("string").alias("container"))
    return full.union(rest).union(nothing)


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container of each kind."""
    items = cut_lineage(document_tokens(spread(read_table(spark, folder, "documents").select("doc_id", "document_id", "source", "text"))).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")))
    kinds = read_table(spark, folder, "container_sizes").where("capacity_tokens > 0").distinct().collect()  # a fixed table of a few rows
    packed = [pack(items, k["capacity_tokens"]).withColumn("container_kind", F.lit(k["container_kind"])) for k in kinds]
    return reduce(DataFrame.union, packed).select("container_kind", "container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, the least that any packing needs, tokens and share of the capacity used, by kind.

    The least is the larger of the tokens over the capacity and the number of pieces above half of it.
    """
    sizes = read_table(spark, folder, "container_sizes").distinct()  # a fixed table of a few rows
    packed = p6_pack(spark, folder).where("container is not null").join(F.broadcast(sizes), "container_kind")
    used = packed.groupBy("container_kind", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") * 2 > F.col("capacity_tokens")).alias("large"))
    least = F.greatest(F.ceil(F.sum("tokens") / F.col("capacity_tokens")), F.sum("large"))
    return used.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"), least.alias("least_containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * F.col("capacity_tokens"))).alias("fill")
    )
