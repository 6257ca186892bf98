"""Blocks of items with their features, compressed, that searches go through one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.functions.text import scaled_to_one

PACKED = "packed"
FIELDS = {"item_id": pa.string(), "kind": pa.string(), "groups": pa.list_(pa.string()), "dims": pa.list_(pa.int16()), "weights": pa.list_(pa.float64()), "counts": pa.list_(pa.int32()), "codes": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "length": pa.int32()}


def pack(items: DataFrame, size: int) -> DataFrame:
    """(packed): ``items``, of which some of ``FIELDS`` may be missing, in blocks of at most ``size`` rows of one partition.

    Vectors are ``weights`` as they are, or ``counts``, which a search scales to length 1.
    """
    given = [c for c in FIELDS if c in items.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            filled = [rows[c].cast(t) if c in given else pa.nulls(len(rows), t) for c, t in FIELDS.items()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema(FIELDS.items()), options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.table(filled, names=list(FIELDS)).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[PACKED])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, size))
                held = rows.slice(size).to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return items.select(*given).mapInArrow(run, f"{PACKED} binary")


def gathered(packed: DataFrame) -> DataFrame:
    """Blocks in no more partitions than there are cores, since each passes on its own best items."""
    return packed.coalesce(packed.sparkSession.sparkContext.defaultParallelism)


class Block:
    def __init__(self, table: pa.Table) -> None:
        self.table = table
        self.ids = np.array([i.encode() for i in table["item_id"].to_pylist()], "S")
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.argsort(self.ids)] = np.arange(len(self.ids))

    def lists(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """(row of each element, elements) of a column of lists."""
        column = self.table[name].combine_chunks()
        return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten()

    def columns(self, size: int) -> np.ndarray:
        """Items' vectors as columns."""
        row, dims = self.lists("dims")
        given, counts = (self.lists(c)[1].to_numpy(zero_copy_only=False) for c in ("weights", "counts"))
        matrix = np.zeros((size, len(self.ids)))
        matrix[dims.to_numpy(zero_copy_only=False), row] = scaled_to_one(row, counts.astype(float), len(self.ids)) if len(counts) else given
        return matrix

    def of_kinds(self, kinds: tuple | None) -> np.ndarray:
        kind = self.table["kind"].combine_chunks()
        return np.isin(kind.fill_null("").to_numpy(zero_copy_only=False), [k for k in kinds or () if k is not None]) & kind.is_valid().to_numpy(zero_copy_only=False)

    def group_by(self, names: pa.Array, vectors: bool = True) -> None:
        """Prepares ``items`` for groups by their places in ``names``; of ``vectors`` only the items that have one."""
        row, group = self.lists("groups")
        coded = group.dictionary_encode()
        known = {g: n for n, g in enumerate(names.to_pylist())}
        code = np.array([known.get(g, -1) for g in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(group) else np.zeros(0, np.int64)
        full = self.table["dims"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
        use = (code >= 0) & (full[row] if vectors else True)
        row, code = row[use], code[use]
        order = np.lexsort((self.rank[row], code))
        self.member, code = row[order], code[order]
        self.starts = np.searchsorted(code, np.arange(len(known) + 1))

    def items(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``groups``, item) of all members of ``groups``, in order of place and id."""
        first = self.starts[groups]
        count = self.starts[groups + 1] - first
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)
        return np.repeat(np.arange(len(groups)), count), self.member[at]


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for packed in batch.column(PACKED):
            table = pa.ipc.open_stream(packed.as_buffer()).read_all()
            if len(table):
                yield Block(table)
