"""Word streams of Arrow text columns, as arrays of 64-bit word hashes.

Used inside mapInArrow tasks: Spark partitions the documents, a task tokenises a batch
with Arrow's own kernels and goes on with numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX2
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def batch_words(texts: pa.Array, line_marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text: the longest runs of letters and digits, in lower case.

    Returns (row of each word, hash of each word, whether it starts with a digit), in text
    order. With ``line_marks``, a line end counts as a number, so that it separates words.
    NULL texts have no words.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if line_marks:
        low = pc.replace_substring_regex(low, pattern=r"[\r\n]+", replacement=" 0 ")
    parts = pc.split_pattern_regex(low, pattern=r"[^\p{L}\p{N}]+")
    offsets = parts.offsets.to_numpy()
    flat = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    digits = np.fromiter((w[:1].isdigit() for w in names), bool, len(names))
    filled = np.fromiter((w != "" for w in names), bool, len(names))
    code = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    if len(names):
        keep = filled[code]
        rows, code = rows[keep], code[keep]
    return rows, hashes[code] if len(names) else np.zeros(0, np.uint64), digits[code] if len(names) else np.zeros(0, bool)


def batch_shingles(rows: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``k``-word sequences of each row: (row, hash, position of the first one), ordered by row and hash."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = scramble(h * MIX + words[j : j + n])
    at = np.flatnonzero(rows[:n] == rows[k - 1 : k - 1 + n])
    row, h = rows[at], h[at]
    order = np.lexsort((h, row))
    at, row, h = at[order], row[order], h[order]
    if not len(h):
        return row, h, at
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], at[new]
