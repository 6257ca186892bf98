"""Sizes of texts in tokens of a public tokenizer. Nothing is trained here."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern of the public vocabulary that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a rank file; built once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def document_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), one row per document.

    Deliveries of the same ``document_id`` count once, as the one with the smallest ``doc_id``;
    rows without a ``document_id`` are documents of their own. A NULL text has 0 tokens. The
    text itself is not shuffled. The vocabulary file is read on the driver's machine and sent with the job.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    sent = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(sent)).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "document_id", "source")), pa.array(sizes)], names=["doc_id", "document_id", "source", "tokens"])

    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "document_id", "source", "text").mapInArrow(run, "doc_id long, document_id string, source string, tokens long")
    key = F.coalesce("document_id", F.concat(F.lit("doc_id:"), F.col("doc_id")))
    return sized.groupBy(key.alias("key")).agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d")).select("d.*")
