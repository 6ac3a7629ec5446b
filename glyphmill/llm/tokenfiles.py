"""Token ids in ORC files: ascending document ids, integer run-length encoding, row indexes and Bloom filters on the id.

Documents are range-partitioned by id (their texts are shuffled, not their longer ids), encoded in order and written one
file a partition. A file's stripes can be read in parallel; stripe and row-group statistics and Bloom filters let a reader
that wants some ids skip the rest. A rerun task writes its file again, so a lost executor costs only its own files.

Null and empty texts are one id (the end id). Rows with the same id are all written, next to each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, running_start, small_batches
from .tokens import END_ID, crc32, token_batches

STRIPE_BYTES, INDEX_STRIDE, BLOOM_FPP = 16 << 20, 1000, 0.01


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Write (id_col, ids array<int>) of every document, in ascending order over files and in them."""
    small_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, first in token_batches(batch, 1, tokenizer):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.view(np.int32)))], names=["id", "ids"])

    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id")
    encoded = ordered.mapInArrow(kernel, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)
    writer = encoded.write.mode("overwrite").option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_STRIDE)
    writer.option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", BLOOM_FPP).orc(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", only: Iterable | None = None) -> DataFrame:
    """The rows written; `only` is pushed to the stripes' statistics and Bloom filters."""
    df = spark.read.orc(path)
    return df if only is None else df.where(F.col(id_col).isin(list(only)))


def token_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of token files: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            crc = [crc32(values[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "n_tokens", "ids_crc32"])

    # cut: the range partitioning below samples its input, which would read the files twice
    each = cut(tokens.select(F.col(id_col).alias("id"), "ids").mapInArrow(kernel, f"id {tokens.schema[id_col].dataType.simpleString()}, n_tokens long, ids_crc32 long"))
    return running_start(each, ["id", "n_tokens", "ids_crc32"], "n_tokens", "start").select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
