"""Best-fit packing of token pieces into sequences of bounded length, hierarchically.

A document's ids (with the end id) are one piece, or, if longer than a sequence, pieces of full length after a first one that
may be shorter. Partitions of bounded size pack their pieces best-fit in descending order. A bin that is nearly full is
done; all underfull bins go up a tree as items themselves, into partitions of the same bounded size, and are packed best-fit again,
until one partition has held them all or a round has merged fewer than 1 in STALE of them. Two bins of at most half a sequence in a
partition always merge, so then each partition holds at most one of them.

Null and empty texts are a piece of one id (the end id). Repeated rows are packed each. Only lengths and checksums are
shuffled, not ids; `packed_sequences` gives the ids themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .runtime import cut, small_batches
from .tokens import END_ID, crc32, token_batches

LENGTH, PER_PARTITION, SLACK, STALE = 1024, 50_000, 8, 20


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, fill = 0, []  # bit r of rooms: there is a bin with room r
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), length
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bin_of, offset, np.array(fill, np.int64)


def _packer(length: int, schema: pa.Schema):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema)
        if not held.num_rows:
            return
        bin_of, offset, fill = best_fit(held.column("length").to_numpy(), length)
        own = TaskContext.get().partitionId() << 32
        for c, v in (("bin", bin_of + own), ("offset", offset), ("fill", fill[bin_of]), ("up", (fill < length - min(SLACK, length // 16))[bin_of])):
            held = held.append_column(c, pa.array(v))
        yield from held.combine_chunks().to_batches()

    return kernel


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each piece of each document."""
    small_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, first in token_batches(batch, 1, path):
                n = np.diff(first)
                many = -(-n // length)
                row = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                head = n - (many - 1) * length  # the first piece
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * length)
                size = np.where(piece == 0, head[row], length)
                at = first[:-1][row] + start
                crc = [crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, length: int = LENGTH, per_partition: int = PER_PARTITION) -> DataFrame:
    """items (with a column `length`, at most one sequence each) with sequence_id and offset.

    Only bins, not their items, go up. Rounds go on while each merges at least 1 in STALE of what's left, so they are few.
    """
    parts = max(1, -(-items.count() // per_partition))

    def packed(df: DataFrame, n: int) -> DataFrame:
        dealt = df.repartition(n)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return cut(dealt.mapInArrow(_packer(length, to_arrow_schema(df.schema)), f"{fields}, bin long, offset long, fill long, up boolean"))

    placed = packed(items, parts)
    moved, up = None, placed.where("up and offset = 0").select(F.col("bin").alias("child"), F.col("fill").alias("length"))
    done, level, left = placed.drop("fill", "up"), 1, up.count()
    while parts > 1 and level < 127:
        before, parts = left, -(-left // per_partition)
        if not parts:
            break
        merged = packed(up, parts).withColumn("bin", F.col("bin") + F.lit(level << 56))
        step = merged.select("child", F.col("bin").alias("parent"), F.col("offset").alias("shift"))
        if moved is None:
            moved = step
        else:
            again = step.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            moved = moved.join(again, "parent", "left").select("child", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        up, level = merged.where("up and offset = 0").select(F.col("bin").alias("child"), F.col("fill").alias("length")), level + 1
        left = up.count()
        if (before - left) * STALE < before:
            break
    if moved is None:
        return done.withColumnRenamed("bin", "sequence_id")
    out = done.join(moved.withColumnRenamed("child", "bin"), "bin", "left")
    return out.select(*items.columns, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pack(cut(pieces_of(docs, path, id_col, text_col, length)), length)
    return found.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, packing: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed ids and the document of each piece, in order. Ids must be unique."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, first in token_batches(batch, 1, path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))], names=["id", "ids"])

    tokens = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
    cuts = packing.withColumnRenamed(id_col, "id").join(tokens, "id").select("sequence_id", F.struct("offset", "id", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("p"))
    each = cuts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return each.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.id").alias("doc_ids"))
