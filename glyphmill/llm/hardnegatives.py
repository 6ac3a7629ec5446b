"""Hard negatives by norm-bucketed search: for anchors, near rows of their own label, then others' rows in a window below.

Components become floor(scale * x), so scores are integer inner products. Rows are dealt by ranges of (length, label,
norm), largest norms first, and cut into slices of bounded size and these into buckets of one label. An anchor visits the
slices that can matter: those of its label for positives; for negatives those with another label whose largest norm times
its own reaches the lowest of its windows (Cauchy-Schwarz). A task holds one slice; a batch of anchors meets its buckets
in falling order of norm, and a bucket is skipped by every anchor whose norm times the bucket's largest can reach neither
the lower limit nor the running k-th score of any of its windows. Each visit yields the best k a window; the best k of
these are the anchor's. So no task holds more than a slice and a batch, however large a label is.

Equal scores go by smaller id, null ids last. Rows are told apart as rows: a repeated row is another row, also of an anchor,
and every repeated anchor gets its result. Rows take no part if their label or vector is null or if any component is null
or not finite (also after scaling). Vectors of different lengths don't meet. Sums are exact: in doubles where the norms bound
every one below 2**52, else in Python's integers; scores beyond a long are held at its ends. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
SLICE, LEAST_SLICE, SLICES, BUCKET = 65_536, 1024, 64, 1024
_END = (1 << 63) - 1
_SLACK = 1 + 1e-9


def scaled(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles (from 2**52 on a double has no fraction)."""
    y = lambda x: x * F.lit(float(scale))
    return F.transform(vec.cast("array<double>"), lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x)))


def bucketed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """uid, slice, bucket, size, label, id, anchor, norm, vec of the rows that take part; written once, since uid must not change."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled(F.col(vec_col), scale).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("size", F.size("vec")).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    n = rows.count()
    most = min(max(-(-n // SLICES), LEAST_SLICE), SLICE)
    order = [F.col("size"), F.col("label"), F.col("norm").desc(), F.col("id")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, bucket, filled, last = TaskContext.get().partitionId(), 0, -1, 0, None
        for batch in batches:
            size, label = batch.column("size").to_pylist(), batch.column("label").to_pylist()
            buckets = []
            for i, key in enumerate(zip(size, label, strict=True)):
                if key != last or filled == BUCKET or (done + i) % most == 0:
                    bucket, filled, last = bucket + 1, 0, key
                filled += 1
                buckets.append(bucket)
            at = done + np.arange(batch.num_rows)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((part << 33) + at), pa.array((part << 33) + at // most), pa.array(buckets, pa.int32()), *batch.columns], names=["uid", "slice", "bucket", *batch.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(max(-(-n // most), 1), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(number, f"uid long, slice long, bucket int, {fields}"))


@dataclass
class Held:
    """The rows of a slice, in the order of their buckets; starts: where each bucket starts, and the end."""

    uid: np.ndarray
    id: np.ndarray
    no_id: np.ndarray
    label: np.ndarray
    size: np.ndarray
    norm: np.ndarray
    vec: list[np.ndarray]
    starts: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Held:
        ids = t.column("id")
        bucket = t.column("bucket").to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        vec = t.column("vec").combine_chunks()
        return cls(t.column("uid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), np.array(t.column("label").to_pylist(), object), t.column("size").to_numpy(), t.column("norm").to_numpy(), [matrix(vec.slice(i, j - i)) for i, j in zip(starts[:-1], starts[1:], strict=True)], starts)


def matrix(vec: pa.Array) -> np.ndarray:
    """Rows of vectors of one length."""
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    whole = [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_END, _END).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)))


def search(held: Held, uid: np.ndarray, label: np.ndarray, size: int, norm: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row of the slice, score) of the best k rows in each window; window w of anchor a is a * width + w.

    low, high: [anchors, width], both ends included; a window that isn't there has low > high. Rows have the anchor's label if
    `same`, else another.
    """
    width, floor, most = low.shape[1], low.copy(), high.max(axis=1)
    win, row, score = (np.zeros(0, np.int64) for _ in range(3))
    starts = held.starts
    for b in sorted(range(len(starts) - 1), key=lambda b: -held.norm[starts[b]]):
        lo, hi = starts[b], starts[b + 1]
        if held.size[lo] != size:
            continue
        need = np.where(low <= high, floor, _END).min(axis=1)
        reach = held.norm[lo:hi].max()
        with np.errstate(invalid="ignore", over="ignore"):
            bound = norm * reach * _SLACK + 1
            # a product that isn't a number bounds nothing
            own = np.flatnonzero(((label == held.label[lo]) == same) & (low <= high).any(axis=1) & ~(bound < need))
            if not len(own):
                continue
            s = products(x[own], held.vec[b], bool(norm[own].max() * reach < 2.0**52))
        i, j = np.nonzero((s >= need[own][:, None]) & (s <= most[own][:, None]))
        s, i, j = s[i, j].astype(np.int64), own[i], j + lo
        other = held.uid[j] != uid[i]
        found = [(np.flatnonzero(other & (s >= floor[i, w]) & (s <= high[i, w])), w) for w in range(width)]
        win = np.concatenate([win, *(i[at] * width + w for at, w in found)])
        row, score = np.concatenate([row, *(j[at] for at, _ in found)]), np.concatenate([score, *(s[at] for at, _ in found)])
        order = np.lexsort((held.uid[row], held.id[row], held.no_id[row], -score, win))
        win, row, score = win[order], row[order], score[order]
        rank = np.arange(len(win)) - np.searchsorted(win, win)
        floor.ravel()[win[rank == k - 1]] = score[rank == k - 1]
        win, row, score = (v[rank < k] for v in (win, row, score))
    return win, row, score


def windows(score: pa.ListArray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer windows low / 100 to high / 100 of each anchor's scores: [anchors, most scores of one]."""
    lists = score.to_pylist()
    width = max(map(len, lists), default=0)
    ends = [(max(-(-low * s // 100), -_END), min(high * s // 100, _END)) for own in lists for s in [*own, *[None] * (width - len(own))] for s in ([s] if s is not None else [])]
    lo, hi = np.full((len(lists), width), _END), np.full((len(lists), width), -_END)
    there = np.arange(width)[None, :] < np.array([len(own) for own in lists])[:, None]
    if ends:
        lo[there], hi[there] = np.array(ends, np.int64).T
    return lo, hi


def _visits(k: int, same: bool, low: int, high: int):
    """Kernel over rows sorted by slice, the slice's own rows (side 0) first, then the anchors that visit it (side 1)."""

    def meet(held: Held, t: pa.Table) -> Iterator[pa.RecordBatch]:
        for n in np.unique(t.column("size").to_numpy()).tolist():
            own = t.filter(pc.equal(t.column("size"), n))
            if same:
                lo, hi = np.full((len(own), 1), -_END), np.full((len(own), 1), _END)
            else:
                lo, hi = windows(own.column("score").combine_chunks(), low, high)
            uid = own.column("uid").to_numpy()
            win, row, score = search(held, uid, np.array(own.column("label").to_pylist(), object), n, own.column("norm").to_numpy(), matrix(own.column("vec").combine_chunks()), lo, hi, k, same)
            at, w = np.divmod(win, max(lo.shape[1], 1))
            yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(w.astype(np.int32)), pa.array(held.uid[row]), pa.array(held.id[row], mask=held.no_id[row]), pa.array(score)], names=["uid", "w", "of", "id", "score"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, at = [], None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = t.column("slice").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = t.slice(lo, hi - lo)
                if key[lo] != at:
                    parts, held, at = [], None, key[lo]
                n = int((own.column("side").to_numpy() == 0).sum())
                if n:
                    parts.append(own.slice(0, n))
                if n < len(own) and (parts or held):
                    held = held or Held.of(pa.concat_tables(parts))
                    parts = []
                    yield from meet(held, own.slice(n))

    return kernel


_CANDIDATE = ["slice", "uid", "bucket", "size", "label", "id", "norm", "vec"]


def _best(held: DataFrame, visits: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(uid, w, of, id, score, rank): the best k rows of each anchor's window w."""
    both = held.select(*_CANDIDATE, F.lit(0).alias("side"), F.array().cast("array<long>").alias("score")).unionByName(visits.select("slice", "uid", F.lit(0).alias("bucket"), "size", "label", F.lit(None).cast("long").alias("id"), "norm", "vec", F.lit(1).alias("side"), "score"))
    met = both.repartition("slice").sortWithinPartitions("slice", "side", "bucket", "uid").mapInArrow(_visits(k, same, low, high), "uid long, w int, of long, id long, score long")
    best = W.partitionBy("uid", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "of")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Per anchor and positive (the `positives` best other rows of its label) the `negatives` best rows of other labels that score low to high percent of the positive.

    anchor: whether a row is one. Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    if positives < 1 or negatives < 1 or scale < 1:
        raise ValueError("positives, negatives and scale must be at least 1")
    held = bucketed(vectors, id_col, vec_col, label_col, anchor, scale)
    anchors = held.where("anchor").select("uid", "size", "label", F.col("id").alias("own"), "norm", "vec")
    # what a slice holds of each label: a few rows a slice
    top = held.groupBy("slice", "size", "label").agg(F.max("norm").alias("top"))
    near = anchors.join(top.drop("top"), ["size", "label"]).withColumn("score", F.array().cast("array<long>"))
    good = cut(_best(held, near, positives, True, low, high).select("uid", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    windowed = anchors.join(good.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "positive_score"))), lambda r: r["positive_score"]).alias("score")), "uid")
    slices = top.groupBy("slice", "size").agg(F.collect_list(F.struct("label", "top")).alias("held"))
    limit = F.array_min("score").cast("double") * (low / 100)
    reaches = lambda h: (h["label"] != F.col("label")) & (F.col("norm") * h["top"] * _SLACK + 1 + F.abs(limit) * 1e-9 >= limit)
    far = windowed.join(slices, "size").where(F.exists("held", reaches)).drop("held")
    bad = _best(held, far, negatives, False, low, high).select("uid", "w", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    out = bad.join(good, ["uid", "w"]).join(anchors.select("uid", "own"), "uid")
    return out.select(F.col("own").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")
