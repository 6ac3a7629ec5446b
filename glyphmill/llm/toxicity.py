"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy.

A text is its set of character 3- to 8-grams inside words (with the boundaries), hashed into 2**18 buckets, so an unseen
misspelling shares most grams with what was learnt. Every bucket has an embedding; a text's vector is the average of those it
holds, weighted by how surely a bucket tells the classes apart: by how many standard errors its log-odds are from zero, much less
below Z of them, but never nothing. These are counted over all labelled training rows, in Spark. A softmax layer scores the
vector. Embeddings and layer are trained together by mini-batch AdaGrad.

Training uses at most MAX_TOXIC and MAX_OTHER labelled rows, those of the smallest hash of the id; the intercept is
corrected to the class shares of all labelled rows, and by MISS: a toxic text that's let through counts as that many others
that are rejected. Only that sample's grams reach the driver, a byte or so each, and the counts of 2**18 buckets. Scoring is one
pass without a shuffle, over whole texts.

Null and empty texts score by the intercept alone. Labels that are null or have a null id are left out; of repeated ids the
largest label counts. With no labelled row of one class, everything scores 0. Every row of docs gets a score. Columns that are
passed through may have any name but held_out, score and predicted, for which a ValueError is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, small_batches
from .textbytes import BYTE_CODE, LOWER, byte_class, pieces, utf8

BITS, SIZES, DIM, Z, SOFT, MISS = 18, (3, 4, 5, 6, 7, 8), 8, 3.3, 3.0, 2.0
MAX_TOXIC, MAX_OTHER, EPOCHS, BATCH, RATE, SEED = 3000, 6000, 6, 32, 0.1, 7
_PIECE, _MARKED = 512 << 10, 256
THRESHOLD, FOLDS, FOLD = 0.7, 3, 1
_LETTER = byte_class((0x61, 0x7A), (0x80, 0xFF))[LOWER]
_CODE = np.where(_LETTER, BYTE_CODE[LOWER], 0x51ED270B).astype(np.uint32)
_STEP, _LAST = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, buckets): each row's distinct buckets, ascending."""
    rows = len(off) - 1
    gap = off + np.arange(rows + 1)  # a space before each row and at the end
    text = np.full(len(buf) + rows + 1, 32, np.uint8)
    fill = np.ones(len(text), bool)
    fill[gap] = False
    text[fill] = buf
    letter, code, n = _LETTER[text], _CODE[text], len(text)
    h, inner, found = code.copy(), np.ones(n, bool), []
    own = np.repeat(np.arange(rows) << BITS, np.diff(gap))
    marks = np.zeros(rows << BITS, bool) if rows <= _MARKED else None
    for k in range(2, max(SIZES) + 1):
        if k > n:
            break
        h = h[: n - k + 1] * _STEP + code[k - 1 :]
        inner = inner[: n - k + 1] & letter[k - 2 : n - 1] if k > 2 else inner[: n - k + 1]
        if k in SIZES:
            g = (h ^ (h >> np.uint32(15))) * (_LAST + np.uint32(2 * k))
            g >>= np.uint32(32 - BITS)
            at = np.flatnonzero(inner)
            pairs = own[at] | g[at]
            if marks is None:
                found.append(pairs)
            else:
                marks[pairs] = True
    pairs = np.flatnonzero(marks) if marks is not None else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def pack(buckets: np.ndarray) -> bytes:
    """Ascending buckets as steps of a byte; 255 is a step without a bucket."""
    gap = np.diff(buckets, prepend=-1)
    far, near = np.divmod(gap, 255)
    out = np.full(int((far + 1).sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = near
    return out.tobytes()


def unpack(steps: np.ndarray) -> np.ndarray:
    return (np.cumsum(steps, dtype=np.int32) - 1)[steps < 255]


@dataclass
class Model:
    """Per bucket its weight and its weight times its logit; the intercept."""

    weight: np.ndarray
    pull: np.ndarray
    intercept: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        rows, buckets = subwords(buf, off)
        total = np.bincount(rows, self.weight[buckets], n)
        logit = self.intercept + np.bincount(rows, self.pull[buckets], n) / np.where(total > 0, total, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def train(texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, sign: np.ndarray, shift: float) -> Model:
    """texts: each text's packed buckets; weight and sign: of each bucket; shift: added to the intercept.

    With two classes every gradient of an embedding is a multiple of the layer's difference, so only the multiples are summed.
    """
    rng = np.random.default_rng(SEED)
    w = weight.astype(np.float64)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    way = layer[:, 1] - layer[:, 0]
    table = rng.normal(0, 0.05, (len(w), DIM)) + sign[:, None] * way / (way @ way)
    seen = np.full(len(w), 1e-6)
    order = np.arange(len(texts))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            grams = [unpack(texts[i]) for i in own]
            row, ids = np.repeat(np.arange(len(own)), [len(g) for g in grams]), np.concatenate(grams)
            total = np.bincount(row, w[ids], len(own))
            share = w[ids] / total[row]
            way = layer[:, 1] - layer[:, 0]
            logit = np.bincount(row, share * (table @ way)[ids], len(own)) + bias[1] - bias[0]
            miss = 1 / (1 + np.exp(-np.clip(logit, -700, 700))) - label[own]
            pulled = np.bincount(ids, share * miss[row], len(w))
            toward = pulled @ table
            seen += pulled**2 * (way**2).mean()
            table -= (RATE * pulled / np.sqrt(seen))[:, None] * way
            layer -= 0.02 * np.stack([-toward, toward], axis=1)
            bias -= 0.02 * miss.sum() * np.array([-1, 1])
    pull = (w * (table @ (layer[:, 1] - layer[:, 0]))).astype(np.float32)
    return Model(weight, pull, float(bias[1] - bias[0] + shift))


def in_fold(id_col: Column, folds: int = FOLDS, fold: int = FOLD) -> Column:
    """crc32 of the id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on the labelled rows outside the held-out fold; None if a class has no row."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~in_fold(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(share) < 2:
        return None
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k, most in ((1, MAX_TOXIC), (0, MAX_OTHER))]
    few = cut(chosen[0].union(chosen[1]))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            label, (buf, off) = batch.column(0).to_numpy(), utf8(batch.column(1))
            rows += np.bincount(label, minlength=2)
            for lo, hi in pieces(off, _PIECE):
                row, bucket = subwords(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n += np.bincount((label[lo:hi][row].astype(np.int64) << BITS) | bucket, minlength=2 << BITS).reshape(2, -1)
        full = np.flatnonzero(n.any(axis=0))
        # bucket -1 counts the rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), *(pa.array(np.append(n[k][full], rows[k])) for k in (0, 1))], names=["bucket", "n0", "n1"])

    # both sides are dealt by id at any size: a plan that changed with the number of labels would make growth hard to foresee
    seen = read.join(known.hint("merge"), "id").select("label", "text").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().set_index("bucket")
    rows = seen.loc[-1] if -1 in seen.index else None
    if rows is None or not rows["n0"] or not rows["n1"]:
        return None
    df = np.zeros((2, 1 << BITS))
    own = seen.drop(index=-1)
    df[:, own.index.to_numpy()] = own[["n0", "n1"]].to_numpy().T
    # a row's worth of prior, dealt by class: a gram that no row holds tells nothing
    n = np.array([rows["n0"], rows["n1"]], float)
    prior = n / n.sum()
    odds = [np.log((df[k] + prior[k]) / (n[k] - df[k] + prior[k])) for k in (0, 1)]
    z = (odds[1] - odds[0]) / np.sqrt(1 / (df[0] + prior[0]) + 1 / (df[1] + prior[1]))
    z[~df.any(axis=0)] = 0
    weight = ((np.abs(z) + 0.01) / (1 + np.exp(SOFT * (Z - np.abs(z))))).astype(np.float32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for lo, hi in pieces(off, _PIECE):
                row, bucket = subwords(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), pa.array([pack(bucket[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["order", "label", "grams"])

    got = read.join(F.broadcast(few), "id").select("label", "text", F.xxhash64("id").alias("order")).mapInArrow(packed, "order long, label int, grams binary").toArrow()
    label, grams = got.column("label").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint8) if len(x.as_buffer()) else np.zeros(0, np.uint8) for x in got.column("grams")]
    # sorted: the result doesn't depend on the order in which tasks end
    place = sorted(range(len(grams)), key=lambda i, o=got.column("order").to_pylist(): (o[i], label[i], grams[i].tobytes()[:64]))
    grams, label = [grams[i] for i in place], label[place]
    n = np.bincount(label, minlength=2)
    shift = np.log(share[1] / share[0]) - np.log(n[1] / n[0]) + np.log(MISS)
    return train(grams, label, weight, np.sign(z), float(shift))


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id_col and `keep`, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or [] if c != id_col]
    if clash := {"held_out", "score", "predicted"} & {id_col, *keep}:
        raise ValueError(f"columns {sorted(clash)} of the input have names of the result")
    fields = [docs.schema[c] for c in [id_col, *keep]]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            buf, off = utf8(batch.column(text_col))
            score = [own.score(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) if own else np.zeros(hi - lo) for lo, hi in pieces(off, _PIECE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*(f.name for f in fields), "score"])

    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    scored = docs.select(*cols).mapInArrow(kernel, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))
    return scored.select(*(F.col(f"`{f.name}`") for f in fields), in_fold(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents not predicted toxic, with their columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    model = fit(docs, labels, id_col, text_col)
    return score_toxicity(held, model, i, t, keep=names).where("predicted = 0").select(*names).toDF(*docs.columns)
