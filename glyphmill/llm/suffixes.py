"""Removal of byte strings of SPAN bytes that start in more than one place, by sorting sampled suffixes.

Suffixes are sampled, named, sorted and merged as a difference-cover construction does, with one change that its budget forces
(see README): the sample is chosen by content instead of by position.

* Sample. Every window of SPAN bytes names one position in it, the first minimum of its GRAM-byte gram hashes: a cover of
  all windows, in which equal windows have their sampled position at the same offset.
* Sort. Each sampled suffix has two names: its first GRAM bytes, and all bytes that its windows cover. Suffixes are sorted by
  these names over the cluster, and each is compared with its neighbours. No window through a suffix repeats where both
  neighbours begin otherwise; all of them do where one has the same longer name.
* Recursion on names. What neither settles is cut into cells of CELL window starts, at fixed offsets from the sampled
  suffix, and named by the bytes that all windows of a cell share and by those that they cover together; sorted and compared
  again.
* Merge. What's left is merged window by window: a start that isn't sampled is compared by its bytes up to the sampled suffix
  and that suffix's beginning.

Only equality is asked for, so names are 64-bit hashes and the order in which suffixes are sorted is that of the hashes: equal
prefixes still stand next to each other, and no prefix is shuffled as text. Rows are dealt by ranges of (name, text, place), so
a string that a third of all texts hold fills several partitions instead of one; names that go on from one partition to the
next are the only thing that the driver sees, at most two a partition.

Texts are read again for each round; a Bloom filter of fixed size keeps those that a round doesn't need out of its shuffle.
Memory follows the longest text: some 40 bytes for each of its bytes.

A passage is a run made of shorter repeated strings that holds many whole words. Passages are counted, not removed: strings of fewer
bytes are looked for in all texts, and strings of SPAN bytes then only in texts with enough of the shorter ones, which misses none.

Null and empty texts have no bytes. Matches never cross texts. Repeated rows count as occurrences of each other, so a text
of SPAN bytes or more that's there twice is removed twice. Ids may repeat or be null. Columns that are passed through may
have any name but those of the result, for which a ValueError is raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import KeyFilter, cut, release, remove, shared_path, small_batches
from .textbytes import BASE, BASE_INV, BYTE_CODE, U64, byte_class, mix, pieces, powers, slide, spans, utf8

SPAN, CELL = 400, 16
_PIECE = 512 << 10
_POS_BITS = 31
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
_pow, _inv = powers(BASE, 1 << 10), powers(BASE_INV, 1 << 10)


class Prefix:
    """Hashes of any stretch of a buffer, from running sums."""

    def __init__(self, buf: np.ndarray):
        global _pow, _inv
        n = len(buf) + 1
        if len(_pow) < n:
            size = 1 << (n - 1).bit_length()
            _pow, _inv = powers(BASE, size), powers(BASE_INV, size)
        self.run = np.zeros(n, U64)
        np.cumsum(BYTE_CODE[buf] * _pow[: n - 1], dtype=U64, out=self.run[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.run[b] - self.run[a]) * _inv[a]


def pack(at: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A sampled position in its text, and how far before it its first and its last window start."""
    return (at << 20) | (far << 10) | near


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 20, (x >> 10) & 1023, x & 1023


def samples(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, packed positions, gram names, names of all that the windows cover)."""
    none = np.zeros(0, np.int64)
    if len(buf) < span:
        return none, none, none, none
    names = Prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    name = mix((names.run[gram:] - names.run[: len(at)]) * _inv[: len(at)])
    # the position in the low bits: the minimum carries it along, and of equal names the first wins
    low = slide((name >> U64(_POS_BITS) << U64(_POS_BITS)) | at.astype(U64), span - gram + 1, np.minimum)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    s = np.arange(len(buf) - span + 1)
    s = s[s + span <= off[1:][row[s]]]
    if not len(s):
        return none, none, none, none
    own = (low[s] & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(s)) - 1
    p, lo, hi = own[first], s[first], s[last]
    whole = mix(names.of(lo, hi + span) + (p - lo).astype(U64) * U64(0x2545F4914F6CDD1D) + (hi - lo).astype(U64))
    return row[lo], pack(p - off[row[lo]], p - lo, p - hi), name[p].view(np.int64), whole.view(np.int64)


def cells(names: Prefix, off: np.ndarray, row: np.ndarray, packed: np.ndarray, span: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts by cells of `width`: (index into packed, packed part, name of the bytes all windows of a cell share, of those the part's windows cover)."""
    at, far, near = unpack(packed)
    many = far // width - near // width + 1
    i = np.repeat(np.arange(len(packed)), many)
    cell = near[i] // width + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    p = at[i] + off[row[i]]
    salt = (cell.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(width)
    last = p - cell * width  # the cell's last window start; its first is width - 1 before
    shared = mix(names.of(last, last - width + 1 + span) + salt)
    lo, hi = np.minimum(far[i], cell * width + width - 1), np.maximum(near[i], cell * width)
    covered = mix(names.of(p - lo, p - hi + span) + ~salt + (lo * 1024 + hi).astype(U64) * U64(0x2545F4914F6CDD1D))
    return i, pack(at[i], lo, hi), shared.view(np.int64), covered.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with a key of 96 bits; rows with the same id and text share it, and have the same result."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.hash(F.col(text_col), F.lit(1)).alias("k2"), F.col(text_col).alias("text"))


_PART = "k long, k2 int, at long, shared long, covered long"


def compare_neighbours(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of parts sorted by their names: those that share with a neighbour all that they cover; those that share less.

    One of each settled kind stays open too where others share less with it: these may repeat some of its windows.
    """
    order = ["shared", "covered", "k", "k2", "at"]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("k", pa.int64()), ("k2", pa.int32()), *((c, pa.int64()) for c in ("at", "shared", "covered"))]))])
        if not held.num_rows:
            return
        s, c = (held.column(x).to_numpy() for x in ("shared", "covered"))
        as_s = s[1:] == s[:-1]
        as_c = as_s & (c[1:] == c[:-1])
        same = [np.append(x, False) | np.append(False, x) for x in (as_s, as_c)]
        own_s, own_c = (np.cumsum(~np.append(False, x)) - 1 for x in (as_s, as_c))
        # where a name goes on in another partition, its neighbours there aren't known yet
        others = (np.bincount(own_s)[own_s] > np.bincount(own_c)[own_c]) | (own_s == 0) | (own_s == own_s[-1])
        witness = np.append(True, ~as_c) & others
        keep = same[0].copy()
        keep[[0, -1]] = True
        part = pa.array(np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32))
        mask = pa.array(keep)
        out = held.filter(mask).combine_chunks()
        out = pa.Table.from_arrays([*out.columns, *(pa.array(x[keep]) for x in (same[0], same[1], witness)), part], names=[*out.schema.names, "same_shared", "same_covered", "witness", "part"])
        yield from out.to_batches(max_chunksize=100_000)

    ranged = parts.select("k", "k2", "at", "shared", "covered").repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(ranged.mapInArrow(kernel, f"{_PART}, same_shared boolean, same_covered boolean, witness boolean, part int"))
    ends = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min(F.struct("shared", "covered")), F.max(F.struct("shared", "covered"))).collect())
    across = [(a[2], b[1]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    on_s, on_c = [x[0] for x, y in across if x[0] == y[0]], [x[1] for x, y in across if x == y]
    found = placed.withColumn("same_shared", F.col("same_shared") | F.col("shared").isin(on_s)).withColumn("same_covered", F.col("same_covered") | F.col("covered").isin(on_c))
    return found.where("same_covered").select("k", "k2", "at"), found.where("same_shared and (not same_covered or witness)").select("k", "k2", "at")


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int | None = None, cell: int = CELL, among: DataFrame | None = None, spool: bool = False) -> DataFrame:
    """(k, k2, at): packed ranges of window starts whose window also starts elsewhere, by the key of the text.

    among: keys k of the texts that may hold such windows; of the others only some are searched.
    spool: samples are kept in files while they are sorted, as a sort by ranges reads its input twice; without, they are made twice.
    """
    gram = gram or max(1, span * 6 // 25)
    if not 0 < gram <= span < 1024:
        raise ValueError("gram must be between 1 and span, span below 1024")
    cell = min(cell, span)  # the windows of a wider cell share no bytes
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _keyed(docs, id_col, text_col)
    if among is not None:
        keyed = KeyFilter(among, "k").may_hold(keyed, "k")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(2))
            for lo, hi in pieces(off, _PIECE):
                row, at, name, whole = samples(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], span, gram)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at), pa.array(name), pa.array(whole)], names=["k", "k2", "at", "shared", "covered"])

    def named(width: int):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, off = utf8(batch.column(2))
                ats = batch.column(3)
                head, flat = ats.offsets.to_numpy().astype(np.int64), ats.values.to_numpy()
                for lo, hi in pieces(off, _PIECE):
                    row = np.repeat(np.arange(hi - lo), np.diff(head[lo : hi + 1]))
                    own = off[lo : hi + 1] - off[lo]
                    i, part, shared, covered = cells(Prefix(buf[off[lo] : off[hi]]), own, row, flat[head[lo] : head[hi]], span, width)
                    take = pa.array(row[i] + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(part), pa.array(shared), pa.array(covered)], names=["k", "k2", "at", "shared", "covered"])

        return kernel

    sampled, path = keyed.mapInArrow(sample, _PART), shared_path(spark, "samples")
    if spool:
        sampled.write.parquet(path)
        sampled = spark.read.schema(_PART).parquet(path)
    settled, rest = compare_neighbours(sampled)
    if spool:
        remove(spark, path)  # what neighbours share is checkpointed
    done = [settled]
    for width in (cell, 1):
        need = cut(rest.groupBy("k", "k2").agg(F.collect_set("at").alias("ats")))
        release(spark)
        texts = KeyFilter(need, "k").may_hold(keyed, "k")
        parts = cut(texts.join(need.hint("shuffle_hash"), ["k", "k2"]).select("k", "k2", "text", "ats").mapInArrow(named(width), _PART))
        settled, rest = compare_neighbours(parts)
        done.append(settled)
    # what a single window shares is what it covers, so the last round leaves nothing open
    return done[0].union(done[1]).union(done[2])


def _by_text(starts: DataFrame, name: str) -> DataFrame:
    return starts.groupBy("k", "k2").agg(F.collect_set("at").alias(name))


def covered_bytes(text: np.ndarray, packed: np.ndarray, span: int, min_words: int = 0) -> tuple[np.ndarray, int]:
    """(bytes that windows at the packed starts cover, their runs), without runs of fewer than min_words whole words."""
    p, far, near = unpack(packed)
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, p - far, 1)
    np.add.at(change, p - near + span, -1)
    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    first, last = np.flatnonzero(gone[1:-1] & ~gone[:-2]), np.flatnonzero(gone[1:-1] & ~gone[2:]) + 1
    gone = gone[1:-1]
    if min_words:
        start, end, _ = spans(~_SPACE[text], np.array([0, len(text)]))
        few = np.searchsorted(end, last, "right") - np.searchsorted(start, first) < min_words
        for a, b in zip(first[few].tolist(), last[few].tolist(), strict=True):
            gone[a:b] = False
        return gone, int((~few).sum())
    return gone, len(first)


def _trim(fields: list, text_at: int, span: int, with_text: bool, min_words: int, passages: tuple[int, int] | None = None, beside: KeyFilter | None = None):
    """Rows with columns fields, then k, k2, ats, near (packed ranges of span and of the passages' span, or null). beside: leave out the rows whose k it may hold."""
    shared, test = (beside.shared, beside.test) if beside else (None, None)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(~test(shared.value, batch.column(len(fields)).to_numpy())))
            cols, ats, near = batch.columns[: len(fields)], batch.column(len(fields) + 2), batch.column(len(fields) + 3)
            buf, off = utf8(batch.column(text_at))
            out: list[list] = [[], [], [], [], [], []]
            for r in range(batch.num_rows):
                text = buf[off[r] : off[r + 1]]
                size, runs, many = len(text), 0, 0
                if passages and near[r].is_valid:
                    many = covered_bytes(text, near[r].values.to_numpy(), *passages)[1]
                if ats[r].is_valid:
                    gone, runs = covered_bytes(text, ats[r].values.to_numpy(), span, min_words)
                    text = text[~gone]
                kept = text.tobytes()
                for o, v in zip(out, (size, size - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, many), strict=True):
                    o.append(v)
            if with_text:
                cols[text_at] = pa.array([t if ok else None for t, ok in zip(out[4], cols[text_at].is_valid().to_pylist(), strict=True)], pa.string())
            found = {"n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string())}
            if passages:
                found["n_passages"] = pa.array(out[5], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, *found.values()], names=[*fields, *found])

    return kernel


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False, span: int = SPAN, gram: int | None = None, cell: int = CELL, min_words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """Per row: id_col and `keep`, n_bytes, n_removed, n_spans, kept_sha256. with_text: also text_col, with the bytes removed.

    min_words: runs of fewer whole words (between blanks) stay.
    passages: (bytes, words); also n_passages, the runs of at least so many whole words, made of strings of so many bytes
    (at most span) that start in more than one place. They change nothing else.

    A character that loses some of its bytes is left out of the text whole; kept_sha256 is over the bytes as they are.
    """
    cols = list(dict.fromkeys([id_col, *(keep or []), text_col]))
    if clash := {"n_bytes", "n_removed", "n_spans", "kept_sha256", "__k", "__k2", "__ats", "__near", *(["n_passages"] if passages else [])} & set(cols):
        raise ValueError(f"columns {sorted(clash)} of the input have names of the result")
    if passages and passages[0] > span:
        raise ValueError("strings of passages must not be longer than span")
    fine = among = None
    if passages:
        fine = cut(_by_text(repeated_starts(docs, id_col, text_col, passages[0], None, cell, spool=True), "near"))
        release(docs.sparkSession)
        # a repeated window of span bytes holds span - passages[0] + 1 repeated windows of the shorter kind
        starts = F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + F.shiftright(x, 10).bitwiseAND(1023) - x.bitwiseAND(1023) + 1)
        among = fine.where(starts > span - passages[0]).select("k")
    ranges = _by_text(repeated_starts(docs, id_col, text_col, span, gram, cell, among, bool(passages)), "ats")
    ranges = cut(fine.join(ranges, ["k", "k2"], "left").select("k", "k2", "ats", "near") if passages else ranges.withColumn("near", F.lit(None).cast("array<long>")))
    release(docs.sparkSession)
    held = docs.select(*cols, F.xxhash64(F.col(id_col), F.col(text_col)).alias("__k"), F.hash(F.col(text_col), F.lit(1)).alias("__k2"))
    found = KeyFilter(ranges, "k")
    hit = found.may_hold(held, "__k").join(ranges.select(F.col("k").alias("__k"), F.col("k2").alias("__k2"), F.col("ats").alias("__ats"), F.col("near").alias("__near")).hint("shuffle_hash"), ["__k", "__k2"], "left")
    clean = held.withColumns({c: F.lit(None).cast("array<long>") for c in ("__ats", "__near")})
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["n_passages long"] if passages else [])])
    order = [*(F.col(f"`{c}`") for c in cols), "__k", "__k2", "__ats", "__near"]
    out = [df.select(*order).mapInArrow(_trim(cols, cols.index(text_col), span, with_text, min_words, passages, beside), schema) for df, beside in ((hit, None), (clean, found))]
    both = out[0].union(out[1])
    return both if with_text else both.drop(*([text_col] if text_col not in [id_col, *(keep or [])] else []))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes removed from text_col, other columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    return remove_repeats(held, i, t, keep=names, with_text=True, **options).select(*names).toDF(*docs.columns)
