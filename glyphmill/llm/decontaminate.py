"""Benchmark decontamination by winnowing.

Both sides are words (lower-cased A-Z, runs of digits, letters a-z and non-ASCII characters). From every 13-word window
the minimum 7-word-gram hash is kept as a fingerprint, so two texts that share 13 words share a fingerprint. Fingerprints
of documents are looked up in a filter of the benchmark's, and each hit is extended to the 13-word windows around it, which are
joined with the benchmark's windows. Items of fewer words are windows of their own length and are probed at every word.

The benchmark is winnowed in Spark like the documents, and may be of any size: what's broadcast is two Bloom filters of fixed
size, of its fingerprints and of its windows. What passes both goes to the join of windows, which is exact; with a larger
benchmark more passes. So documents send only likely hits, and a passage that a third of them hold is one side of an
equi-join, which adaptive execution can split. Nothing of the benchmark reaches the driver but the lengths of its short items.

Nulls and empty texts have no words: zero counts, not contaminated. Repeated rows each get their own result. An item with
a null id counts as the id "null". Words are compared by 64-bit hashes, windows by hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import KeyFilter, cut, small_batches
from .textbytes import BYTE_CODE_LOWER, LOWER, U64, byte_class, grams, mix, pieces, slide, span_hashes, spans, utf8

WINDOW, GRAM, SHARE = 13, 7, 20
_IN_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))[LOWER]
_SIZE_SALT = U64(0x9E3779B97F4A7C15)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each row's first word (rows + 1)."""
    starts, ends, first = spans(_IN_WORD[buf], off)
    return span_hashes(buf, starts, ends, BYTE_CODE_LOWER), first


def window_hash(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = words[starts]
    for t in range(1, n):
        h = h * U64(0xC2B2AE3D27D4EB4F) + words[starts + t]
    return mix(h + U64(n))


def winnow(gram: np.ndarray, left: np.ndarray, n: int, k: int) -> np.ndarray:
    """True where a gram is the minimum of some n-word window inside its row; left: words from here to the row's end."""
    w = n - k + 1
    low = slide(gram, w, np.minimum)
    low[left < n] = 0
    # the largest minimum among windows that start at i - w + 1 .. i
    back = slide(low[::-1], w, np.maximum)[::-1]
    return (back == gram) & (left >= k) & (back > 0)


def fingerprint_positions(words: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, positions that winnowing keeps, words left in the row)."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    gram = grams(words, k)
    return gram, np.flatnonzero(winnow(gram, left, n, k)), left


def probes(words: np.ndarray, first: np.ndarray, size: int, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, their fingerprints, words left at every position) for windows of `size` words: winnowed ones at n, else every gram of a window's beginning."""
    if size == n:
        gram, at, left = fingerprint_positions(words, first, n, k)
        key = gram[at]
    else:
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
        at = np.flatnonzero(left >= size)
        key = window_hash(words, at, min(k, size))
    return at, key + U64(size * int(_SIZE_SALT) % 2**64), left


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int, k: int) -> DataFrame:
    """(size, key, item) of every window of every item, and, with a null item, (size, fingerprint) of what it's found by."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for lo, hi in pieces(off):
                words, first = word_hashes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                count = np.diff(first)
                for size in np.unique(np.minimum(count[count > 0], n)).tolist():
                    own = np.flatnonzero(count == size if size < n else count >= n)
                    many = count[own] - size + 1
                    starts = np.repeat(first[:-1][own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    at, found, _ = probes(words, first, size, n, k)
                    mine = np.isin(np.searchsorted(first, at, "right") - 1, own)
                    key = np.concatenate([window_hash(words, starts, size), np.unique(found[mine])]).view(np.int64)
                    item = pa.concat_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(own, many))), pa.nulls(len(key) - len(starts), pa.string())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), size, np.int32)), pa.array(key), item], names=["size", "key", "item"])

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.mapInArrow(kernel, "size int, key long, item string").distinct()


def covered(at: Column) -> Column:
    """Words that windows (position << 32 | size, in order) cover: each adds what lies behind the end of those before."""

    def add(seen: Column, a: Column) -> Column:
        start = F.shiftright(a, 32)
        end = start + a.bitwiseAND(2**32 - 1)
        new = F.greatest(end - F.greatest(start, seen["end"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + new).alias("n"))

    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, none, add, lambda seen: seen["n"])


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, n: int, k: int, share: int, keep: list[str]) -> DataFrame:
    """id_col, keep, __k and __k2 (a key of id and text), n_words, n_hit, n_items, item_ids, contaminated."""
    if not 0 < k <= n < 2**31:
        raise ValueError("k must be between 1 and n, and n under 2**31")
    small_batches(docs.sparkSession)
    bench = cut(benchmark_windows(benchmark, item_col, item_text_col, n, k))
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # n at most
    windows = bench.where("item is not null")
    by_print, by_window, test = KeyFilter(bench.where("item is null"), "key"), KeyFilter(windows, "key"), KeyFilter.test
    prints, wins = by_print.shared, by_window.shared
    fields = [docs.schema[c] for c in [id_col, *keep]]
    names = [*(f.name for f in fields), "__k", "__k2"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(batch.num_columns - 1))
            for lo, hi in pieces(off):
                words, first = word_hashes(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                where, hashes = [np.zeros((2, 0), np.int64)], [np.zeros(0, U64)]
                for size in sizes:
                    at, key, left = probes(words, first, size, n, k)
                    at = at[test(prints.value, key)]
                    if size == n and len(at):  # extend: all windows that hold the fingerprint
                        at = np.unique((at[:, None] - np.arange(n - k + 1)).ravel())
                        at = at[at >= 0]
                    at = at[left[at] >= size]
                    h = window_hash(words, at, size)
                    ok = test(wins.value, h)
                    row = np.searchsorted(first, at[ok], "right") - 1
                    where.append(np.stack([row, (at[ok] - first[row]) << 32 | size]))
                    hashes.append(h[ok])
                found, h = np.concatenate(where, axis=1), np.concatenate(hashes)
                order = np.argsort(found[0], kind="stable")
                head = pa.array(np.searchsorted(found[0][order], np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(head, pa.array(x[order])) for x in (found[1], h.view(np.int64))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(np.diff(first), pa.int64()), *lists], names=[*names, "n_words", "__at", "__h"])

    keyed = docs.select(*(F.col(f"`{f.name}`") for f in fields), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__k"), F.hash(F.col(f"`{text_col}`"), F.lit(1)).alias("__k2"), F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "__k long, __k2 int, n_words long, __at array<long>, __h array<long>"])
    rows = cut(keyed.mapInArrow(kernel, schema))
    hits = rows.where("size(__at) > 0").select("__k", "__k2", F.explode(F.arrays_zip("__at", "__h")).alias("x")).select("__k", "__k2", F.col("x.__at").alias("at"), F.col("x.__h").alias("key")).distinct()
    met = hits.join(windows.select("key", "item"), "key").groupBy("__k", "__k2").agg(F.collect_set("at").alias("at"), F.sort_array(F.collect_set("item")).alias("item_ids"))
    met = met.select("__k", "__k2", covered(F.sort_array("at")).alias("n_hit"), "item_ids")
    out = rows.drop("__at", "__h").join(met, ["__k", "__k2"], "left")
    hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(*(F.col(f"`{c}`") for c in names), "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WINDOW, k: int = GRAM, share: int = SHARE, keep: list[str] | None = None,
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, item_ids (sorted as strings), items_sha256, contaminated.

    A document is contaminated if any word is hit and at least 1 in `share` words is. `keep`: further columns to pass
    through; without them only the id and the text are read.
    """
    keep = [c for c in keep or [] if c != id_col]
    if clash := {"n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"} & {id_col, *keep}:
        raise ValueError(f"columns {sorted(clash)} of the input have names of the result")
    names = [f"c{i}" for i in range(len(keep) + 2)]
    held = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in zip([id_col, text_col, *keep], names, strict=True)))
    out = _judged(held, benchmark, names[0], names[1], item_col, item_text_col, n, k, share, names[2:])
    shown = [F.col(a).alias(c) for a, c in zip([names[0], *names[2:]], [id_col, *keep], strict=True)]
    return out.select(*shown, "n_words", "n_hit", "n_items", "item_ids", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, k: int = GRAM, share: int = SHARE) -> DataFrame:
    """The documents that aren't contaminated, with their columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    gone = _judged(held, benchmark, i, t, item_col, item_text_col, n, k, share, []).where("contaminated").select("__k", "__k2").distinct()
    keyed = held.withColumns({"__k": F.xxhash64(i, t), "__k2": F.hash(F.col(t), F.lit(1))})
    return keyed.join(gone, ["__k", "__k2"], "left_anti").select(*names).toDF(*docs.columns)
