"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Distinct fingerprints are the nodes, each
with the smallest id that has it, so exact copies collapse before anything is compared.

Trees are sharded by the pigeonhole principle: if two fingerprints differ in at most r bits, one of r + 1 bit blocks is
equal, so a shard is a block and its value, and each fingerprint goes to r + 1 shards. A shard's BK-tree hangs each child
under its integer Hamming distance to the parent; a search follows only edges within r of the query's distance. A shard
beyond SHARD fingerprints is dealt into several trees, and its fingerprints are sent to each of them in turn: every pair
still meets, and no task holds more than two times SHARD. Trees are built where they're used: broadcasting the trees of all
documents would pass every fingerprint through the driver. A shard yields a spanning forest of its links, never all pairs.

Nulls and empty texts have fingerprint zero and are linked like any other. Rows with the same id share a component. A null
id links with nothing; its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import components, cut, small_batches
from .textbytes import LOWER, U64, byte_class, pieces, spans, utf8

SHINGLE, RADIUS, SEED = 4, 4, 42
SHARD = 4096
_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: For each byte value its eight bits in eight byte lanes.
_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).reshape(-1).view(U64)


def shingle_spans(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words joined by single spaces, start and end of each shingle in them, and each row's first shingle."""
    starts, ends, first = spans(~_SPACE[buf], off)
    length = ends - starts
    stop = np.cumsum(length + 1)
    joined = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[stop - 1] = False
    joined[inside] = LOWER[buf[~_SPACE[buf]]]
    begin, stop = stop - 1 - length, stop - 1
    words = np.diff(first)
    many = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    head = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - head[:-1], many) + np.arange(head[-1])
    last = np.minimum(at + size, np.repeat(first[1:], many)) - 1
    return joined.tobytes(), begin[at], stop[last], head


def majority(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Per row of hashes h[head[i] : head[i + 1]]: the bits set in over half of them."""
    n = np.diff(head)
    parts = -(-n // 255)  # lanes of a byte hold up to 255
    part_head = np.concatenate([[0], np.cumsum(parts)])
    row = np.repeat(np.arange(len(n)), parts)
    seg = head[row] + 255 * (np.arange(part_head[-1]) - part_head[row])
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    by_byte = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[by_byte[:, k]], seg).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes.astype(np.int64), part_head[full], axis=0)
        bits = (2 * count > n[full, None]).astype(U64) << np.arange(8, dtype=U64)
        out[full] |= bits.sum(axis=1, dtype=U64) << U64(8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for lo, hi in pieces(off):
                text, a, b, head = shingle_spans(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle)
                h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a.tolist(), b.tolist(), strict=True)), U64, len(a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(majority(h, head).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """Fingerprints under a root; a child's edge is its Hamming distance to its parent."""

    def __init__(self):
        self.value: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        self.value.append(x)
        self.edges.append({})
        new, at = len(self.value) - 1, 0
        while new:
            d = (self.value[at] ^ x).bit_count()
            down = self.edges[at].get(d)
            if down is None:
                self.edges[at][d] = new
                break
            at = down
        return new

    def near(self, x: int, radius: int) -> list[int]:
        if not self.value:
            return []
        out, todo, value, edges = [], [0], self.value, self.edges
        while todo:
            at = todo.pop()
            d = (value[at] ^ x).bit_count()
            if d <= radius:
                out.append(at)
            lo, hi = d - radius, d + radius
            todo += [child for e, child in edges[at].items() if lo <= e <= hi]
        return out


def forest(tree_of: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among tree_of (and, if given, between probes and it)."""
    tree, seen, out = BKTree(), {}, []

    def root(x: int) -> int:
        while seen.setdefault(x, x) != x:
            seen[x] = x = seen[seen[x]]
        return x

    def link(x: int) -> None:
        for k in tree.near(x, radius):
            a, b = root(x), root(tree.value[k])
            if a != b:
                seen[a] = b
                out.append((x, tree.value[k]))

    for x in tree_of:
        if not probes:
            link(x)
        tree.add(x)
    for x in probes:
        link(x)
    return out


def _shard_links(radius: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and tree pair; a shard's rows may go on in the next batch."""
        held: pa.Table | None = None

        def solve(t: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            keys = np.stack([t.column(c).to_numpy() for c in ("block", "value", "a", "b")])
            fresh = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            cuts = [*np.flatnonzero(fresh).tolist(), t.num_rows]
            fp, own, links = t.column("fp").to_numpy().view(U64).tolist(), t.column("own").to_pylist(), []
            for i, j in zip(cuts[: -1 if last else -2], cuts[1 : None if last else -1], strict=True):
                if j - i > 1:
                    links += forest([x for x, o in zip(fp[i:j], own[i:j], strict=True) if o], [x for x, o in zip(fp[i:j], own[i:j], strict=True) if not o], radius)
            return links, None if last else t.slice(cuts[-2])

        def rows(links: list) -> pa.RecordBatch:
            x = np.array(links, U64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["x", "y"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if held.num_rows:
                links, held = solve(held, False)
                yield rows(links)
        if held is not None and held.num_rows:
            yield rows(solve(held, True)[0])

    return kernel


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(x, y): fingerprints at most `radius` bits apart; enough links to span each component. nodes: distinct longs fp."""
    blocks = radius + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    keys = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", edge[i]).bitwiseAND((1 << (edge[i + 1] - edge[i])) - 1).alias("value")) for i in range(blocks)))).alias("s")).select("fp", "s.block", "s.value")
    sizes = keys.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keys.join(sizes, ["block", "value"]).withColumn("trees", F.ceil(F.col("n") / shard).cast("int")).withColumn("tree", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # trees a <= b meet in one task: a is built, and b's fingerprints search it (a = b: each searches before it's added)
    pairs = dealt.select("block", "value", "fp", "tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other"))
    pairs = pairs.select("block", "value", F.least("tree", "other").alias("a"), F.greatest("tree", "other").alias("b"), "fp", (F.col("tree") <= F.col("other")).alias("own"))
    cols = ["block", "value", "a", "b"]
    return pairs.repartition(*cols).sortWithinPartitions(*cols, "fp").mapInArrow(_shard_links(radius), "x long, y long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links), kept."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = fingerprint_links(nodes, radius, shard)
    edges = links.join(nodes.select(F.col("fp").alias("x"), F.col("rep").alias("a")), "x").join(nodes.select(F.col("fp").alias("y"), F.col("rep").alias("b")), "y")
    found = components(edges.select("a", "b"))
    member = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(member, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with their columns as they were; rows with a null id stay.

    Rows that repeat that id are copies of it by id, not by text, and stay too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    found = simhash_dedup(held, i, t, **options)
    gone = found.where(~F.col("kept")).select(F.col(i).alias("gone")).distinct()
    return held.join(gone, F.col(i) == F.col("gone"), "left_anti").select(*names).toDF(*docs.columns)
