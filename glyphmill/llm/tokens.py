"""Token ids of whole texts by a public tokenizer file, encoding each distinct stretch of text once.

A text is cut before single white-space bytes that stand between other characters. For the two tokenizer families used
here (byte-level BPE and BPE with word ends, both of which never merge across such a place) the ids of a text are the ids of
its stretches one after another, so a worker keeps a table from a stretch's 64-bit hash to its ids and encodes only new ones.
Only speed depends on that table's size; it starts afresh when it's full.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import byte_class, pieces, span_hashes, utf8

END_ID = 2
CACHE_STRETCHES = 1_200_000
_ASCII_SPACE = byte_class((0x09, 0x0D), (0x20, 0x20))
#: Second-last and first bytes of the UTF-8 forms of white space beyond ASCII; no cut is made near them.
_TAIL = byte_class((0xC2, 0xC2), (0x80, 0x81), (0x9A, 0x9A))
_HEAD = byte_class((0xC2, 0xC2), (0xE1, 0xE3))


def stretch_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where stretches start: at rows with text, and at single white-space bytes between characters that aren't."""
    n = len(buf)
    first = off[:-1][np.diff(off) > 0]
    if n < 3:
        return first
    space = _ASCII_SPACE[buf]
    cut = np.zeros(n, bool)
    near = _TAIL[buf[:-2]]
    far = np.zeros(n - 2, bool)
    far[1:] = near[:-1] & (buf[1:-2] >= 0x80)
    cut[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:] & ~far & ~_HEAD[buf[2:]]
    # a two-byte space (U+0085, U+00A0) ends just before the cut
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids_of(buf, off): the ids of all rows one after another, and each row's first (rows + 1)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Add stretches, by ascending hash."""
        if len(self.known) > CACHE_STRETCHES:
            self.clear()
        size, place = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), 20_000):
            got = self.encode(texts[lo : lo + 20_000])
            own = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for x in got for i in x), np.uint32, int(own.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2, np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            size[lo : lo + len(own)] = own
            place[lo : lo + len(own)] = self.used + np.cumsum(own) - own
            self.used += len(flat)
        at = np.searchsorted(self.known, hashes)
        self.known, self.place, self.size = np.insert(self.known, at, hashes), np.insert(self.place, at, place), np.insert(self.size, at, size)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def ids_of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = buf.tobytes()
        if any(s.encode() in text for s in self.specials):  # their strings may hold a cut
            got = self.encode([text[i:j].decode("utf-8", "replace") for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.fromiter((i for x in got for i in x), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)
        starts = stretch_starts(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(buf))
        every, where, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at, known = self.find(every)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.known) > CACHE_STRETCHES:
                self.clear()
                new = np.arange(len(every))
            self.learn(every[new], [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in where[new].tolist()])
            at, _ = self.find(every)
        at = at[back]
        size = self.size[at]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(self.place[at] - stop + size, size) + np.arange(stop[-1])]
        head = np.concatenate([[0], stop])[np.searchsorted(starts, off)]
        return ids, head


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, head: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with end_id after each row, and each row's first."""
    first = head + np.arange(len(head))
    out = np.empty(len(ids) + len(head) - 1, np.uint32)
    ends = np.zeros(len(out), bool)
    ends[first[1:] - 1] = True
    out[ends], out[~ends] = end_id, ids
    return out, first


def token_batches(batch: pa.RecordBatch, text: int, path: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids with the end id, each row's first) for pieces of the batch."""
    buf, off = utf8(batch.column(text))
    own = encoder(path)
    for lo, hi in pieces(off, limit):
        ids, head = own.ids_of(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, *with_end(ids, head)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
