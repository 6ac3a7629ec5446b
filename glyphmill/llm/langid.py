"""Language identification of whole texts: script ranges, per-word scores, and Viterbi over words.

Training counts, for each language, the letters' scripts and the hashed character 1- to 4-grams of its words (boundaries
included) in all training rows; the table of log-probabilities has a fixed number of buckets for each language, and is
broadcast: 256 KB a language. A word's script leaves as
candidates only the languages that use it; the word's score in each is the sum over its grams. Viterbi then labels a text's
words with a penalty for each switch of language, which gives spans of mixed-language text; a document's language is the one
with the most letters, and its score is that share.

All texts of a batch advance through Viterbi together, a word at a time, the ones with most words first; a text of over
LANE words is cut into lanes that run side by side from every possible entry state and are joined exactly afterwards.

Null texts and texts without a letter are `und` with score 0, as is everything if no language could be learned. Null
languages aren't learned from. Rows are judged one by one, repeated ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .textbytes import BYTE_CODE, LOWER, byte_class, pieces, spans, utf8

BITS, GRAMS, SMOOTH, SWITCH, LANE = 16, (1, 2, 3, 4), 0.5, 8.0, 2048
SCRIPT_SHARE = 0.001
UND = "und"
NONE = 1 << BITS
FOLDS, FOLD = 4, 2
_IN_WORD = byte_class((0x61, 0x7A), (0x80, 0xFF))[LOWER]
_CODE = np.where(_IN_WORD, BYTE_CODE[LOWER], 0x51ED270B).astype(np.uint32)
_STEP, _LAST = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_LETTER = re.compile(r"[^\W\d_]")
#: First code points of ranges, and their script.
SCRIPTS = ["other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han"]
SCRIPT_RANGES = [(0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
_RANGE_FROM = np.array([0, *(a for a, _ in SCRIPT_RANGES)])
_RANGE_SCRIPT = np.array([0, *(SCRIPTS.index(s) for _, s in SCRIPT_RANGES)])


def word_scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of each word's first character."""
    pad = np.concatenate([LOWER[buf], np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (pad[starts + k] for k in range(4))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    return _RANGE_SCRIPT[np.searchsorted(_RANGE_FROM, point, "right") - 1]


def word_grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, [bucket of the gram that starts at each position, or NONE] for each gram size, spans of words) of the texts with a space before each row and at the end."""
    rows = len(off) - 1
    gap = off + np.arange(rows + 1)
    text = np.full(len(buf) + rows + 1, 32, np.uint8)
    fill = np.ones(len(text), bool)
    fill[gap] = False
    text[fill] = buf
    inside, code, n = _IN_WORD[text], _CODE[text], len(text)
    words = spans(inside, np.append(gap, n))
    h, inner, out = code.copy(), inside.copy(), []
    for k in range(1, max(GRAMS) + 1):
        if k > n:
            break
        if k > 1:
            h = h[: n - k + 1] * _STEP + code[k - 1 :]
        # of one letter; of two with a letter; else letters between the ends
        inner = inside if k == 1 else inside[: n - 1] | inside[1:] if k == 2 else (inside[1 : n - 1] if k == 3 else inner[: n - k + 1] & inside[k - 2 : n - 1])
        if k in GRAMS:
            g = (h ^ (h >> np.uint32(15))) * (_LAST + np.uint32(2 * k))
            g >>= np.uint32(32 - BITS)
            g[~inner] = NONE
            out.append(g.view(np.int32))
    return text, out, words


@dataclass
class Model:
    langs: list[str]
    #: log-probabilities [language, bucket], 0 for NONE; for each script, a penalty for each language that doesn't use it
    table: np.ndarray
    scripts: np.ndarray

    def words(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores [word, language], letters of each word, and each row's first word."""
        text, found, (starts, ends, first) = word_grams(buf, off)
        first = first[:-1]  # the last row is the space at the end
        score = np.zeros((len(starts), len(self.langs)), np.float32)
        if not len(starts):
            return score, np.zeros(0, np.int64), first
        for k in range(len(self.langs)):
            own = np.zeros(len(text), np.float32)
            for g in found:
                own[: len(g)] += self.table[k][g]
            # a word's grams start at the space before it or inside it
            score[:, k] = np.add.reduceat(own, starts - 1)
        return score + self.scripts[word_scripts(text, starts)], ends - starts, first


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float, lane: int = LANE) -> np.ndarray:
    """The best language of each word of each row of words first[i] : first[i + 1]."""
    n_lang = score.shape[1]
    kind = np.int8 if n_lang < 128 else np.int16
    label = np.zeros(len(score), kind)
    n = np.diff(first)
    many = -(-n // lane)
    row = np.repeat(np.arange(len(n)), many)
    if not len(row):
        return label
    part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][row] + part * lane
    size = np.minimum(lane, first[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    start, size, row, part = start[order], size[order], row[order], part[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # lanes with over t words
    # best[lane, entry, state]: from the state before the lane's first word; lanes that begin a row have no entry state
    entries = n_lang if (part > 0).any() else 1
    best = np.zeros((len(row), entries, n_lang), np.float32)
    if entries > 1:
        best -= penalty * (1 - np.eye(n_lang, dtype=np.float32))
        best[part == 0] = 0
    best += score[start][:, None, :]
    back = [np.zeros(0, kind)]
    states = np.arange(n_lang, dtype=kind)
    for t in range(1, int(size[0])):
        m = alive[t]
        b = best[:m]
        top = b.argmax(axis=2).astype(kind)
        jump = np.take_along_axis(b, top[:, :, None].astype(np.int64), 2) - penalty
        stay = b >= jump
        back.append(np.where(stay, states, top[:, :, None]))
        best[:m] = np.where(stay, b, jump) + score[start[:m] + t][:, None, :]
    # join lanes of a row: the best state at each lane's end, from the last lane backwards
    final, entry = np.zeros(len(row), kind), np.zeros(len(row), kind)
    at = np.empty(len(row), np.int64)
    at[order] = np.arange(len(row))  # lanes in row order
    single = many[row] == 1
    final[single] = best[single, 0].argmax(axis=1)
    head = np.cumsum(many) - many
    for r in np.flatnonzero(many > 1):
        lanes = at[head[r] : head[r] + many[r]]
        reach, came = best[lanes[0], 0], []
        for k in lanes[1:]:
            through = reach[:, None] + best[k]
            came.append(through.argmax(axis=0))
            reach = through.max(axis=0)
        state = int(reach.argmax())
        for k, c in zip(lanes[:0:-1], reversed(came), strict=True):
            final[k], entry[k] = state, c[state]
            state = int(c[state])
        final[lanes[0]] = state
    state = final.copy()
    lanes = np.arange(len(row))
    for t in range(int(size[0]) - 1, -1, -1):
        m = alive[t]
        label[start[:m] + t] = state[:m]
        if t:
            state[:m] = back[t][lanes[:m], entry[:m], state[:m]]
    return label


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, fold: int = FOLD) -> Model | None:
    """Count grams and scripts of all rows outside the fold; None if there's no language."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False)).alias("held")).where("lang is not null and text is not null and not held").select("lang", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            names, (buf, off) = np.array(batch.column(0).to_pylist(), object), utf8(batch.column(1))
            for lo, hi in pieces(off):
                own, back = np.unique(names[lo:hi].astype(str), return_inverse=True)
                text, found, (starts, _, first) = word_grams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                gap = off[lo : hi + 1] - off[lo] + np.arange(hi - lo + 1)
                lang_at = np.repeat(np.append(back, 0), np.diff(np.append(gap, len(text))))
                script = np.bincount(np.repeat(back, np.diff(first)[:-1]) * len(SCRIPTS) + word_scripts(text, starts), minlength=len(own) * len(SCRIPTS)).reshape(len(own), -1) if len(starts) else np.zeros((len(own), len(SCRIPTS)), np.int64)
                n = np.zeros(len(own) << BITS, np.int64)
                for g in found:
                    at = np.flatnonzero(g != NONE)
                    n += np.bincount((lang_at[at] << BITS) | g[at], minlength=len(n))
                for k, lang in enumerate(own):
                    grams[lang] = grams.get(lang, 0) + np.concatenate([n[k << BITS : (k + 1) << BITS], script[k]])
        for lang, n in grams.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "at", "n"])

    counted = known.mapInArrow(kernel, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most languages times buckets
    langs = sorted(got["lang"].unique())
    if not langs:
        return None
    n = np.zeros((len(langs), (1 << BITS) + len(SCRIPTS)))
    n[[langs.index(x) for x in got["lang"]], got["at"].to_numpy(np.int64)] = got["n"]
    grams, script = n[:, : 1 << BITS], n[:, 1 << BITS :]
    table = np.log((grams + SMOOTH) / (grams + SMOOTH).sum(axis=1, keepdims=True))
    share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
    used = share >= SCRIPT_SHARE
    used[:, ~used.any(axis=0)] = True  # a script that no language uses rules none out
    # relative to the mean language: a word's scores say how much better one language is
    table = np.concatenate([table - table.mean(axis=0), np.zeros((len(langs), 1))], axis=1)
    return Model(langs, table.astype(np.float32), np.where(used.T, 0, -50).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """Per row: id_col, lang_pred, score and, if asked for, spans: (first word, words, lang) of each stretch of one language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1)
            buf, off = utf8(texts)
            for lo, hi in pieces(off):
                n = hi - lo
                lang, share = np.full(n, -1), np.zeros(n)
                stretches: list[list[dict]] = [[] for _ in range(n)]
                if own:
                    score, letters, first = own.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    label = viterbi(score, first, penalty)
                    row = np.repeat(np.arange(n), np.diff(first))
                    weight = np.zeros((n, len(own.langs)))
                    for k in range(len(own.langs)):
                        weight[:, k] = np.bincount(row[label == k], letters[label == k], n)
                    has = np.array([bool(s) and _LETTER.search(s) is not None for s in texts.slice(lo, n).to_pylist()], bool)
                    total = weight.sum(axis=1)
                    ok = has & (total > 0)
                    lang[ok] = weight[ok].argmax(axis=1)
                    share[ok] = weight[ok].max(axis=1) / total[ok]
                    if with_spans and len(label):
                        fresh = np.ones(len(label), bool)
                        fresh[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                        a = np.flatnonzero(fresh)
                        for i, j in zip(a.tolist(), [*a[1:].tolist(), len(label)], strict=True):
                            stretches[row[i]].append({"first": int(i - first[row[i]]), "words": j - i, "lang": own.langs[label[i]]})
                names = [*(own.langs if own else []), UND]
                cols = [batch.column(0).slice(lo, n), pa.array([names[k] for k in lang], pa.string()), pa.array(share)]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(stretches, kind)] if with_spans else [])], names=["id", "lang_pred", "score", *(["spans"] if with_spans else [])])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + (", spans array<struct<first:bigint,words:bigint,lang:string>>" if with_spans else "")
    return source.mapInArrow(kernel, schema).withColumnRenamed("id", id_col)
