"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id int, text string"
SMALL = "/root/testdata/sf0.001"


def words1(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def edge_docs():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "γάμμα", "d4", "é", "x", "y"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, " \n\t "), (103, "word " * 20_000), (7, rows[7][1]), (7, rows[7][1]), (104, "<|endoftext|> </s>")]


# --- op1


def brute_contamination(docs, bench, n=13):
    wins = {}
    for item, t in bench:
        w = words1(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, items = words1(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (got := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    items |= got
        s = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), s, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_contamination(spark, parts):
    from glyphmill.llm.decontaminate import contamination

    rng = random.Random(1)
    docs = edge_docs()
    long = [t for _, t in docs if t and len(t.split()) > 20 and len(t) < 5000]
    bench = [(i, " ".join(rng.choice(long).split()[k : k + rng.choice([1, 3, 8, 13, 30])])) for i, k in enumerate(rng.choices(range(15), k=40))] + [(None, "alpha beta"), (90, None), (91, "!!"), (3, long[0])]
    got = contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, "item_id int, text string").repartition(parts))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == brute_contamination(docs, bench)


def test_contamination_of_nothing(spark):
    from glyphmill.llm.decontaminate import contamination, decontaminate

    docs, none = spark.createDataFrame(edge_docs(), DOCS), spark.createDataFrame([], "item_id int, text string")
    assert not contamination(docs, none).where("n_hit > 0").count()
    assert contamination(docs.limit(0), none).count() == 0
    more = docs.withColumn("n_words", F.lit(1)).withColumn("c0", F.lit("x"))
    assert decontaminate(more, none).columns == more.columns
    with pytest.raises(ValueError, match="n_words"):
        contamination(more, none, keep=["n_words"])


@pytest.mark.parametrize("n", [255, 300])
def test_long_windows(spark, n):
    from glyphmill.llm.decontaminate import contamination

    words = [f"w{i}" for i in range(700)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200 : 200 + n - 1]))], DOCS)
    bench = spark.createDataFrame([(1, " ".join(words[100:450])), (2, " ".join(words[440:445]))], "item_id int, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(docs, bench, n=n).collect()}
    assert got == {1: (350, 2), 2: (5, 1)}
    with pytest.raises(ValueError, match="under 2"):
        contamination(docs, bench, n=2**31)


def test_contamination_passes_columns_of_any_name(spark):
    from glyphmill.llm.decontaminate import contamination

    clash = ["__k", "__k2", "__at", "__h", "__text", "at", "key", "item", "c0", "a.b"]
    docs = spark.createDataFrame(edge_docs(), DOCS).withColumns({c: F.lit(c) for c in clash})
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    got, want = contamination(docs, bench, keep=clash), contamination(docs, bench)
    assert got.columns[1:11] == clash and {tuple(r)[1:11] for r in got.collect()} == {tuple(clash)}
    assert Counter((r.doc_id, r.n_hit) for r in got.collect()) == Counter((r.doc_id, r.n_hit) for r in want.collect())


def test_large_benchmark_reaches_no_worker_whole(spark):
    """What workers hold is two filters of fixed size, however large the benchmark; with a filter that lets all pass the result is the same."""
    from glyphmill.llm import decontaminate as d
    from glyphmill.llm import runtime

    rng = random.Random(11)
    bench = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 20, 60])))) for i in range(400)]
    docs = [(i, bench[i][1] + " tail" if i % 3 else " ".join(f"w{rng.randrange(400)}" for _ in range(80))) for i in range(60)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id int, text string")
    want = brute_contamination(docs, bench)
    assert runtime.KeyFilter(b.select(F.col("item_id").cast("long").alias("k")), "k").shared.value.nbytes == 1 << 22
    keep = runtime._FILTER_BITS
    try:
        runtime._FILTER_BITS = 6
        got = Counter(tuple(r) for r in d.contamination(a, b).drop("item_ids").collect())
    finally:
        runtime._FILTER_BITS = keep
    assert got == want


# --- op2


def brute_repeats(rows, span):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone[s : s + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[(d, len(b), len(b) - len(kept), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def brute_kept(rows, span, min_words):
    """Texts without runs of repeated windows that hold min_words whole words; characters that lose bytes go."""
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = {}
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone |= set(range(s, s + span))
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for _, g in itertools.groupby(enumerate(sorted(gone)), key=lambda x: x[1] - x[0]):
            run = [x for _, x in g]
            if sum(run[0] <= x and y <= run[-1] + 1 for x, y in words) < min_words:
                gone -= set(run)
        out[d] = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize(("span", "gram", "cell"), [(40, 12, 8), (40, 40, 16), (7, None, 3)])
def test_repeats(spark, span, gram, cell):
    from glyphmill.llm.suffixes import remove_repeats

    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(300)) for _ in range(5)]
    rows = [(i, "".join(rng.choice([base[rng.randrange(5)][rng.randrange(200) :][: rng.randrange(1, 250)], "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(5)))) for i in range(100)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 200), (7, rows[7][1]), (None, rows[9][1]), (1005, "q" * 39), (1006, "q" * 40)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), span=span, gram=gram, cell=cell)
    assert Counter(tuple(r) for r in got.collect()) == brute_repeats(rows, span)


def test_repeats_of_many_words(spark):
    from glyphmill.llm.suffixes import drop_repeats

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    passage, line = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(40))
    own = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = [(0, f"{own[0]} {passage} {own[1]}"), (1, f"{own[2]} {passage}"), (2, f"{own[3]} {line}"), (3, f"{line} {own[1][::-1]}")]
    out = {r.doc_id: r.text for r in drop_repeats(spark.createDataFrame(rows, DOCS), span=101, min_words=51).collect()}
    # a match may go on by chance for a letter or two
    assert passage[9:-9] not in out[0] + out[1] and own[2][:-9] in out[1] and own[0][:-9] in out[0] and own[1][9:] in out[0]
    assert (out[2], out[3]) == (rows[2][1], rows[3][1])


def brute_passages(rows, span, min_words):
    """Per id, the runs of repeated windows that hold min_words whole words."""
    seen, out = Counter(), Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                gone |= set(range(s, s + span))
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        runs = [[x for _, x in g] for _, g in itertools.groupby(enumerate(sorted(gone)), key=lambda x: x[1] - x[0])]
        out[d, sum(sum(r[0] <= x and y <= r[-1] + 1 for x, y in words) >= min_words for r in runs)] += 1
    return out


def test_passages_are_counted_and_not_removed(spark, tmp_path):
    """Passages of over 50 words and under 400 bytes: n_passages tells them, the contract's columns stay."""
    from glyphmill.llm.queries import op2_suffix_dedup

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    many = lambda n: " ".join(word() for _ in range(n))
    short, fewer, long = many(55), many(45), many(120)
    assert 200 <= len(short) < 398 and 200 <= len(fewer) and len(long) >= 400
    rows = [(0, f"{many(60)} {short} {many(60)}"), (1, f"{short} {many(30)}"), (2, f"{many(30)} {fewer}"), (3, f"{fewer} {many(9)}"), (4, f"{many(9)} {long} {many(9)} {short}"), (5, f"{long} {many(80)}"), (6, many(300)), (7, None), (8, "")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_suffix_dedup(spark, str(tmp_path)).cache()
    assert Counter(tuple(r) for r in got.drop("n_passages").collect()) == brute_repeats(rows, 400)
    assert {r.doc_id: r.n_passages for r in got.collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 2, 5: 1, 6: 0, 7: 0, 8: 0}
    assert {r.doc_id for r in got.where("n_removed > 0").collect()} == {4, 5}


@pytest.mark.parametrize(("span", "passages"), [(40, (20, 3)), (40, (40, 2)), (7, (6, 1))])
def test_repeats_beside_passages(spark, span, passages):
    from glyphmill.llm.suffixes import remove_repeats

    rng = random.Random(6)
    base = ["".join(rng.choice("abé ") for _ in range(300)) for _ in range(5)]
    rows = [(i, "".join(rng.choice([base[rng.randrange(5)][rng.randrange(200) :][: rng.randrange(1, 90)], "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(5)))) for i in range(100)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "a b" * 99), (7, rows[7][1]), (None, rows[9][1]), (1005, "q" * 39), (1006, "q" * 40), (1007, "z" * 41)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), span=span, passages=passages).cache()
    assert Counter(tuple(r) for r in got.drop("n_passages").collect()) == brute_repeats(rows, span)
    assert Counter((r.doc_id, r.n_passages) for r in got.collect()) == brute_passages(rows, *passages)
    with pytest.raises(ValueError, match="longer"):
        remove_repeats(spark.createDataFrame(rows, DOCS), span=span, passages=(span + 1, 1))


def test_repeats_keep_columns(spark):
    from glyphmill.llm.suffixes import drop_repeats

    df = spark.createDataFrame([(1, "é" * 300, 5), (2, "é" * 300, 6), (3, None, 7), (4, "short", 8)], "doc_id int, text string, __k int")
    out = {r.doc_id: r for r in drop_repeats(df).collect()}
    assert (out[1].text, out[3].text, out[4].text, out[2]["__k"]) == ("", None, "short", 6)
    assert drop_repeats(df.limit(0)).count() == 0


# --- op3, op5


def test_stretches_give_the_tokenizers_ids():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from glyphmill.llm.tokens import token_batches

    rng = random.Random(1)
    alphabet = ["a", " ", "\n", "\u0085", "\u3000", "\u2003", "é", "e\u0301", "'s", "1", "!", "\t", "Σ", "ς", "中", "\r\n", "  ", "\x1c", "\u00a0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "a <|endoftext|> b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        got = [ids[first[i] : first[i + 1] - 1].tolist() for lo, hi, ids, first in token_batches(pa.record_batch([pa.array(texts)], names=["t"]), 0, path, 4000) for i in range(hi - lo)]
        assert got == want


@pytest.mark.parametrize("per", [50_000, 10])
def test_packing(spark, per):
    from tokenizers import Tokenizer

    from glyphmill.llm.packing import pack, packed_sequences, pieces_of
    from glyphmill.llm.runtime import cut

    path, docs = public_tokenizers.path("byte_bpe_50k.json"), [r for i, r in enumerate(edge_docs()) if r[0] != 7]
    df = spark.createDataFrame(docs, DOCS)
    plan = cut(pack(cut(pieces_of(df, path, length=64)), 64, per).withColumnRenamed("id", "doc_id"))
    rows, tok = plan.collect(), Tokenizer.from_file(path)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 64
    for d, t in docs:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4")))
            assert k == 0 or r.length == 64
            at += r.length
        assert at == len(ids)
    best = -(-sum(r.length for r in rows) // 64)
    assert len({r.sequence_id for r in rows}) <= best * 1.1 + (3 if per > 100 else 8)
    assert packed_sequences(df, plan, path).agg(F.sum(F.size("ids"))).first()[0] == sum(r.length for r in rows)


@pytest.mark.parametrize("sizes", [[600], [300, 700], [1, 2, 500], [340, 341, 345], [1024], list(range(1, 1025))])
def test_partitions_pack_nearly_as_well_as_one(spark, sizes):
    """Every bin may go up, so that the number of sequences hardly depends on partitions; also where no two items fit."""
    from glyphmill.llm.packing import best_fit, pack

    rng = random.Random(len(sizes))
    items = [(i, rng.choice(sizes)) for i in range(20000)]
    rows = pack(spark.createDataFrame(items, "id int, length long"), 1024, 2000).collect()
    assert sorted((r.id, r.length) for r in rows) == items
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own[:-1])] and own[-1].offset + own[-1].length <= 1024
    one = len(best_fit(np.array([n for _, n in items]), 1024)[2])
    assert len({r.sequence_id for r in rows}) <= one * 1.01 + 1, len({r.sequence_id for r in rows}) / one


def test_packing_of_repeated_rows(spark):
    from glyphmill.llm.packing import pack_documents

    rows = pack_documents(spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, "a b c"), (None, None)], DOCS), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4 and sum(r.doc_id is None for r in rows) == 2


def test_packing_of_nothing(spark):
    from glyphmill.llm.packing import pack_documents

    assert pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from glyphmill.llm.tokenfiles import read_token_files, token_digests, write_token_files

    path, docs, out = public_tokenizers.path("word_bpe_49k.json"), [r for r in edge_docs() if r[0] != 7], f"file://{tmp_path}/t"
    write_token_files(spark.createDataFrame(docs, DOCS), out, path)
    tok, at, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert sorted(tuple(r) for r in token_digests(read_token_files(spark, out)).collect()) == want
    assert read_token_files(spark, out, only=[3, 103]).count() == 2
    write_token_files(spark.createDataFrame([], DOCS), out, path)
    assert token_digests(read_token_files(spark, out)).count() == 0


# --- op4


def test_chat_round_trip():
    from glyphmill.llm.chat import format_turn, parse_turn

    rng = random.Random(2)
    bits = ["\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\n", "a", "<|end|>", "<|turn|>", "<|image:0|>", "é"]
    for _ in range(2000):
        role, text = ("".join(rng.choice(bits) for _ in range(rng.randrange(6))) for _ in range(2))
        formatted, _, _ = format_turn(role, [{"type": "text", "text": text}])
        assert parse_turn(formatted) == (role, text)
        assert formatted.count("<|turn|>") == 1 == formatted.count("<|end|>") and "[INST]" not in formatted and "</s>" not in formatted


def test_chat_parts(spark):
    from glyphmill.llm.chat import format_chat

    parts = '[{"type":"text","text":"see"},{"type":"image","ref":"i.png","width":56,"height":30},{"type":"audio","ref":"a.wav","seconds":2},{"type":"document","ref":"d.pdf","pages":3},{"type":"text","text":"ok"}]'
    r = format_chat(spark.createDataFrame([(1, 0, "assistant", None, parts), (1, 1, None, None, None)], "conv_id int, turn int, role string, text string, parts string"), parts_col="parts").orderBy("turn").collect()
    assert r[0].formatted == "<|turn|>assistant\nsee<|image:0|><|audio:1|><|document:2|>ok<|end|>\n"
    assert [r[0].formatted[s.start : s.end] for s in r[0].loss] == ["see", "ok"]
    assert [(a.type, a.ref, a.tokens, r[0].formatted[a.at : a.at + 2]) for a in r[0].attachments] == [("image", "i.png", 4, "<|"), ("audio", "a.wav", 50, "<|"), ("document", "d.pdf", 2304, "<|")]
    assert r[1].formatted == "<|turn|>\n<|end|>\n" and r[1].loss == []


def test_chat_parts_that_are_none(spark):
    from glyphmill.llm.chat import conversation_digests, format_chat, parse_turn

    odd = ['{"text":"one"}', '"s"', "not json", "[1, null, [2]]", '[{"type":"video","ref":7}]', '[{"type":"image","width":"wide","height":-3}]', '[{"type":"audio","seconds":1e400}]', '[{"type":"text","text":0}]', '[{"type":"visit"},{"type":["x"]}]', "[]", "", "[" * 100000, '["\\ud800"]']
    df = spark.createDataFrame([(None if i == 0 else 1, i, "assistant", "t", p) for i, p in enumerate(odd)], "conv_id int, turn int, role string, text string, parts string")
    r = format_chat(df, parts_col="parts").orderBy("turn").collect()
    assert [parse_turn(x.formatted)[1] for x in r] == ["one", "s", "not json", "", "", "", "", "0", "", "", "", "[" * 100000, "?"]
    assert [[(a.type, a.ref, a.tokens) for a in x.attachments] for x in r[3:7]] == [[("unknown", None, 1)] * 3, [("unknown", "7", 1)], [("image", None, 1)], [("audio", None, 1)]]
    twice = df.unionByName(df)
    assert {x.conv_id: x.n_turns for x in conversation_digests(format_chat(twice, parts_col="parts")).collect()} == {None: 2, 1: 2 * len(odd) - 2}
    assert conversation_digests(format_chat(df.limit(0))).count() == 0


# --- op6


def test_viterbi_is_exact():
    from glyphmill.llm.langid import viterbi

    rng = np.random.default_rng(1)
    for _ in range(50):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 6))])
        s = rng.normal(0, 2, (first[-1], 3)).astype(np.float32)
        for lane in (4, 2048):
            got = viterbi(s, first, 3.0, lane)
            for a, b in itertools.pairwise(first):
                if b > a:
                    best = s[a]
                    for t in range(a + 1, b):
                        best = np.maximum(best, best.max() - 3) + s[t]
                    own = got[a:b]
                    assert abs(s[np.arange(a, b), own].sum() - 3 * (own[1:] != own[:-1]).sum() - best.max()) < 1e-3


def test_viterbi_of_many_languages():
    from glyphmill.llm.langid import viterbi

    s = np.full((40, 300), -5, np.float32)
    s[np.arange(40), [299] * 20 + [130] * 20] = 5
    for lane in (7, 2048):
        assert viterbi(s, np.array([0, 40]), 3.0, lane).tolist() == [299] * 20 + [130] * 20


def test_language_id(spark):
    from glyphmill.llm.langid import identify, learn

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn(docs)
    held = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    n, ok = held.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert ok / n > 0.98
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 - !"), (4, "der die und nicht einen von schen " * 3 + "les des queeux une est eau " * 3)], DOCS)
    got = {r.doc_id: r for r in identify(edge, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and {s.lang for s in got[4].spans} == {"de", "fr"}
    assert identify(edge, learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


# --- op7


def test_urls(spark):
    from glyphmill.llm.urlfilter import filter_urls

    rng = random.Random(4)
    labels = ["com", "example", "www", "a-b", "0", "a", "", "net"]
    rules = [(".".join(rng.choices(labels[:6], k=rng.randrange(1, 4))), rng.choice(["", "/", "/en/", "/en/7"]), rng.choice(["allow", "block"])) for _ in range(12)]
    urls = [None, "no scheme", "://", "http://", "HTTP://WWW.Example.COM/En/?q#f", "a://b://c/d", "http://example.com\n/en/"]
    urls += [f"http://{'.'.join(rng.choices(labels, k=rng.randrange(1, 5)))}{rng.choice(['', '/', '/en/7', '/en/x?y', '#z'])}" for _ in range(400)]

    def judge(u):
        i = -1 if u is None else u.find("://")
        rest = u[i + 3 :] if i >= 0 else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fit = [(len(h + p), v == "block", h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2] + best[3], best[4] if best else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


# --- op8


@pytest.mark.parametrize("tile", [1024, 4])
def test_embeddings(spark, tile):
    from glyphmill.llm.embeddings import embedding_dedup

    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        v = rng.normal(size=6) if i < 20 or rng.random() < 0.2 else np.array(rows[rng.integers(0, 20)][1]) * rng.uniform(0.5, 2) + rng.normal(size=6) * 0.15
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 6, 1), (203, [float("nan")] * 6, 1), (204, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (205, rows[0][1], None), (206, rows[0][1], rows[0][2]), (207, [float("inf")] * 6, 0), (208, [1e-200] * 6, 0), (209, [1e200] * 6, 0), (210, [1.0, 2.0], 0), (211, [1.0, 2.0], 0)]
    good = [(i, np.array(v), c) for i, v, c in rows if c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near, parent = Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a, c), (j, b, d) in itertools.combinations(good, 2):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        if c == d and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
            near[i] += 1
            near[j] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").repartition(3), tile=tile).collect()
    assert {tuple(r) for r in got} == {(i, near[i], root(i), root(i) == i) for i, _, _ in rows}
    assert embedding_dedup(spark.createDataFrame([], "vec_id int, embedding array<double>, label int")).count() == 0


# --- op9


def brute_simhash(docs):
    """id -> (fingerprint, smallest id reachable)."""
    prints = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (prints[d], root(d)) for d in prints}


@pytest.mark.parametrize("shard", [4096, 5])
def test_simhash(spark, shard):
    from glyphmill.llm.simhash import keep_representatives, simhash_dedup

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefg ") for _ in range(900)) for _ in range(8)]
    docs = edge_docs()
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        docs.append((1000 + i, "".join(t)))
    want = brute_simhash(docs)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(df, shard=shard).collect())
    assert got == Counter((d, f"{want[d][0]:016x}", want[d][1]) for d, _ in docs)
    assert {r.doc_id for r in keep_representatives(df).collect()} == {d for d in want if want[d][1] == d}
    assert simhash_dedup(df.limit(0)).count() == 0


def test_components(spark):
    from glyphmill.llm.runtime import components

    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


# --- op10


def test_toxicity(spark):
    from glyphmill.llm.toxicity import drop_toxic, fit, score_toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    held = score_toxicity(docs, model).join(labels, "doc_id").where("held_out")
    hit, n, wrong, m = held.agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)), F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)), F.count_if(F.col("toxic") == 0)).first()
    assert hit / n > 0.7 and wrong / m < 0.01
    edge = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "you pathetic w0rthless worthles idiots, " * 3)], DOCS).withColumn("score", F.lit(9))
    got = score_toxicity(edge, model).orderBy("doc_id").collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1] and all(0 <= r.score <= 1 for r in got)
    kept = drop_toxic(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == 4  # no model, nothing is rejected


def test_subwords_are_grams_of_words():
    from glyphmill.llm import toxicity as t

    def one(text):
        """Buckets of the 3- to 8-grams inside words with their boundaries, gram by gram."""
        b, out = b" " + text.encode() + b" ", set()
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in b)
        for k in t.SIZES:
            for i in range(len(b) - k + 1):
                if all(t._LETTER[x] for x in low[i + 1 : i + k - 1]):
                    h = 0
                    for x in low[i : i + k]:
                        h = (h * int(t._STEP) + int(t._CODE[x])) & 0xFFFFFFFF
                    h = (h ^ (h >> 15)) * (int(t._LAST) + 2 * k) & 0xFFFFFFFF
                    out.add(h >> (32 - t.BITS))
        return out

    rng = random.Random(4)
    texts = ["".join(rng.choice("abC é1,") for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "idiot", "IDIOT!"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(x.encode()) for x in texts)])
    rows, buckets = t.subwords(buf, off)
    assert [set(buckets[rows == i].tolist()) for i in range(len(texts))] == [one(x) for x in texts]


def test_scores_and_training_against_plain_sums():
    from glyphmill.llm import toxicity as t

    rng = np.random.default_rng(2)
    n, width = 40, 1 << t.BITS
    weight = rng.uniform(0, 1, width).astype(np.float32)
    grams = [np.unique(rng.integers(0, 50, 12)) + (0 if i % 2 else 60) for i in range(n)]
    label = np.arange(n) % 2 == 0
    model = t.train([np.frombuffer(t.pack(g), np.uint8) for g in grams], label.astype(int), weight, np.zeros(width), 0.25)
    logit = [model.intercept + sum(model.pull[g]) / sum(weight[g]) for g in grams]
    assert all((x > 0.25) == y for x, y in zip(logit, label, strict=True))  # the two sets of buckets are told apart
    text = np.frombuffer("plain words, twice words".encode(), np.uint8)
    own = t.subwords(text, np.array([0, len(text)]))[1]
    want = 1 / (1 + math.exp(-(model.intercept + float(model.pull[own].sum()) / float(weight[own].sum()))))
    assert abs(model.score(text, np.array([0, len(text)]))[0] - want) < 1e-5
    assert abs(model.score(text[:0], np.array([0, 0]))[0] - 1 / (1 + math.exp(-model.intercept))) < 1e-9


def test_toxicity_of_odd_labels(spark):
    from glyphmill.llm.toxicity import fit, score_toxicity

    docs = spark.createDataFrame([(i, "nice words here" if i % 2 else "vile words here") for i in range(40)], DOCS)
    labels = spark.createDataFrame([*((i, 1 - i % 2) for i in range(40)), (3, None), (None, 1), (5, 0), (5, 0)], "doc_id int, toxic int")
    assert fit(docs, labels) is not None and fit(docs.limit(0), labels) is None
    assert score_toxicity(docs.limit(0), None).count() == 0
    with pytest.raises(ValueError, match="score"):
        score_toxicity(docs.withColumn("score", F.lit(1)), None, keep=["score"])


def test_toxicity_counts_all_rows(spark, monkeypatch):
    from glyphmill.llm import toxicity as t

    steps = [np.array(x, np.int64) for x in ([], [0], [254, 255, 256, 1021], [5, (1 << t.BITS) - 1])]
    assert all((t.unpack(np.frombuffer(t.pack(x), np.uint8)) == x).all() for x in steps)
    monkeypatch.setattr(t, "MAX_TOXIC", 8)
    monkeypatch.setattr(t, "MAX_OTHER", 8)
    rows = [(i, f"some plain text about rivers {'zorbquix' if i % 4 == 0 else 'and hills'}", int(i % 2 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = t.fit(docs.drop("toxic"), docs.drop("text"))
    assert (model.weight > 0).all()  # no bucket is left out
    text = np.frombuffer(b"zorbquix", np.uint8)
    own = t.subwords(text, np.array([0, len(text)]))[1]
    assert np.median(model.weight[own]) > 1  # z is about 3.9 over all rows, 1.9 over the 16 sampled


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert set(ids) <= before and len(ids) == len(set(ids)), name
        if name == "repeated_strings":
            kept = brute_kept([(r.doc_id, r.text) for r in docs.collect()], 200, 51)
            assert {r.doc_id: r.text for r in rows} == kept
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            assert set(ids) == {d for d, c in brute_simhash([(r.doc_id, r.text) for r in docs.collect()]).items() if d == c[1]}
        if name == "benchmark_passages":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert set(ids) == {k[0] for k in brute_contamination([(r.doc_id, r.text) for r in docs.collect()], bench) if not k[5]}
        docs, before = spark.createDataFrame(rows, docs.schema), set(ids)
    assert {r.doc_id for r in p.packing(spark, docs, SMALL).collect()} == before
    assert p.run(spark, SMALL).select("doc_id").distinct().count() == len(before)
