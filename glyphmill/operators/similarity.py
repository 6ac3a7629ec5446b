"""Pairs of similar texts, as a set-similarity join.

Similarity is the standard library's sequence ratio of lower-cased texts: twice the matched characters over the sum of lengths.
Matched characters are a common subsequence, so the ratio bounds how many q-grams two texts must share, and that bounds how many of
a text's rarest q-grams must hold one of a partner's (a prefix filter). Only texts that share such a gram meet, with lengths and
positions that can still reach the bound; what meets is compared exactly. Nothing is lost.

Equal texts are one text: pairs are of different texts, and copies are members of theirs.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir

#: Weights of names and definitions in the combined score, fixed values, and the score from which two tags may be one.
NAME_WEIGHT, DEFINITION_WEIGHT, COMBINED = 0.4, 0.6, 0.6


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratio_of(a: Column, b: Column) -> Column:
    """Ratio of each pair; equal texts, often met, aren't compared."""

    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(kernel, "double")(a, b)


def char_bound(a: Column, b: Column) -> Column:
    """The ratio's bound by the characters that two texts share, repeats included."""

    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        counts = {t: Counter(t) for t in {*a, *b}}
        return pd.Series([2 * (counts[x] & counts[y]).total() / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(kernel, "double")(a, b)


def least_shared(q: int, cutoff: float, total: Column | int):
    """How many q-grams two texts of `total` characters must share to reach the cutoff.

    With L common characters one text loses la - L of its own, each of at most q grams, and takes lb - L others, each of which
    breaks at most q - 1 grams.
    """
    return (2 * q - 1) * cutoff * total / 2 - (q - 1) * total - (q - 1) - 1e-9


def longest_short(q: int, cutoff: float) -> int:
    """Length up to which a text may share no q-gram with a similar one."""
    slope = (2 * q - 1) * cutoff / 2 - (q - 1)
    return 0 if q == 1 else math.floor(q / slope / (1 + cutoff / (2 - cutoff)) + 1e-9)


def _grams(texts: DataFrame, q: int, cutoff: float, keys: list[str]) -> DataFrame:
    """Prefix rows: keys, id, len, gram, nth (its occurrence in the text), at (place by rarity), n (grams of the text)."""
    starts = F.explode(F.sequence(F.lit(1), F.col("len") - (q - 1)))
    each = texts.where(F.col("len") >= q).select(*keys, "id", "len", "text", starts.alias("i")).select(*keys, "id", "len", F.substring("text", F.col("i"), F.lit(q)).alias("gram"))
    each = each.groupBy(*keys, "id", "len", "gram").agg(F.count("*").cast("int").alias("c")).withColumn("nth", F.explode(F.sequence(F.lit(1), "c"))).drop("c")
    seen = each.groupBy("gram", "nth").agg(F.count("*").alias("freq"))
    ranked = each.join(seen, ["gram", "nth"]).withColumn("at", F.row_number().over(W.partitionBy(*keys, "id").orderBy("freq", "gram", "nth"))).drop("freq")
    n = F.col("len") - (q - 1)
    shortest = F.ceil(F.col("len") * (cutoff / (2 - cutoff)) - 1e-9)
    need = F.greatest(F.lit(1), F.ceil(least_shared(q, cutoff, F.col("len") + shortest)))
    return ranked.withColumn("n", n).where(F.col("at") <= F.col("n") - need + 1)


def _meeting(texts: DataFrame, q: int, cutoff: float, keys: list[str]) -> DataFrame:
    """(keys, a, b) of the texts whose rarest q-grams meet where lengths and places allow the cutoff; a < b."""
    p = _grams(texts, q, cutoff, keys)
    o = p.select(*keys, "gram", "nth", *(F.col(c).alias(f"{c}2") for c in ("id", "len", "at", "n")))
    total = F.col("len") + F.col("len2")
    near = 2 * F.least("len", "len2") >= cutoff * total - 1e-9
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1  # this gram and all that are less rare
    first = F.least(F.col("at"), F.col("at2")) - 1  # rarer ones, which may be shared too
    reach = left + first >= F.greatest(F.lit(1), F.ceil(least_shared(q, cutoff, total)))
    return p.join(o, [*keys, "gram", "nth"]).where((F.col("id") < F.col("id2")) & near & reach).select(*keys, F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def candidates(texts: DataFrame, cutoff: float, keys: list[str]) -> DataFrame:
    """texts: keys, id, text, unique in (keys, id). (keys, a, b): every pair whose ratio may reach the cutoff, a < b.

    Pairs of q-grams where the cutoff lets them bind (over 2/3), else of characters; short texts, which q-grams don't bind,
    by characters.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be over 0 and at most 1")
    t = texts.withColumn("len", F.length("text")).where("len > 0")
    q = 2 if cutoff > 0.7 else 1
    short = longest_short(q, cutoff)
    found = _meeting(t.where(F.col("len") > short), q, cutoff, keys)
    if short:
        found = found.unionByName(_meeting(t.where(F.col("len") <= math.floor(short * (2 - cutoff) / cutoff + 1e-9)), 1, cutoff, keys))
    return found.distinct()


def _rows(df: DataFrame, id_col: str, block: list[str], texts: dict[str, str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Rows as id, lower-cased texts, a block key that nulls have too, and the block's values; the key's and the values' names."""
    keys, held = [f"k{i}" for i in range(len(block))], [f"v{i}" for i in range(len(block))]
    cols = [F.col(f"`{id_col}`").alias("id"), *(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(n) for n, c in texts.items())]
    for c, k, v in zip(block, keys, held, strict=True):
        cols += [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias(k), F.col(f"`{c}`").alias(v)]
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(*cols).distinct()
    return rows, keys, [F.col(v).alias(c) for c, v in zip(block, held, strict=True)]


def similar_texts(df: DataFrame, id_col: str, text_col: str, block: list[str] | None = None, cutoff: float = 0.85, longer_than: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts of each block.

    members: block, text_id (the smallest id of the block's rows with this text), id_col; texts of at most `longer_than`
    characters (null is empty) and null ids have no part, repeated rows are a member once. pairs: block, a, b (text_ids of different
    texts, a < b), score (ratio of a's text to b's, which needn't be that of b's to a's). Null blocks are a block.
    """
    checkpoint_dir(df.sparkSession)
    rows, keys, values = _rows(df, id_col, block or [], {"text": text_col})
    rows = rows.where(F.length("text") > longer_than)
    texts = rows.groupBy(*keys, "text").agg(F.min("id").alias("id")).checkpoint()
    met = candidates(texts, cutoff, keys)
    j = met.join(texts.select(*keys, F.col("id").alias("a"), F.col("text").alias("ta")), [*keys, "a"]).join(texts.select(*keys, F.col("id").alias("b"), F.col("text").alias("tb")), [*keys, "b"])
    scored = j.where(char_bound("ta", "tb") >= cutoff - 1e-9).withColumn("score", _ratio_of("ta", "tb")).where(F.col("score") >= cutoff)
    blocks = rows.select(*keys, *(f"v{i}" for i in range(len(keys)))).distinct()
    pairs = (scored.join(blocks, keys) if keys else scored).select(*values, "a", "b", "score")
    members = rows.join(texts.withColumnRenamed("id", "text_id"), [*keys, "text"])
    return pairs, members.select(*values, "text_id", F.col("id").alias(id_col))


def consolidation(tags: DataFrame, id_col: str = "tag_id", name_col: str = "canonical_name", definition_col: str = "definition", block: list[str] | None = None, cutoff: float = COMBINED) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of tags of a block that may be one, by names and definitions together.

    members: block, tag (the smallest id of the block's rows of this name and definition), id_col. pairs: block, a, b (such
    tags, a < b), name_score, definition_score (0 where either is empty), score (weighted). Two empty names are alike. A pair
    reaches the cutoff only if its names or its definitions do by themselves, so both kinds of candidates are searched.
    """
    checkpoint_dir(tags.sparkSession)
    block = list(block or [])
    rows, keys, values = _rows(tags, id_col, block, {"name": name_col, "definition": definition_col})
    classes = rows.groupBy(*keys, "name", "definition").agg(F.min("id").alias("tag")).checkpoint()
    met = None
    for c in ("name", "definition"):
        texts = classes.groupBy(*keys, F.col(c).alias("text")).agg(F.min("tag").alias("id")).checkpoint()
        alike = candidates(texts, cutoff, keys)
        same = texts if c == "name" else texts.where("text <> ''")
        alike = alike.unionByName(same.select(*keys, F.col("id").alias("a"), F.col("id").alias("b")))
        of = classes.join(texts.withColumnRenamed("text", c).withColumnRenamed("id", "of"), [*keys, c]).select(*keys, "of", "tag")
        one = of.select(*keys, F.col("of").alias("a"), F.col("tag").alias("x"))
        two = of.select(*keys, F.col("of").alias("b"), F.col("tag").alias("y"))
        both = alike.join(one, [*keys, "a"]).join(two, [*keys, "b"]).where("x <> y").select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        met = both if met is None else met.unionByName(both)
    side = lambda t: classes.select(*keys, F.col("tag").alias(t), F.col("name").alias(f"n{t}"), F.col("definition").alias(f"d{t}"))
    j = met.distinct().join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    some = (F.col("da") != "") & (F.col("db") != "")
    score = lambda n, d: NAME_WEIGHT * n + DEFINITION_WEIGHT * F.when(some, d).otherwise(0.0)
    near = j.where(score(char_bound("na", "nb"), char_bound("da", "db")) >= cutoff - 1e-9)
    scored = near.withColumn("name_score", _ratio_of("na", "nb")).withColumn("definition_score", F.when(some, _ratio_of("da", "db")).otherwise(0.0))
    scored = scored.withColumn("score", score(F.col("name_score"), F.col("definition_score"))).where(F.col("score") >= cutoff)
    blocks = rows.select(*keys, *(f"v{i}" for i in range(len(keys)))).distinct()
    pairs = (scored.join(blocks, keys) if keys else scored).select(*values, "a", "b", "name_score", "definition_score", "score")
    return pairs, rows.join(classes, [*keys, "name", "definition"]).select(*values, "tag", F.col("id").alias(id_col))
