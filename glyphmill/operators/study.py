"""Blinded panels, their scoring, and building of datasets."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..runtime import numbered


def panel(human: DataFrame, model: DataFrame, seed: int = 42, cap: int | None = None) -> DataFrame:
    """human, model: image_id, attribute_key, label. Trials of differing labels in a seeded order, the model's side by a hash.

    trial_id is the place before equal labels are left out, so ids have gaps.
    """
    keys = ["image_id", "attribute_key"]
    j = human.select(*keys, F.col("label").alias("h")).join(model.select(*keys, F.col("label").alias("m")), keys)
    order = F.xxhash64(*keys, F.lit(seed))
    j = numbered(j.withColumn("__o", order), ["__o", *keys], "trial_id").drop("__o")
    if cap:
        j = j.where(F.col("trial_id") <= cap)
    a = F.xxhash64(*keys, F.lit(seed + 1)) % 2 == 0
    return j.where("h <> m").select("trial_id", *keys, F.when(a, F.col("m")).otherwise(F.col("h")).alias("label_A"), F.when(a, F.col("h")).otherwise(F.col("m")).alias("label_B"), F.when(a, "A").otherwise("B").alias("which_is_model"))


def panel_score(judged: DataFrame, keys: list[str]) -> DataFrame:
    """judged: which_is_model, guess, rating_A, rating_B. Accuracy over all rows, blank guesses too; mean ratings of either side."""
    own, other = (F.when(F.col("which_is_model") == k, F.col("rating_A").try_cast("double")).otherwise(F.col("rating_B").try_cast("double")) for k in ("A", "B"))
    right = F.upper(F.trim("guess")) == F.col("which_is_model")
    return judged.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), (F.count_if(right) / F.count("*")).alias("accuracy"), F.avg(own).alias("mean_rating_model"), F.avg(other).alias("mean_rating_human"))


def replace_nodes(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    return base.join(extra.select(key).distinct(), key, "left_anti").unionByName(extra)


def prior_sums(priors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(node, parents) whose probabilities don't add up to 1; a null parent is a group too."""
    return priors.groupBy("node", "parents").agg(F.sum("p").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def node_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are there, binned into three states; others are skipped."""
    return df.withColumns({f"{c}_bin": S.node_bin(F.col(c).cast("string")) for c in columns if c in df.columns})


def drop_similar_titles(rows: DataFrame, group: str, title: str, order: str, cutoff: float = 0.8, cap: int = 30) -> DataFrame:
    """Greedy within a group, in order: a row stays if its title, digits out, is no closer than the cutoff to one that stayed; at most cap."""

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        kept, names = [], []
        for i, t in p.sort_values(order)[title].str.replace(r"\d+", "", regex=True).str.strip().items():
            if len(kept) == cap:
                break
            if not any(SequenceMatcher(None, t, n).ratio() > cutoff for n in names):
                kept.append(i)
                names.append(t)
        return p.loc[kept]

    return rows.groupBy(group).applyInPandas(pick, rows.schema)


def quality_filter(rows: DataFrame, width: int, height: int, banned: list[str], text: list[str]) -> DataFrame:
    """Rows of a minimum size whose texts hold no banned term."""
    words = F.lower(F.concat_ws(" ", *text))
    return rows.where((F.col("width") >= width) & (F.col("height") >= height) & ~words.rlike("|".join(banned) if banned else "$^"))
