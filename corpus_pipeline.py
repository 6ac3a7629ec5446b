"""The corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
applies them to documents, writing each stage's rows to the shared folder and reading them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.decontaminate import decontaminate
from glyphmill.llm.packing import pack_documents
from glyphmill.llm.runtime import cut
from glyphmill.llm.simhash import keep_representatives
from glyphmill.llm.suffixes import drop_repeats
from glyphmill.llm.toxicity import drop_toxic


REPEAT_SPAN, REPEAT_WORDS = 200, 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one of the smallest id."""
    return keep_representatives(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that are made of strings of REPEAT_SPAN bytes which also start elsewhere; n_chars, where it's a column, follows the text.

    51 words rarely hold fewer than REPEAT_SPAN bytes: on sf0.1 this removes 99.1 % of the words of passages of over 50 words that
    documents share; 400 bytes, the span of op2, removes 69.5 %.
    """
    out = drop_repeats(docs, span=REPEAT_SPAN, min_words=REPEAT_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: The stages' models, tokenizer and hashes have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
