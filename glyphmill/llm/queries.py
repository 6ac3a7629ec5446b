"""The thin queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import conversation_digests, format_chat
from .decontaminate import contamination
from .embeddings import embedding_dedup
from .hardnegatives import hard_negatives
from .htmlextract import main_text
from .langid import FOLD, FOLDS, identify, learn
from .packing import pack_documents
from .runtime import remove, shared_path
from .simhash import simhash_dedup
from .suffixes import remove_repeats
from .tokenfiles import read_token_files, token_digests, write_token_files
from .toxicity import fit, score_toxicity
from .urlfilter import filter_urls
from .vectorcodes import vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Bytes and words of op2's passages; 51 words rarely hold fewer bytes.
PASSAGES = (200, 51)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passages: repeated passages of over 50 words, which are counted but not removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), passages=PASSAGES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Fixed by the contract of op4.
PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id int, turn int, role string, text string")
    probe = probe.select(*(probe[c].cast(rows.schema[c].dataType) for c in rows.columns))
    return conversation_digests(format_chat(rows.union(probe)))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = token_digests(read_token_files(spark, path))
    remove(spark, path)  # the digests are checkpointed
    return found


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Fixed by the contract of op7: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))



def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


#: Fixed by the contract of op13: anchors, and rows whose label becomes the next of LABELS.
ANCHORS, MOVED, LABELS = 50, 7, 10


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % ANCHORS == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_packing, op4_chat_format, op5_token_files, op6_language_id, op7_url_filter, op8_embedding_dedup, op9_simhash, op10_toxicity, op11_html_text, op12_vector_codes, op13_hard_negatives)}
