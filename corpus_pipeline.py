"""The corpus pipeline: from documents to token digests in five stages, each written and read again.

Every stage works on all rows that the one before it kept, takes the columns of documents (all of them have to be there, others are
dropped) and, but for the last, returns them. A null text counts as empty, except for language identification, which rejects it. Rows
with a null id pass deduplication as they are.
"""

from __future__ import annotations

import public_tokenizers
from acquira.llm import bpe, langid, mixing, ngram_join, suffix
from acquira.llm.shared import Scratch, materialize
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others keep their language, or get the predicted one if it is null."""
    found = langid.identify(docs.select(*COLUMNS), train=langid.fold(F.col("doc_id"), 4) != 2)
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links join, the one with the smallest id stays; of its rows, one of each text, the least by its columns."""
    found = ngram_join.jaccard_components(docs)
    stay = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    named = docs.select(*COLUMNS).join(stay, "doc_id")
    rest = ["lang", "source", "n_chars"]
    several = named.where("rows > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "text", "r.*")
    return named.where("rows = 1").select(*COLUMNS).unionByName(several).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes leave the texts; a character that is cut in two goes with them."""
    out = suffix.remove_repeats(docs, length=100, carry=["text", "lang", "source", "n_chars"])
    out = out.withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document."""
    out = mixing.draw(mixing.mix(docs, carry=["text", "lang", "n_chars"], scratch=Scratch(spark)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each row's tokens and of their decoding."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the learned model nor the tokenizer; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
