"""The queries of these operators over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acquira.llm import ann, bpe, exact_dedup, fim, langid, lm, mixing, ngram_join, quality, suffix, token_counts, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = langid.fold(F.col("doc_id"), 10)
    out = lm.score(table(spark, sf_dir, "documents"), train=fold != 0, tune=fold == 1)
    return out.withColumn("held_out", ~F.col("trained")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 50 == 0, k=5)


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.withColumn("held_out", langid.fold(F.col("doc_id"), 4) == 2), train=~F.col("held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.rearrange(table(spark, sf_dir, "documents"), unit="line", rate=100, spm=50, seed=7)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_components": op2_jaccard_components,
    "op3_interpolated_lm": op3_interpolated_lm,
    "op4_line_quality": op4_line_quality,
    "op5_warc_index": op5_warc_index,
    "op6_nearest": op6_nearest,
    "op7_repeated_strings": op7_repeated_strings,
    "op8_source_mix": op8_source_mix,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_content_sort": op11_content_sort,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op2_jaccard_components": ngram_join.oracle(),
    "op5_warc_index": warc.oracle(),
    "op4_line_quality": quality.oracle(),
    "op8_source_mix": mixing.oracle(),
    "op11_content_sort": exact_dedup.oracle(),
    "op12_fill_in_middle": fim.oracle(),
}
