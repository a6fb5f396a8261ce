"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, negatives, spans, winnow
from .common import read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    views = chat.rotate(read(spark, sf_dir, "conversations"))
    return views.select("conv_id", "participant", "part", "start", "n_messages", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.array_join(spans, ",").alias("mask"))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import judge

    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars", "longest_repeat")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spans import dedup_spans

    found = dedup_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(texts, _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import PASSAGE, dedup_suffixes

    found = dedup_suffixes(read(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


def op7_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan

    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align

    return align(read(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.sha2(F.array_join("items", ","), 256)).withColumnRenamed("items", "items_sha256")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_perspective_rotation, op3_suffix_repetition, op4_sentence_spans, op5_byte_bpe, op6_suffix_arrays, op7_token_group_join, op8_projection_forest, op9_license_scan, op10_quality_classifier, op11_token_alignment, op12_hard_negatives, op13_winnowing)}
SQL: dict[str, str] = {"op2_perspective_rotation": chat.SQL, "op4_sentence_spans": spans.SQL, "op12_hard_negatives": negatives.SQL, "op13_winnowing": winnow.SQL}
