"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, cover_tree_dedup, decision_list, edit_counts, license_scan, lsh_forest, open_window_packing, oracles, suffix_dedup, weak_toxicity, word_bpe
from .runtime import table


#: Of op7's three edits: each brings up to 24 characters and touches its neighbours.
FEW = 64


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_cover_tree_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op2_dice_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "dice", "n_matches")


def op3_lsh_forest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = byte_cnn.fit(docs.where(_fold(3) != 1))
    return byte_cnn.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels").where(_fold(5) != 0))
    return weak_toxicity.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_open_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_window_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after edits that follow from each text, by trees kept as records; few_reencoded: whether the edits had at most FEW pre-tokens encoded again."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    trees = edit_counts.plant(docs, path).withColumn("edits", edit_counts.sample_edits())
    return edit_counts.edit(trees, path).select("doc_id", "n_tokens", "n_pretokens", "n_tokens_after", (F.col("n_reencoded") <= FEW).alias("few_reencoded"))


def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.annotate(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_embeddings": oracles.OP1,
        "op2_dice_licenses": license_scan.oracle(),
        "op3_lsh_forest_documents": oracles.OP3,
        "op7_edit_aware_counts": oracles.op7(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "op8_distinct_word_bpe": oracles.op8(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        "op10_suffix_array_dedup": oracles.OP10,
    }
