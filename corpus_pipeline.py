"""The corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage works on all that the stage before it kept, as written and read back; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import byte_cnn, lsh_forest, open_window_packing, suffix_dedup, weak_toxicity
from sightline.llm.runtime import cut, cuts, forget, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose language is less sure than this go; the network gives two languages or noise less.
LEAST_SCORE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't call toxic. It learns from the labelled documents of this stage's input."""
    known = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = weak_toxicity.fit(docs, known)
    return weak_toxicity.predict(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language: not those without a letter, nor those that the network is unsure of."""
    model = byte_cnn.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    if model is None:
        return docs.select(COLUMNS)
    return byte_cnn.predict(docs.select(COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near-duplicates (five words, similarity 0.8).

    Rows are judged each, also those that share a doc_id or have none: a row is known by doc_id and text, and rows that are equal in both are one. A row with a doc_id is kept before one without."""
    own = (F.col("doc_id"), F.col("text"))
    keyed = docs.select(COLUMNS).withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), *own)).withColumn("__digest", F.xxhash64(F.lit("row"), F.col("doc_id").isNull(), *own))
    with cuts() as made:
        groups = lsh_forest.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
        groups = cut(groups.select(F.col("doc_id").alias("__key"), "component_id").distinct())
        one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("one")
        kept = made.keep(cut(keyed.select("__key", "doc_id").join(groups, "__key").groupBy("component_id").agg(one).select("one.__key")))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key", "__digest"]).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every repeated passage of over 50 words, and every repeated 400-byte string, out of the texts; n_chars follows. A text of which nothing is left stays, empty, as a document."""
    return suffix_dedup.deduplicate(docs.select(COLUMNS), (suffix_dedup.BYTES, suffix_dedup.PASSAGES)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row for each piece."""
    return open_window_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Trained models, tokenizers and suffix sorting have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = cut(stage(spark, docs, sf_dir))
        forget(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
