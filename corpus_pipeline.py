"""From raw documents to batches: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import kindred
from kindred.llm import overlap, packing, subword, suffix
from kindred.llm.common import checkpoint_folder, deleted, table


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, so that no name of the caller's meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score of 0.3 or more).

    Null and empty texts have the score of a text without words, rows that repeat have equal scores; other columns stay.
    """
    kindred.ship(spark)
    scored = subword.toxicity.learned(_held(docs), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") < 0.3).select("held_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go (score below 0.5).

    Null and empty texts have the score of a text without words, rows that repeat have equal scores; other columns stay.
    """
    kindred.ship(spark)
    scored = subword.quality.learned(_held(docs), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= 0.5).select("held_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles the document with the least id stays.

    SimHash finds the links within its radius, an exact join the others. Of rows with equal ids and texts one stays; null
    ids are the greatest. All texts without words are one group. Different texts under one id are different documents.
    """
    kindred.ship(spark)
    keys = {"key_a": F.xxhash64("doc_id", "text"), "key_b": F.xxhash64(F.lit(1), "text", "doc_id")}
    groups = overlap.near_duplicates(docs.select(keys["key_a"].alias("key_a"), "text"), "key_a")
    ids = docs.select("doc_id", keys["key_a"].alias("key_a"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key_a"))
    heads = groups.distinct().join(ids.distinct(), "key_a").groupBy("component_id").agg(first.alias("head")).select(F.col("head.key_a").alias("key_a"))
    kept = _held(docs).withColumns(keys).join(heads.distinct(), "key_a", "left_semi")
    return kept.groupBy("key_a", "key_b").agg(F.first("held_row").alias("held_row")).select("held_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start in two places go, in whole characters; every document stays.

    Null texts stay null. n_chars follows the text where it changes; other columns stay.
    """
    kindred.ship(spark)
    rest = suffix.suffix_dedup(_held(docs), whole_characters=True)
    text = F.col("kept").cast("string")
    changed = F.col("n_removed") > 0
    fresh = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        old = F.col("held_row.n_chars")
        fresh["n_chars"] = F.when(changed, F.length(text)).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return rest.select(*[fresh[c].alias(c) if c in fresh else F.col("held_row").getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and slot; null and empty texts have no words, rows that repeat stay separate."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]
#: The classifiers and the suffix sort are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            deleted(spark, before)
        before = at
    return docs
