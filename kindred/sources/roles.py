"""Record roles: any table as (entity_id, business_name, business_address, country), split into queries and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import norm

COLUMNS = ("entity_id", "business_name", "business_address", "country")
FOLD_SEED, FOLDS = 20260925, 5


@dataclass
class Records:
    """Query records (S1) and target records (S2 and S3), raw."""

    queries: DataFrame
    targets: DataFrame

    def normalized(self) -> Records:
        """(entity_id, country, n, a) of both sides."""
        return Records(normalized(self.queries), normalized(self.targets))


def normalized(records: DataFrame) -> DataFrame:
    return records.select("entity_id", "country", norm(F.col("business_name")).alias("n"), norm(F.col("business_address")).alias("a"))


def from_documents(documents: DataFrame) -> Records:
    """Documents as records: the first line is the name, all other lines the address, the language the country.

    Sources 0 to 6 are the query side, 7 to 13 the second source, the others the third. Every document has one role.
    """
    number = F.substring("source", 4, 9).cast("int")
    prefix = F.when(number < 7, "S1-").when(number < 14, "S2-").otherwise("S3-")
    body = F.coalesce("text", F.lit(""))
    line = F.instr(body, "\n")
    rows = documents.select(
        F.concat(prefix, F.col("doc_id").cast("string")).alias("entity_id"),
        F.when(line > 0, F.substring_index(body, "\n", 1)).otherwise(body).alias("business_name"),
        F.when(line > 0, F.substr(body, line + 1)).otherwise("").alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )
    side = F.left("entity_id", F.lit(2))
    return Records(rows.filter(side == "S1"), rows.filter(side != "S1"))


def fold(entity_id: Column, seed: int = FOLD_SEED, folds: int = FOLDS) -> Column:
    """The first 32 bits of SHA-256 of "seed|id", modulo the number of folds."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), entity_id), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def shard(entity_id: Column, shards: int) -> Column:
    """The first 64 bits of SHA-256 as an unsigned number, modulo ``shards``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    whole = F.conv(F.substring(F.sha2(entity_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(whole, F.lit(shards).cast("decimal(20,0)")).cast("int")


def truth_by_name(records: Records) -> DataFrame:
    """(source1_entity_id, target_id): a target belongs to the query record of its country with its name and the least id."""
    owners = records.queries.filter("n <> ''").groupBy("country", "n").agg(F.min("entity_id").alias("source1_entity_id"))
    return records.targets.filter("n <> ''").join(owners, ["country", "n"]).select("source1_entity_id", F.col("entity_id").alias("target_id"))


def label_counts(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, country, n_matches, has_s2, has_s3, fold) of every query record, with or without links."""
    counted = pairs.groupBy("source1_entity_id").agg(
        F.count("*").alias("n_matches"), F.bool_or(F.col("target_id").startswith("S2-")).alias("has_s2"),
        F.bool_or(F.col("target_id").startswith("S3-")).alias("has_s3"),
    )
    rows = queries.select(F.col("entity_id").alias("source1_entity_id"), "country").join(counted, "source1_entity_id", "left")
    return rows.select(
        "source1_entity_id", "country", F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("has_s2", F.lit(False)).alias("has_s2"), F.coalesce("has_s3", F.lit(False)).alias("has_s3"),
        fold(F.col("source1_entity_id")).alias("fold"),
    )


def ownership(targets: DataFrame, pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """(target_id, source1_entity_id, owner_fold): -1 for targets that no pair has. A target with two owners raises."""
    rows = targets.select(F.col("entity_id").alias("target_id")).join(pairs, "target_id", "left")
    rows = rows.join(folds.select("source1_entity_id", "fold"), "source1_entity_id", "left")
    return rows.select("target_id", "source1_entity_id", F.coalesce("fold", F.lit(-1)).alias("owner_fold"))
