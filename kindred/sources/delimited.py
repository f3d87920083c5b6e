"""Strict tab-separated sources and the list, shard and Parquet sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import COLUMNS, shard


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] = COLUMNS, quoted: bool = False) -> DataFrame:
    """A TSV with exactly these columns, all text. Empty cells are empty strings; NA and NULL stay text.

    Another header or a row of another width raises when it is read.
    """
    header = spark.read.text(path).limit(1).collect()
    if not header or header[0][0].lstrip("﻿").rstrip("\r").split("\t") != list(columns):
        raise ValueError(f"header of {path} is not {list(columns)}")
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("header", True)
    reader = reader.option("mode", "FAILFAST").option("enforceSchema", False).option("nullValue", "\u0000")
    if not quoted:
        reader = reader.option("quote", "").option("escape", "")
    rows = reader.csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def read_lists(spark: SparkSession, path: str, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, ids array) of a list file. Bad ids, blanks, repeats and repeated rows raise."""
    rows = parse_lists(read_tsv(spark, path, ("source1_entity_id", column)), column)
    repeated = rows.groupBy("source1_entity_id").count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"repeated row in {path}")
    return rows


def parse_lists(rows: DataFrame, column: str) -> DataFrame:
    """Comma lists as arrays; the empty string is the empty list. A malformed row raises when it is evaluated."""
    ids = F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))
    good = F.forall(ids, lambda x: x.rlike(r"^S[23]-\S+$")) & (F.size(F.array_distinct(ids)) == F.size(ids))
    good &= F.col("source1_entity_id").rlike(r"^S1-\S+$")
    checked = F.when(good, ids).otherwise(F.raise_error(F.concat(F.lit("invalid list of "), F.col("source1_entity_id"))).cast("array<string>"))
    return rows.select("source1_entity_id", checked.alias(column))


def lists(queries: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per query record: its targets, distinct, sorted and comma-joined; empty without any."""
    joined = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(column))
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(joined, "source1_entity_id", "left").fillna("", [column])


def write_lists(rows: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    """A sorted list file; an existing path raises. An empty list is nothing after the tab."""
    lines = rows.orderBy("source1_entity_id").select(F.concat_ws("\t", "source1_entity_id", column).alias("value"))
    head = rows.sparkSession.createDataFrame([(f"source1_entity_id\t{column}",)], "value string")
    head.coalesce(1).union(lines).write.mode("errorifexists").text(path)


def write_sharded(rows: DataFrame, path: str, shards: int = 64, key: str = "source1_entity_id") -> None:
    """Compressed TSV parts by a hash of the key, a folder for each shard."""
    dealt = rows.withColumn("shard", shard(F.col(key), shards))
    dealt.repartition("shard").write.mode("errorifexists").partitionBy("shard").option("sep", "\t").option("header", True).option(
        "compression", "gzip"
    ).csv(path)


def merge_shards(parts: Sequence[DataFrame], required: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """The union of disjoint parts, ordered. A key in two parts, a missing one or an unknown one raises."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    wanted = required.select(F.col("entity_id").alias(key))
    if merged.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("a key is in two parts")
    if merged.join(wanted, key, "left_anti").limit(1).count() or wanted.join(merged, key, "left_anti").limit(1).count():
        raise ValueError("merged keys differ from the required ones")
    return merged.orderBy(key)


def write_verified(rows: DataFrame, path: str, sort: Sequence[str] = (), group_bytes: int = 128 << 20) -> DataFrame:
    """ZSTD Parquet with row groups of about ``group_bytes``, read back and compared as a bag both ways.

    An existing path or a difference raises.
    """
    out = rows.orderBy(*sort) if sort else rows
    out.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if rows.exceptAll(back).limit(1).count() or back.exceptAll(rows).limit(1).count():
        raise ValueError(f"{path} differs from what was written")
    return back


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows as tab-separated text with a header and no quotes; nulls are empty. A tab or line break in a value raises."""
    def safe(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(text.rlike("[\\t\\r\\n]"), F.raise_error(F.lit(f"tab or line break in {c}")).cast("string")).otherwise(text).alias(c)

    rows.select(*[safe(c) for c in rows.columns]).write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_object(spark: SparkSession, path: str) -> bytes:
    """A small object of any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def put_object(spark: SparkSession, path: str, data: bytes) -> str:
    """Stores a small object beside its SHA-256 and reads it back; returns the digest.

    An object with this digest is left alone, another one at the path raises, and so does a read that differs.
    """
    digest = hashlib.sha256(data).hexdigest()
    store, at = _store(spark, path)
    if store.exists(at):
        if hashlib.sha256(read_object(spark, path)).hexdigest() != digest:
            raise FileExistsError(f"{path} holds another object")
    else:
        out = store.create(at, False)
        out.write(bytearray(data))
        out.close()
        if hashlib.sha256(read_object(spark, path)).hexdigest() != digest:
            raise ValueError(f"{path} differs from what was written")
    side_store, side = _store(spark, path + ".sha256")
    if not side_store.exists(side):
        out = side_store.create(side, False)
        out.write(bytearray(digest.encode()))
        out.close()
    return digest


def read_config(spark: SparkSession, path: str, known: Sequence[str]) -> dict:
    """A JSON object of settings; a key that is not ``known`` raises."""
    found = json.loads(read_object(spark, path))
    if not isinstance(found, dict) or set(found) - set(known):
        raise ValueError(f"unknown settings in {path}: {sorted(set(found) - set(known)) if isinstance(found, dict) else found!r}")
    return found


def write_report(spark: SparkSession, path: str, report: dict) -> str:
    """A JSON report with sorted keys, stored once; returns its digest."""
    return put_object(spark, path, json.dumps(report, sort_keys=True, indent=2, default=str).encode())


def write_index(vectors: DataFrame, idf: DataFrame, path: str) -> None:
    """A retrieval index: unit vectors by country and source, and the terms they are made of."""
    vectors.write.mode("errorifexists").partitionBy("country", "source").option("compression", "zstd").parquet(f"{path}/vectors")
    idf.write.mode("errorifexists").partitionBy("country").option("compression", "zstd").parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, terms) of an index."""
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{path}/{name}")
    vectors = read("vectors", "id string, terms array<long>, weights array<double>, country string, source string")
    return vectors, read("terms", "gram string, idf double, term long, country string")
