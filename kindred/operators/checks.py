"""Guards and comparisons: samples by hash, strict value maps, completeness, cardinality, parity, digests, given orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sampled(rows: DataFrame, key: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose key's SHA-256 begins with one of ``prefixes`` (of one length): a stable share of the keys."""
    return rows.filter(F.substring(F.sha2(F.col(key), 256), 1, len(prefixes[0])).isin(*prefixes))


def strict_map(column: Column, values: Mapping[str, object]) -> Column:
    """The value of each key; a key without one raises when it is evaluated, null stays null."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, column)
    miss = F.raise_error(F.concat(F.lit("no value for "), column)).cast("string")
    return F.when(column.isNull(), F.lit(None)).when(F.array_contains(F.map_keys(table), column), found).otherwise(miss)


def incomplete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, incomplete): how many rows have a null in one of ``columns``."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return rows.agg(F.count("*").alias("rows"), F.count_if(missing).alias("incomplete"))


def require_complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; a null in one of ``columns`` raises when its row is read."""
    checked = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null in {c}")).cast(rows.schema[c].dataType)) for c in columns}
    return rows.withColumns(checked)


def cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(left_repeats, right_repeats, shared, relation): how often each side repeats a key, and what a join on it would be."""
    sides = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], list(keys), "full")
    counts = both.agg(
        F.count_if(F.col("l") > 1).alias("left_repeats"), F.count_if(F.col("r") > 1).alias("right_repeats"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"),
    )
    one, many = F.lit("1"), F.lit("m")
    relation = F.concat(F.when(F.col("left_repeats") > 0, many).otherwise(one), F.lit(":"), F.when(F.col("right_repeats") > 0, many).otherwise(one))
    return counts.withColumn("relation", relation)


def joined_once(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that is one to one: a repeated key on either side raises."""
    row = cardinality(left, right, keys).first()
    if row["relation"] != "1:1":
        raise ValueError(f"join on {list(keys)} is {row['relation']}")
    return left.join(right, list(keys), how)


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], rank: str, score: str) -> DataFrame:
    """Rows of one side only, shared rows whose rank differs, and the greatest difference of a score, in one pass."""
    named = lambda df, s: df.select(*keys, F.col(rank).alias(f"rank_{s}"), F.col(score).alias(f"score_{s}"))
    both = named(left, "l").join(named(right, "r"), list(keys), "full")
    in_l, in_r = F.col("rank_l").isNotNull(), F.col("rank_r").isNotNull()
    return both.agg(
        F.count_if(in_l & ~in_r).alias("left_only"), F.count_if(in_r & ~in_l).alias("right_only"), F.count_if(in_l & in_r).alias("shared"),
        F.count_if(in_l & in_r & (F.col("rank_l") != F.col("rank_r"))).alias("rank_changes"),
        F.coalesce(F.max(F.abs(F.col("score_l") - F.col("score_r"))), F.lit(0.0)).alias("max_delta"),
    )


def digests(rows: DataFrame, group: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(part, n, digest): SHA-256 of each part's rows in order, every value as its length, a colon and itself; null as "-1:".

    Choose a ``group`` of bounded parts, such as a hash shard of the key; a digest of the parts' digests is one of all rows.
    """
    value = lambda c: F.concat(F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    line = F.concat(*[value(c) for c in columns])
    parts = rows.select(group.alias("part"), F.struct(*order, line.alias("line")).alias("x"))
    held = parts.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x")).alias("held"))
    return held.select("part", "n", F.sha2(F.array_join(F.col("held.line"), ""), 256).alias("digest"))


def reordered(rows: DataFrame, order: DataFrame, key: str, place: str = "place") -> DataFrame:
    """Rows in the places that ``order`` (key, place) gives them; keys on one side only raise."""
    joined = rows.join(order, key, "full")
    ok = F.col(place).isNotNull() & F.struct(*[c for c in rows.columns if c != key]).isNotNull()
    return joined.withColumn(place, F.when(ok, F.col(place)).otherwise(F.raise_error(F.concat(F.lit("key on one side only: "), key)).cast(order.schema[place].dataType)))


def group_id(*columns: str) -> Column:
    """A number for each group of equal values that depends on nothing but them: the first 60 bits of SHA-256, nulls apart."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def worst(rows: DataFrame, p: str, y: str, n: int, keys: Sequence[str]) -> DataFrame:
    """The ``n`` false positives with the highest scores and the ``n`` false negatives with the lowest; ties by ``keys``."""
    error = F.abs(F.col(p) - F.col(y))
    kind = F.when(F.col(y) == 1, "false_negative").otherwise("false_positive")
    scored = rows.withColumn("kind", kind).withColumn("error", error).filter("error >= 0.5")
    w = Window.partitionBy("kind").orderBy(F.desc("error"), *keys)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
