"""Connected components of an edge table by alternating large-star and small-star rounds, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not the least of its component, and that least node.

    ``edges`` has long columns u and v; direction, repeats, loops and null ends are ignored. Each round is written to the
    checkpoint folder. Neighbours are never gathered: a node's least neighbour is a partial aggregate, joined back.
    """
    now = checkpointed(
        edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _state(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, checkpointed(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        after = _state(now)
        if after == before:
            break
        before = after
    return now
