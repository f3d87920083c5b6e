"""Rescue routes and cuts of candidate pairs: boundary ties, caps, bounded reranks, anchors, pools and new pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_max(parts: Sequence[DataFrame], keys: Sequence[str] = ("q", "t"), p: str = "p") -> DataFrame:
    """The pairs of all parts, each once with its highest score. Columns that a part lacks are null and dropped."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.groupBy(*keys).agg(F.max(F.col(p).cast("double")).alias(p))


def top_k(rows: DataFrame, partition: Sequence[str], score: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` positive scores of each group, with whether a row ties with the last one that fits (``boundary``)."""
    group = Window.partitionBy(*partition)
    w = group.orderBy(F.desc(score), *order)
    placed = rows.filter(F.col(score) > 0).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    last = F.min(score).over(group)
    return placed.withColumn("boundary", (F.max("place").over(group) == k) & (F.col(score) == last))


def capped(ranked: DataFrame, caps: Mapping[str, int], route: str = "route", rank: str = "route_rank") -> DataFrame:
    """Rows up to the cap of their route; a route without one raises."""
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    cap = F.coalesce(F.try_element_at(table, F.col(route)), F.raise_error(F.concat(F.lit("no cap of "), route)).cast("int"))
    return ranked.filter(F.col(rank) <= cap)


def bounded_rerank(rows: DataFrame, group: Sequence[str], score: Column, order: Sequence[str], limit: int = 100, keep: int = 20) -> DataFrame:
    """Groups of at most ``limit`` rows whole, of larger ones the ``keep`` best by ``score``. ``score`` is made for large groups only."""
    size = F.count("*").over(Window.partitionBy(*group))
    sized = rows.withColumn("group_size", size)
    scored = sized.withColumn("rerank_score", F.when(F.col("group_size") > limit, score))
    w = Window.partitionBy(*group).orderBy(F.desc("rerank_score"), *order)
    return scored.withColumn("place", F.row_number().over(w)).filter((F.col("group_size") <= limit) | (F.col("place") <= keep)).drop("place")


def anchors(scored: DataFrame, texts: DataFrame, similarity, accept: float = 0.9, low: float = 0.2, floor: float = 0.95, most: int = 5) -> DataFrame:
    """(q, t, p, anchor, similarity): candidates of a record between ``low`` and ``accept`` whose text is like that of a pair
    of the record that is accepted. ``texts`` has t and text; ``similarity`` of two Columns. The ``most`` best accepted pairs
    of a record are its anchors; the most similar one is reported, ties by its id."""
    rows = scored.join(texts, "t")
    first = Window.partitionBy("q").orderBy(F.desc("p"), "t")
    held = rows.filter(F.col("p") >= accept).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    held = held.select("q", F.col("t").alias("anchor"), F.col("text").alias("anchor_text"))
    pairs = rows.filter((F.col("p") >= low) & (F.col("p") < accept)).select("q", "t", "p", "text").join(held, "q")
    near = pairs.withColumn("similarity", similarity(F.col("text"), F.col("anchor_text"))).filter(F.col("similarity") >= floor)
    best = Window.partitionBy("q", "t").orderBy(F.desc("similarity"), "anchor")
    return near.withColumn("place", F.row_number().over(best)).filter("place = 1").select("q", "t", "p", "anchor", "similarity")


def outside(pairs: DataFrame, known: DataFrame, keys: Sequence[str] = ("q", "t")) -> DataFrame:
    """Pairs that are not among the known ones."""
    return pairs.join(known.select(*keys).distinct(), list(keys), "left_anti")


def pool_block(queries: DataFrame, targets: DataFrame, key: Column, score: Column, cap: int = 500, keep: int = 3) -> DataFrame:
    """(q, t, key, score): for each query the ``keep`` best targets of its key, if at most ``cap`` targets have it.

    Both sides have id and what ``key`` reads, the targets' columns under the prefix t_ and the queries' under q_ in ``score``.
    """
    q = queries.withColumn("key", key).filter("key <> ''")
    t = targets.withColumn("key", key).filter("key <> ''")
    small = t.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).select("key")
    t = t.join(small, "key", "left_semi")
    named = lambda df, s: df.select("key", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "key"])
    rows = named(q, "q").join(named(t, "t"), "key").withColumn("score", score)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "t_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).select(F.col("q_id").alias("q"), F.col("t_id").alias("t"), "key", "score", "place")
