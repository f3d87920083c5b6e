"""Window features of scored pairs within a query record: context, z-scores, ranks, gaps, quantiles, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def query_context(pairs: DataFrame, features: Sequence[str], q: str = "q") -> DataFrame:
    """For each feature its maximum in the record, the gap to it and the share of it (0 if it is not positive)."""
    w = Window.partitionBy(q)
    out = {}
    for f in features:
        top = F.max(f).over(w)
        out |= {f"{f}_max": top, f"{f}_gap": F.col(f) - top, f"{f}_rel": F.when(top > 0, F.col(f) / F.nullif(top, F.lit(0.0))).otherwise(0.0)}
    return pairs.withColumns(out)


def qnorm(pairs: DataFrame, features: Sequence[str], q: str = "q", default: float = 0.0, floor: float = 1e-3) -> DataFrame:
    """z-scores in the record: (x - mean) / (std + floor), std ``default`` for a single value. Nulls stay null."""
    w = Window.partitionBy(q)
    std = lambda f: F.coalesce(F.stddev_samp(f).over(w), F.lit(default))
    return pairs.withColumns({f"{f}_z": (F.col(f) - F.avg(f).over(w)) / (std(f) + floor) for f in features})


def relative(pairs: DataFrame, features: Sequence[str], q: str = "q") -> DataFrame:
    """Dense rank from the top and distance to the top for each feature."""
    w = Window.partitionBy(q)
    out = {}
    for f in features:
        out |= {f"{f}_rank": F.dense_rank().over(w.orderBy(F.desc(f))), f"{f}_to_top": F.max(f).over(w) - F.col(f)}
    return pairs.withColumns(out)


def rank_ignoring_nulls(pairs: DataFrame, score: str, q: str = "q", t: str = "t") -> DataFrame:
    """Rank and gap to the best among rows that have the score; null for the others."""
    w = Window.partitionBy(q, F.col(score).isNull())
    rank = F.row_number().over(w.orderBy(F.desc(score), t))
    known = F.col(score).isNotNull()
    return pairs.withColumns({f"{score}_rank": F.when(known, rank), f"{score}_gap": F.when(known, F.max(score).over(w) - F.col(score))})


def average_quantile(rows: DataFrame, value: str, group: str, steps: int = 1000) -> DataFrame:
    """Average rank of a value in its group over the group's size: ties share the mean of their places.

    Values are counted, then the counts summed in ``steps`` buckets to the unit and between them, so no task holds a group.
    """
    bucket = F.floor(F.col(value) * steps)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("_n")).withColumn("_b", bucket)
    coarse = counts.groupBy(group, "_b").agg(F.sum("_n").alias("_m"))
    by_group = Window.partitionBy(group)
    before = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(group, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_below"), F.sum("_m").over(by_group).alias("_all"))
    inside = Window.partitionBy(group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(coarse, [group, "_b"])
    quantile = (F.col("_below") + F.col("_in") + (F.col("_n") + 1) / 2.0) / F.col("_all")
    return rows.join(placed.select(group, value, quantile.alias(f"{value}_quantile")), [group, value])


def top_margin(pairs: DataFrame, q: str = "q", t: str = "t", p: str = "p") -> DataFrame:
    """(q, first, second, margin): the two best scores of each record; a missing second counts as zero."""
    w = Window.partitionBy(q).orderBy(F.desc(p), t)
    two = pairs.withColumn("place", F.row_number().over(w)).filter("place <= 2")
    best = lambda n: F.max(F.when(F.col("place") == n, F.col(p)))
    rows = two.groupBy(q).agg(best(1).alias("first"), F.coalesce(best(2), F.lit(0.0)).alias("second"))
    return rows.withColumn("margin", F.col("first") - F.col("second"))


def siblings(pairs: DataFrame, q: str = "q", p: str = "p", strong: float = 0.9, middle: float = 0.5) -> DataFrame:
    """Rank, gap to the top and how many other pairs of the record are strong or middling."""
    w = Window.partitionBy(q)
    count = lambda floor: F.sum((F.col(p) >= floor).cast("int")).over(w) - (F.col(p) >= floor).cast("int")
    return pairs.withColumns({
        "rank": F.row_number().over(w.orderBy(F.desc(p), "t")), "gap_top": F.max(p).over(w) - F.col(p),
        "n_strong": count(strong), "n_mid": count(middle),
    })


def first_by(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int = 1, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def hash_sample(rows: DataFrame, key: str, partition: Sequence[str], n: int) -> DataFrame:
    """A stratified sample: the first ``n`` of each group by SHA-256 of the key, then the key."""
    return first_by(rows, partition, [F.sha2(F.col(key), 256).asc(), F.col(key).asc()], n, "sample_rank")


def nested_samples(rows: DataFrame, key: str, sizes: dict[str, int]) -> DataFrame:
    """Samples that contain each other: every row of the largest, with the smallest sample it is in. No global sort is
    needed beyond the top rows."""
    largest = max(sizes.values())
    h = F.sha2(F.col(key), 256)
    top = rows.withColumn("h", h).orderBy("h", key).limit(largest)
    # the limit bounds what meets in this window
    ranked = top.withColumn("sample_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", key)))
    name = F.lit(None).cast("string")
    for label, size in sorted(sizes.items(), key=lambda x: -x[1]):
        name = F.when(F.col("sample_rank") <= size, label).otherwise(name)
    return ranked.withColumn("sample", name).drop("h")


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """A row number from one in a total order, without one task for all rows.

    Rows are counted by the first three characters of the first order key, which must spread, as a digest does, and
    numbered inside them.
    """
    bucket = F.substring(order[0].cast("string"), 1, 3)
    held = rows.withColumn("_b", bucket)
    counts = held.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return held.withColumn("_p", place).join(before, "_b").withColumn(name, F.col("_before") + F.col("_p")).drop("_b", "_p", "_before")
