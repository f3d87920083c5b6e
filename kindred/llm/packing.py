"""Packing by optimal length buckets.

A dynamic programme over the global length histogram places the bucket boundaries so that padding is least. Texts are
numbered inside their bucket by a distributed count, and every run of ``budget // boundary`` of them is a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, checkpointed

BUCKETS, BUDGET = 8, 16_384
#: Rows that are numbered together.
SLICE = 20_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; zero for null."""
    return F.coalesce(F.size(F.filter(F.split(text.cast("string"), SPACE + "+"), lambda w: w != "")), F.lit(0)).cast("long")


def _layer(best: np.ndarray, high: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padded sizes of the first j + 1 lengths with one bucket more than ``best``, and the last cut (-1: no gain).

    The best cut never moves down as j grows, so each level of a halving of all j looks at every cut about once.
    """
    n = len(high)
    fresh, cut = best.copy(), np.full(n, -1)
    low, top, least, most = (np.array([x]) for x in (1, n - 1, 0, n - 2))
    while len(low):
        j = (low + top) >> 1
        sizes = np.minimum(most, j - 1) - least + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) + np.repeat(least - starts, sizes)
        wide = np.repeat(j, sizes)
        through = best[i] + high[wide] * (upto[wide + 1] - upto[i + 1])
        found = np.minimum.reduceat(through, starts)
        at = np.flatnonzero(through == np.repeat(found, sizes))
        at = i[at[np.searchsorted(at, starts)]]
        gain = found < best[j]
        fresh[j[gain]], cut[j[gain]] = found[gain], at[gain]
        low, top, least, most = np.r_[low, j + 1], np.r_[j - 1, top], np.r_[least, at], np.r_[at, most]
        keep = low <= top
        low, top, least, most = low[keep], top[keep], least[keep], most[keep]
    return fresh, cut


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries, at most ``buckets`` of them, the last at the longest length, with the least total padding.

    The padded size of texts in (a, b] is b times their count; their own lengths do not depend on the choice. Ties take
    the lower split, and no more buckets are used than lower the padding. Sums are whole numbers of 64 bits.
    """
    if not len(lengths):
        return []
    high = np.array(lengths, np.int64)
    upto = np.r_[0, np.cumsum(np.array(counts, np.int64))]
    best = high * upto[1:]  # one bucket for the first j + 1 lengths
    cuts = []
    for _ in range(min(buckets, len(high)) - 1):
        best, cut = _layer(best, high, upto)
        cuts.append(cut)
    found, j = [int(high[-1])], len(high) - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            found.append(int(high[j]))
    return found[::-1]


def pack(df: DataFrame, key: str = "doc_id", length: Column | None = None, text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE) -> DataFrame:
    """(key, n_tokens, bucket, padded_length, batch_id, slot) of every row.

    ``length`` defaults to the words of ``text``; null counts as zero, and empty texts are packed like any other. A text
    longer than the budget has a batch to itself. Rows with one key, or with a null one, stay separate and are dealt out.
    The histogram has every length; the driver holds one row for each different length, fewer than the longest text has.
    """
    size = word_count(F.col(text)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    rows = checkpointed(df.select(F.col(key).alias("id"), size.alias("n"), F.monotonically_increasing_id().alias("row")))
    bins = rows.groupBy("n").agg(F.count("*").alias("count")).toArrow()
    order = np.argsort(np.asarray(bins.column("n")), kind="stable")
    lengths, counts = np.asarray(bins.column("n"))[order], np.asarray(bins.column("count"))[order]
    boundaries = optimal_boundaries(lengths, counts, buckets) or [0]
    total = int(counts.sum())
    room = [max(1, budget // max(1, b)) for b in boundaries]
    held = np.diff(np.r_[0, np.cumsum(counts)][np.searchsorted(lengths, [-1, *boundaries], side="right")]).tolist()
    before = np.cumsum([0, *(-(-n // r) for n, r in zip(held, room, strict=True))]).tolist()
    number = F.lit(0)
    for b in boundaries[:-1]:
        number = number + (F.col("n") > b).cast("int")
    slices = max(1, -(-total // slice_rows))
    dealt = rows.select("id", "n", "row", number.alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"))
    counted = dealt.groupBy("bucket", "slice").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("bucket", "slice", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "slice").orderBy("id", "n", "row")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["bucket", "slice"])
    place = F.col("offset") + F.col("place")
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)
    per = of(room, "long")
    return ranked.select(
        F.col("id").alias(key), F.col("n").alias("n_tokens"), "bucket", of(boundaries, "long").alias("padded_length"),
        (of(before[:-1], "long") + F.floor(place / per)).alias("batch_id"), (place % per).cast("int").alias("slot"),
    )


def padded_batches(df: DataFrame, packed: DataFrame, ids: str, key: str = "doc_id", pad: int = 0) -> DataFrame:
    """(batch_id, bucket, padded_length, keys, token_ids) of every batch, its rows in order and padded to one length with ``pad``.

    ``ids`` is an array column of ``df`` whose sizes were the lengths given to :func:`pack`; ``key`` must be unique there.
    Null arrays are empty. No group is larger than the budget, but for a text that is longer by itself.
    """
    rows = packed.select(F.col(key).alias("id"), "batch_id", "bucket", "padded_length", "slot")
    body = df.select(F.col(key).alias("id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    fill = F.array_repeat(F.lit(pad), (F.col("padded_length") - F.size("ids")).cast("int"))
    wide = rows.join(body, rows["id"].eqNullSafe(body["id"])).select(rows["*"], F.concat("ids", fill).alias("ids"))
    grouped = wide.groupBy("batch_id", "bucket", "padded_length").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "ids"))).alias("held"))
    return grouped.select("batch_id", "bucket", "padded_length", F.col("held.id").alias("keys"), F.col("held.ids").alias("token_ids"))
