"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a vector of radius + 1 bits. Table t keeps the positions whose vector has an odd product with t.
The vectors of any ``radius`` positions leave some t orthogonal to all of them, so two fingerprints within the radius
agree on all kept positions of that table: no pair is missed. A bucket emits a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, chunks, utf8
from .components import stars

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a bucket that one block holds; larger buckets are compared block by block, in separate tasks.
BLOCK = 4096
#: Fewer fingerprints than this can be frequent: those with more than one in FREQUENT of all rows.
FREQUENT = 2048
#: For each byte, its bits in eight lanes of a 64-bit number.
LANES = np.array([sum((value >> j & 1) << 8 * j for j in range(8)) for value in range(256)], np.uint64)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The kept positions of each of the 2^(radius + 1) - 1 tables, as signed 64-bit numbers."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    unsigned = [sum(((t & m).bit_count() & 1) << i for i, m in enumerate(vectors)) for t in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def shingle_hashes(text: bytes, words: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of space-joined words, repeats included; of the whole sequence if it is shorter; none if empty."""
    found = text.lower().split()
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1).tolist()
    ends = (ends - 1).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is set in over half of a text's hashes."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in texts]
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        counts = np.zeros(64, np.int64)
        for a in range(0, len(h), 255 * 256):
            lanes = LANES[h[a : a + 255 * 256].view(np.uint8).reshape(-1, 8)]
            part = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
            counts += np.ascontiguousarray(part).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row, fp as a signed long; a text without words, or a null one, has fingerprint zero."""

    def run(batches):
        for part in chunks(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(utf8(part.column(1)), words).view(np.int64))], ["key", "fp"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, fp long").withColumnRenamed("key", key)


def _forest(fps: np.ndarray, other: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``fps``, or between ``fps`` and ``other``: from each member to its least."""
    nodes = fps if other is None else np.concatenate([fps, other])
    n, left = len(nodes), len(fps)
    free = np.ones(n, bool)
    edges = []
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        members, frontier = [first], [first]
        while frontier:
            at = frontier.pop()
            away = free if other is None else free & ((np.arange(n) < left) != (at < left))
            rest = np.flatnonzero(away)
            if not len(rest):
                if other is None:
                    break
                continue
            near = rest[np.bitwise_count(nodes[rest] ^ nodes[at]) <= radius]
            free[near] = False
            members += near.tolist()
            frontier += near.tolist()
        if len(members) > 1:
            values = nodes[members].view(np.int64)
            low = int(values.min())
            edges += [(int(v), low) for v in values if v != low]
    return edges


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over distinct longs ``fp`` whose components are those of all pairs within ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(radius))])
    dealt = fps.select("fp", F.explode(tables).alias("b")).select(F.col("b.t").alias("t"), F.col("b.k").alias("k"), "fp")
    ordered = dealt.repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def run(batches):
        held = np.empty((0, 3), np.int64)  # rows of the bucket that may go on
        done = 0  # its blocks so far

        def finish(rows, last):
            """Edges and blocks of complete buckets; the last bucket waits for more rows unless the input has ended."""
            nonlocal held, done
            edges, blocks = [], []
            cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts = np.r_[0, cut]
            ends = np.r_[cut, len(rows)]
            if not last:
                starts, ends, held = starts[:-1], ends[:-1], rows[starts[-1] :]
            sizes = ends - starts
            if done and len(starts):
                fps = rows[starts[0] : ends[0], 2].view(np.uint64)
                edges += _forest(fps, None, radius)
                blocks.append((*rows[starts[0], :2].tolist(), done, fps.view(np.int64).tolist()))
                starts, ends, sizes, done = starts[1:], ends[1:], sizes[1:], 0
            two = starts[sizes == 2]
            a, b = rows[two, 2], rows[two + 1, 2]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            edges += list(zip(np.maximum(a, b)[near].tolist(), np.minimum(a, b)[near].tolist(), strict=True))
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                edges += _forest(rows[s:e, 2].view(np.uint64), None, radius)
            while not last and len(held) > block:
                fps = np.ascontiguousarray(held[:block, 2]).view(np.uint64)
                edges += _forest(fps, None, radius)
                blocks.append((*held[0, :2].tolist(), done, fps.view(np.int64).tolist()))
                held, done = held[block:], done + 1
            return edges, blocks

        def batch(edges, blocks):
            u, v = zip(*edges, strict=True) if edges else ((), ())
            n, none = len(blocks), [None] * len(blocks)
            t, k, i, members = zip(*blocks, strict=True) if blocks else ((), (), (), ())
            e = [None] * len(edges)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*u, *none], pa.int64()), pa.array([*v, *none], pa.int64()), pa.array([*e, *t], pa.int64()),
                    pa.array([*e, *k], pa.int64()), pa.array([*e, *i], pa.int64()), pa.array([*e, *members], pa.list_(pa.int64())),
                ],
                ["u", "v", "t", "k", "i", "fps"],
            ) if n or edges else None

        for part in batches:
            rows = np.stack([np.asarray(c, np.int64) for c in part.columns], 1)
            rows = np.ascontiguousarray(np.concatenate([held, rows]))
            if len(rows):
                out = batch(*finish(rows, False))
                if out:
                    yield out
        if len(held):
            out = batch(*finish(held, True))
            if out:
                yield out

    found = checkpointed(
        ordered.select(F.col("t").cast("long"), "k", "fp").mapInArrow(run, "u long, v long, t long, k long, i long, fps array<long>")
    )
    edges = found.filter(F.col("u").isNotNull()).select("u", "v")
    blocks = found.filter(F.col("fps").isNotNull())
    return edges.union(_across(blocks, radius)).distinct()


def _across(blocks: DataFrame, radius: int) -> DataFrame:
    """Links between the blocks of one bucket; each pair of blocks is a row of its own, dealt out evenly."""
    a = blocks.select("t", "k", "i", "fps")
    b = blocks.select("t", "k", F.col("i").alias("j"), F.col("fps").alias("others"))
    pairs = a.join(b, ["t", "k"]).filter(F.col("i") < F.col("j")).repartition("t", "k", "i", "j").select("fps", "others")

    def run(batches):
        for part in batches:
            edges = []
            for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                edges += _forest(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64), radius)
            u, v = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the least key that is reachable, itself included.

    ``key`` is a long; rows that share one, and null keys, stay separate rows (a component with null keys only has a
    null id). Texts without words share fingerprint zero and are linked like any other. Copies meet in their
    fingerprint before anything is compared.
    """
    rows = checkpointed(fingerprints(df, key, text, words).withColumnRenamed(key, "id"))
    counted = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    least = counted.select("fp", "least")
    star = stars(links(least.select("fp"), radius, block)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = checkpointed(star.union(star.select(F.col("root").alias("fp"), "root").distinct()))
    of_root = checkpointed(nodes.join(least, "fp").groupBy("root").agg(F.min("least").alias("component")))
    joined = nodes.join(of_root, "root").select("fp", "component")
    of_fp = checkpointed(least.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = [r["fp"] for r in counted.filter(F.col("n") * FREQUENT > total).select("fp").collect()]
    if often:  # copies by the million are joined where they lie
        hot = F.col("fp").isin(often)
        joined = rows.filter(hot).join(F.broadcast(of_fp.filter(hot)), "fp").unionByName(rows.filter(~hot).join(of_fp.filter(~hot), "fp"))
    else:
        joined = rows.join(of_fp, "fp")
    return joined.select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
