"""Near-duplicates of the pipeline: SimHash first, then an exact join of shingle sets for the pairs beyond its radius.

Covering LSH over SimHash fingerprints links the texts that differ in few bits; its links are confirmed on whole texts.
Fingerprints of pairs near the bound differ in more bits than tables can cover, so every pair of texts that these links
have not joined, and whose Jaccard similarity reaches the bound, is found by an exact join.

Shingles have one global order: the frequent ones of a sample last, the others by hash. Two sets of similarity t share a
shingle among the first n - ceil(t * n) + 1 of each (a prefix), so only texts that meet in a prefix are candidates; sizes
and places in the prefixes rule some out. Whatever the order is, no pair is missed; it only decides how many candidates
there are. A sketch has the parity of the shingles of each of its bits, so two sets differ in at least as many shingles as
their sketches in bits, which rules out more. The rest is confirmed on whole texts. A large bucket is first compared with its least member, and
then only across the components that this has left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import checkpointed, chunks, discard, release, utf8
from .components import stars
from .simhash import SEED

#: Words of a shingle, and the similarity as a fraction.
WORDS, SHARE = 5, (4, 5)
#: Members of a bucket that are all compared at once; rows of a block of a larger one.
SMALL, BLOCK = 16, 2048
#: A sketch has 2^BITS bits, the wide one that is kept beside each text 2^WIDE. Sets of LARGE shingles or more, whose number of
#: differing bits the wide one can't tell from the bound, have a deep one of 2^DEEP bits as well.
BITS, WIDE, DEEP, LARGE = 9, 11, 14, 3072
#: A text is stored compressed unless that is this many times smaller, so that a batch of stored texts bounds the texts.
EXPANSION = 8
#: Links that are sent to every executor, so that texts need not be shuffled to meet theirs; more are joined.
LINKS = 1_000_000
#: Bytes of texts that one job may send to their pairs in any case.
SENT = 64 << 20
#: Texts of the sample, its count from which a shingle is frequent, and the most of them that are sent out.
SAMPLE, OFTEN, LISTED = 5000, 5, 100_000


FACTORS = np.random.default_rng(5).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending: of all its words where it has fewer, none where it has none.

    A shingle's hash is a sum of its words' hashes, each times the odd factor of its place, and then mixed.
    """
    types: dict[bytes, int] = {}
    split = [t.lower().split() for t in texts]
    ids = np.array([types.setdefault(w, len(types)) for found in split for w in found], np.int64)
    word = np.array([xxh64_intdigest(w, SEED) for w in types], np.uint64)
    sizes = [len(found) for found in split]
    flat = word[ids] if len(ids) else word
    n = max(0, len(flat) - words + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(words):
        sums += flat[j : j + n] * FACTORS[j]
    out, at = [], 0
    for size, found in zip(sizes, split, strict=True):
        if size >= words:
            mixed = sums[at : at + size - words + 1]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * FACTORS[63]
            out.append(np.unique(mixed ^ (mixed >> np.uint64(29))).view(np.int64))
        else:
            out.append(np.array([xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64).view(np.int64))
        at += size
    return out


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    return shingle_sets([text], words)[0]


def _least(n, share):
    """The overlap that a set of ``n`` needs with any other to be similar."""
    return -(-share[0] * n // share[1])


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, frequent: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The first shingles of a set in the global order."""
    late = np.isin(found, frequent, assume_unique=True)
    return np.concatenate([found[~late], found[late]])[: len(found) - _least(len(found), share) + 1]


def sketch(found: np.ndarray, power: int = BITS) -> np.ndarray:
    """2^power parity bits of a set, as longs; the bit of a shingle is in its top bits."""
    bits = np.bincount((found.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def packed(text: bytes) -> bytes:
    """A text as it is stored: compressed after a 1, or itself after a 0."""
    small = zstandard.ZstdCompressor(level=3).compress(text)
    return b"\1" + small if len(small) < len(text) <= EXPANSION * len(small) else b"\0" + text


def unpacked(column: pa.Array) -> list[bytes]:
    opened = zstandard.ZstdDecompressor()
    return [opened.decompress(x[1:]) if x[:1] == b"\1" else x[1:] for x in column.to_pylist()]


def _possible(n, m, i, j, share):
    """Whether sets of n and m that meet at places i and j can be similar; places before the first common one only lower this."""
    most = 1 + np.minimum(n - i - 1, m - j - 1) + np.minimum(i, j)
    return (share[1] * np.minimum(n, m) >= share[0] * np.maximum(n, m)) & ((share[0] + share[1]) * most >= share[0] * (n + m))


def _pairs(fps, sizes, places, share, apart=None, sketches=None):
    """(u, v), u above v, of the rows for which ``apart(i)`` and the bounds leave a chance, row by row."""
    for i in range(len(fps) - 1):
        rest = slice(i + 1, None)
        ok = _possible(sizes[i], sizes[rest], places[i], places[rest], share) & (fps[rest] != fps[i])
        if apart is not None:
            ok &= apart(i)
        if sketches is not None:
            at = np.flatnonzero(ok)
            differ = np.bitwise_count(sketches[i + 1 :][at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            ok[at] = (share[0] + share[1]) * differ <= (share[1] - share[0]) * (sizes[i] + sizes[i + 1 :][at])
        other = fps[rest][ok]
        if len(other):
            yield np.maximum(other, fps[i]), np.minimum(other, fps[i])


def _groups(batches, keys: int):
    """Rows of each group of equal leading columns, in input that is sorted by them."""
    held = None
    for part in batches:
        rows = np.stack([np.asarray(c, np.int64) for c in part.columns], 1)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        for a, b in zip(np.r_[0, cut[:-1]], cut, strict=True) if len(cut) else ():
            yield rows[a:b]
        held = rows[cut[-1] :] if len(cut) else rows
    if held is not None and len(held):
        yield held


def _frequent(heads: DataFrame, total: int, words: int) -> np.ndarray:
    """Shingles of more than OFTEN of about SAMPLE texts."""

    def run(batches):
        for part in chunks(batches, 2 << 20):
            found = shingle_sets(unpacked(part.column(0)), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["h"])

    sample = heads.filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(max(1, total // SAMPLE))) == 0).select("stored")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(LISTED).collect()], np.int64))


def _postings(heads: DataFrame, frequent: np.ndarray, words: int, share) -> DataFrame:
    """(h, fp, ni, moved): the prefix of each text, with the size n of its set, the place i and its component so far.

    ``ni`` is n * 2^32 + i and ``moved`` the component's fp xor the own one, mostly zero, so that little of a row is shuffled.
    """

    def run(batches):
        for part in chunks(batches, 1 << 20):
            sets = shingle_sets(unpacked(part.column(1)), words)
            first = [prefix(s, frequent, share) for s in sets]
            times = [len(p) for p in first]
            if sum(times):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(first)), pa.array(np.repeat(np.asarray(part.column(0)), times)),
                        pa.array(np.repeat([len(s) << 32 for s in sets], times) + np.concatenate([np.arange(k) for k in times])),
                        pa.array(np.repeat(np.asarray(part.column(0)) ^ np.asarray(part.column(2)), times)),
                    ],
                    ["h", "fp", "ni", "moved"],
                )

    return heads.select("fp", "stored", "root").mapInArrow(run, "h long, fp long, ni long, moved long")


def _opened(part: pa.RecordBatch) -> np.ndarray:
    """Rows h, fp, n, i, root of a batch of postings."""
    h, fp, ni, moved = (np.asarray(c, np.int64) for c in part.columns)
    return np.stack([h, fp, ni >> 32, ni & 0xFFFFFFFF, fp ^ moved], 1)


FOUND = ["u", "v", "h", "fp", "n", "i", "root"]


def _batch(us, vs, passed) -> pa.RecordBatch:
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
    rows = np.concatenate([np.empty((0, 5), np.int64), *passed])
    wide = [pa.concat_arrays([pa.array(x), pa.nulls(len(rows), pa.int64())]) for x in (u, v)]
    wide += [pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(np.ascontiguousarray(c))]) for c in rows.T]
    return pa.RecordBatch.from_arrays(wide, FOUND)


def _met(postings: DataFrame, share, small: int) -> DataFrame:
    """(u, v) candidates of different components in small buckets and with the least member of each large one.

    The rows (h, fp, n, i, root) of a large bucket are passed on; it streams through, only its first rows are held.
    """

    def run(batches):
        us, vs, passed, held = [], [], [], 0

        def add(pairs):
            nonlocal held
            for u, v in pairs:
                us.append(u)
                vs.append(v)
                held += len(u)

        def close(rows):
            if len(rows) > 1:
                roots = rows[:, 4]
                if (roots != roots[0]).any():
                    add(_pairs(rows[:, 1], rows[:, 2], rows[:, 3], share, lambda i: roots[i + 1 :] != roots[i]))

        least, open_ = None, np.empty((0, 5), np.int64)  # of a large bucket, its least row; the rows of one that may be small
        for part in batches:
            rows = np.concatenate([open_, _opened(part)])
            open_ = rows[:0]
            if not len(rows):
                continue
            cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
            many = (ends - starts > 1) | (np.arange(len(starts)) == len(starts) - 1)
            if least is not None:
                many[0] = True
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                group = rows[s:e]
                if least is None or group[0, 0] != least[0]:
                    least = None
                    if len(group) <= small:
                        if e == len(rows):
                            open_ = group
                        else:
                            close(group)
                        continue
                    least = group[0]
                ok = _possible(least[2], group[:, 2], least[3], group[:, 3], share) & (group[:, 4] != least[4])
                add([(group[ok, 1], np.full(int(ok.sum()), least[1]))])
                passed.append(group)
                held += len(group)
            if held > 100_000:
                yield _batch(us, vs, passed)
                us, vs, passed, held = [], [], [], 0
        close(open_)
        if held:
            yield _batch(us, vs, passed)

    dealt = postings.repartition("h").sortWithinPartitions("h", "fp")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def _labelled(rows: DataFrame, star: DataFrame) -> DataFrame:
    """``rows`` with the least member of the component of each fp as root."""
    roots = star.withColumnsRenamed({"u": "fp", "v": "root"})
    return rows.join(F.broadcast(roots) if star.count() <= LINKS else roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _across(large: DataFrame, star: DataFrame, heads: DataFrame, share, block: int) -> DataFrame:
    """(u, v) candidates of different components in the large buckets; pairs of blocks are dealt out one by one."""
    labelled = _labelled(large.select("h", "fp", "n", "i"), star)
    counts = labelled.groupBy("h").agg(F.ceil(F.count("*") / block).alias("blocks"), F.min("root").alias("a"), F.max("root").alias("z"))
    rows = labelled.join(counts.filter("a < z").select("h", "blocks"), "h").withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.join(heads.select("fp", "sketch"), "fp")
    cells = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("h", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "fp", "n", "i", "root", "x", *[F.col("sketch")[k].alias(f"s{k}") for k in range((1 << BITS) // 64)])

    def run(batches):
        us, vs, held = [], [], 0
        for rows in _groups(batches, 3):
            fps, sizes, places, roots, x = rows[:, 3:8].T
            cross = rows[0, 1] != rows[0, 2]
            apart = lambda i, r=roots, x=x, cross=cross: (r[i + 1 :] != r[i]) & ((x[i + 1 :] != x[i]) if cross else True)
            for u, v in _pairs(fps, sizes, places, share, apart, rows[:, 8:].view(np.uint64)):
                us.append(u)
                vs.append(v)
                held += len(u)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                    us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return cells.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, heads: DataFrame, words: int, share) -> DataFrame:
    """The pairs whose texts are similar; wide sketches, and deep ones of large sets, rule out most others before a text is moved."""
    bits = sum((F.bit_count(F.col("su")[k].bitwiseXOR(F.col("sv")[k])) for k in range((1 << WIDE) // 64)), F.lit(0))
    for x in ("u", "v"):
        pairs = pairs.join(heads.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"s{x}")), x)
    left = lambda bits: (share[0] + share[1]) * bits <= (share[1] - share[0]) * (F.col("nu") + F.col("nv"))
    large = (F.col("nu") >= LARGE) & (F.col("nv") >= LARGE)
    wide = checkpointed(pairs.filter(left(bits)).select("u", "v", "nu", "nv"))
    deep = wide.filter(large)
    for x in ("u", "v"):
        deep = deep.join(heads.filter(F.col("n") >= LARGE).select(F.col("fp").alias(x), F.col("deep").alias(f"d{x}")), x)
    bits = F.aggregate(F.zip_with("du", "dv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    pairs = checkpointed(wide.filter(~large).select("u", "v").union(deep.filter(F.coalesce(left(bits), F.lit(True))).select("u", "v")))
    discard(wide)
    stored = heads.select("fp", "stored")
    size = F.octet_length("stored")
    most = stored.agg(F.sum(size)).first()[0] or 0
    sent = pairs.join(heads.select(F.col("fp").alias("u"), size.alias("size")), "u").agg(F.sum("size")).first()[0] or 0
    release(heads.sparkSession)

    def run(batches):
        for part in chunks(batches, 1 << 20):
            us, vs = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = dict(zip(us + vs, unpacked(part.column(2)) + unpacked(part.column(3)), strict=True))
            sets = dict(zip(texts, shingle_sets(list(texts.values()), words), strict=True))
            good = [similar(sets[a], sets[b], share) for a, b in zip(us, vs, strict=True)]
            yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def confirmed(some):
        u, v = (stored.join(some.select(F.col(x).alias("fp")), "fp", "left_semi").withColumnsRenamed({"fp": x, "stored": f"t{x}"}) for x in ("u", "v"))
        return checkpointed(some.join(u, "u").join(v, "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"))

    parts = slices(sent, most)
    if parts == 1:
        done = confirmed(pairs)
    else:
        done = reduce(DataFrame.union, [confirmed(pairs.filter(F.pmod(F.xxhash64("u", F.lit(3)), F.lit(parts)) == i)) for i in range(parts)])
    discard(pairs)
    return done


def slices(sent: int, stored: int) -> int:
    """In how many jobs texts go to their pairs, so that each sends about as many bytes as are stored, whatever the number of pairs."""
    return max(1, -(-sent // max(stored, SENT)))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE, small: int = SMALL, block: int = BLOCK
) -> DataFrame:
    """(key, component_id) of every row; component_id is the least key that is reachable over pairs of at least ``share``.

    ``key`` is a long; rows that share one, and null keys, stay separate rows. Sets that are equal meet before anything is
    compared; texts without words have one set.
    """

    def run(batches):
        for part in chunks(batches, 2 << 20):
            texts = utf8(part.column(1))
            sets = shingle_sets(texts, words)
            fps = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            arrays = [
                part.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s, WIDE) for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s, DEEP) if len(s) >= LARGE else None for s in sets], pa.list_(pa.int64())), pa.array([packed(t) for t in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "fp", "n", "sketch", "wide", "deep", "stored"])

    def opened(batches):
        for part in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(unpacked(part.column(1)), pa.binary()).cast(pa.string())], ["head", "text"])

    spark = df.sparkSession
    source = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    marked = source.mapInArrow(run, "id long, fp long, n long, sketch array<long>, wide array<long>, deep array<long>, stored binary")
    rows = checkpointed(marked.select("id", "fp"))
    heads = checkpointed(marked.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "wide", "deep", "stored")]))
    release(spark)
    head = heads.select("fp", "stored").mapInArrow(opened, "head long, text string")
    known = simhash.near_duplicates(head, "head", "text", words).filter("head != component_id")
    pairs = checkpointed(known.select(F.greatest("head", "component_id").alias("u"), F.least("head", "component_id").alias("v")).distinct())
    release(spark)
    near = _confirmed(pairs, heads, words, share)
    discard(pairs)
    release(spark)
    frequent = _frequent(heads, heads.count(), words)
    # the candidates and, of large buckets, the rows
    found = checkpointed(_met(_postings(_labelled(heads, stars(near)), frequent, words, share), share, small))
    release(spark)
    first = found.filter(F.col("u").isNotNull()).select("u", "v").distinct()
    edges = near.union(_confirmed(first, heads, words, share))
    release(spark)
    star = stars(edges)
    rest = checkpointed(_across(found.filter(F.col("h").isNotNull()), star, heads, share, block).distinct())
    more = _confirmed(rest.join(first, ["u", "v"], "left_anti"), heads, words, share)
    discard(found, rest)
    release(spark)
    star = stars(edges.union(more)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    discard(heads)
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = checkpointed(star.union(star.select(F.col("root").alias("fp"), "root").distinct()))
    of_root = checkpointed(nodes.join(least, "fp").groupBy("root").agg(F.min("least").alias("component")))
    joined = nodes.join(of_root, "root").select("fp", "component")
    of_fp = checkpointed(least.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return rows.join(of_fp, "fp").select(F.col("id").alias(key), "component_id")
