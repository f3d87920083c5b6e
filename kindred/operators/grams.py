"""Top-k cosines of character n-grams with disk in proportion to the texts.

Grams are numbers in the base of the alphabet of the fitted texts, counted in numpy. The vectors of the targets are written
once to the shared folder, in the order of (country, source, id). A task has a block of query texts, reads the targets of
its country from there, chunk by chunk, and keeps the best ``k`` of each query and source; equal texts are one query. So no vector is sent once for
each block of the other side, and no partial result is shuffled or sorted: what a task yields is final. Terms of many
texts are columns of a matrix product, all others lists of targets. Scores are rounded to nine digits before they are
compared. Targets come by id, so of equal scores the earlier one stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.sources import views

#: Characters whose grams are sorted at once; of the queries of a task; grams that a counting task holds.
PIECE, BLOCK, HELD = 1 << 20, 1 << 22, 1 << 21
#: Targets and terms of a chunk; numbers of a chunk's matrix and of a product; single products that are added at once.
TARGETS, TERMS, DENSE, PRODUCT, EVENTS = 8192, 1 << 21, 1 << 22, 1 << 20, 1 << 20
#: Terms of a greater share of the texts are columns, up to so many.
SHARE, COLUMNS = 0.1, 4096
#: Numbers of a gram must be below it.
LARGEST = 1 << 62


def _pieces(batches, at: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` characters of the column ``at``."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(at)), 0)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _digits(alphabet: np.ndarray) -> np.ndarray:
    """The digit of each code point, in their order; zero for those that aren't in the alphabet."""
    out = np.zeros(0x110000, np.int64)
    out[alphabet] = np.arange(1, len(alphabet) + 1)
    return out


def gram_counts(texts: list[str], digits: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the different grams of each text, by row and gram; none with a character of no digit."""
    span = base**n
    most = max(1, LARGEST // span)  # texts whose (row, gram) are one number
    found = []
    for begin in range(0, len(texts), most):
        part = texts[begin : begin + most]
        points = digits[_points(part)]
        m = len(points) - n + 1
        if m < 1:
            continue
        sizes = np.array([len(t) for t in part], np.int64)
        row = np.repeat(np.arange(len(part)), sizes)[:m]
        good = np.arange(n, n + m) <= np.cumsum(sizes)[row]
        gram = np.zeros(m, np.int64)
        for j in range(n):
            gram *= base
            gram += points[j : j + m]
            good &= points[j : j + m] > 0
        keys = np.sort((row * span + gram)[good])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.diff(np.r_[first, len(keys)])
        found.append((keys // span + begin, keys % span, counts))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _alphabet(batches):
    seen = np.zeros(0x110000, bool)
    for part in _pieces(batches, 0):
        seen[_points([t or "" for t in part.column(0).to_pylist()])] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["c"])


def _summed(gram: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
    return gram[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _statistics(alphabet: np.ndarray, n: int):
    """(country, gram, df, total) of what a task has seen."""

    def run(batches):
        digits, base = _digits(alphabet), len(alphabet) + 1
        held: dict[str, list] = {}

        def flush():
            for country, parts in held.items():
                gram, df, total = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([country] * len(gram), pa.string()), pa.array(gram), pa.array(df), pa.array(total)], ["country", "gram", "df", "total"])
            held.clear()

        waiting = 0
        for part in _pieces(batches, 1):
            countries = part.column(0).to_pylist()
            row, gram, count = gram_counts(part.column(1).to_pylist(), digits, base, n)
            names = sorted(set(countries))
            place = {c: i for i, c in enumerate(names)}
            number = np.array([place[c] for c in countries], np.int64)
            for i, country in enumerate(names):
                mine = number[row] == i
                held.setdefault(country, []).append(_summed(gram[mine], np.ones(int(mine.sum()), np.int64), count[mine]))
            waiting += len(gram)
            if waiting > 4 * HELD:
                held = {c: [_summed(*(np.concatenate(x) for x in zip(*p, strict=True)))] for c, p in held.items()}
                waiting = sum(len(p[0][0]) for p in held.values())
                if waiting > HELD:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return run


class _Known:
    """The grams of one country, read from the shared folder."""

    def __init__(self, path: str, country: str):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        store, at = FileSystem.from_uri(path)
        table = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["gram", "idf", "term"], filter=pc.field("country") == country)
        gram, idf, term = (np.asarray(table.column(c)) for c in ("gram", "idf", "term"))
        order = np.argsort(gram)
        self.gram, self.term = gram[order], term[order].astype(np.int64)
        self.idf = np.zeros(len(gram))
        self.idf[self.term] = idf[order]

    def vectors(self, texts: list[str], digits: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the known grams, by row."""
        row, gram, count = gram_counts(texts, digits, base, n)
        if not len(self.gram):
            return row[:0], row[:0], row[:0]
        place = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        hit = self.gram[place] == gram
        return row[hit], self.term[place[hit]], count[hit]

    def weights(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int, sublinear: bool) -> np.ndarray:
        raw = (np.log(count) + 1.0 if sublinear else count) * self.idf[term]
        return raw / np.sqrt(np.bincount(row, raw * raw, rows))[row]


TARGET = "g long, country string, source string, id string, terms binary, counts binary"


def _target_vectors(path: str, alphabet: np.ndarray, n: int):
    def run(batches):
        digits, base = _digits(alphabet), len(alphabet) + 1
        known, held = None, None
        for part in _pieces(batches, 4):
            countries = np.array(part.column(1).to_pylist(), object)
            edges = [0, *(np.flatnonzero(countries[1:] != countries[:-1]) + 1).tolist(), len(countries)]
            for begin, end in zip(edges, edges[1:], strict=False):
                rows = part.slice(begin, end - begin)
                if held != countries[begin]:
                    held, known = countries[begin], _Known(path, countries[begin])
                row, term, count = known.vectors(rows.column(4).to_pylist(), digits, base, n)
                some, first = np.unique(row, return_index=True)
                edge = np.r_[first, len(row)] * 4
                packed = [pa.array([x[a:b] for a, b in zip(edge.tolist(), edge.tolist()[1:], strict=False)], pa.binary()) for x in (term.astype("<i4").tobytes(), count.astype("<i4").tobytes())]
                kept = rows.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], *packed], ["g", "country", "source", "id", "terms", "counts"])

    return run


def _chunks(path: str, g: int, country: str, most: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(source, ids, row, term, count) of the country's targets in their order, at most ``most`` and about TERMS terms at once."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    store, at = FileSystem.from_uri(path)
    files = sorted(f.path for f in store.get_file_info(FileSelector(at)) if f.path.endswith(".parquet"))

    def unpacked(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        terms, counts = (table.column(c).to_pylist() for c in ("terms", "counts"))
        row = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
        term, count = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (terms, counts))
        return table.column("source")[0].as_py(), table.column("id").combine_chunks(), row, term, count

    held, rows, bytes_ = [], 0, 0
    for file in files:
        with store.open_input_file(file) as f:
            data = pq.ParquetFile(f)
            groups = []
            for i in range(data.num_row_groups):
                s = data.metadata.row_group(i).column(0).statistics
                if s is None or not s.has_min_max or s.min <= g <= s.max:
                    groups.append(i)
            for batch in data.iter_batches(512, row_groups=groups) if groups else ():
                batch = batch.filter(pc.and_(pc.equal(batch.column("g"), g), pc.equal(batch.column("country"), country)))
                if not batch.num_rows:
                    continue
                source = np.array(batch.column("source").to_pylist(), object)
                edges = [0, *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist(), len(source)]
                for begin, end in zip(edges, edges[1:], strict=False):
                    part = batch.slice(begin, end - begin)
                    if held and (held[0].column("source")[0].as_py() != source[begin] or rows + part.num_rows > most or bytes_ > 4 * TERMS):
                        yield unpacked(held)
                        held, rows, bytes_ = [], 0, 0
                    held.append(part)
                    rows += part.num_rows
                    bytes_ += part.column("terms").nbytes
    if held:
        yield unpacked(held)


class _Best:
    """The best ``k`` positive scores of each query, the greatest first, and the places of their targets."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.place = k, np.zeros((queries, k)), np.zeros((queries, k), np.int64)

    def add(self, low: int, scores: np.ndarray, offset: int) -> None:
        """Scores of the queries from ``low`` on with the targets from ``offset`` on, which come after all earlier ones."""
        k, (rows, wide) = self.k, scores.shape
        floor = self.score[low : low + rows, k - 1] + 0.4e-9  # what rounds to more than the last one
        over = scores > floor[:, None]
        if wide > k and np.count_nonzero(over) > 2 * k * rows:
            floor = np.maximum(floor, np.partition(scores, wide - k, axis=1)[:, wide - k] - 2e-9)
            over = scores > floor[:, None]
        i, j = np.nonzero(over)
        if not len(i):
            return
        some = np.flatnonzero(np.bincount(i, minlength=rows))
        mine = self.score[low + some]
        row = np.r_[np.repeat(some, k), i]
        score = np.r_[mine.ravel(), np.round(scores[i, j], 9)]
        place = np.r_[self.place[low + some].ravel(), j + offset]
        order = np.lexsort((place, -score, row))
        order = order[score[order] > 0]
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = rank < k
        self.score[low + some] = 0.0
        self.score[low + row[kept], rank[kept]] = score[order[kept]]
        self.place[low + row[kept], rank[kept]] = place[order[kept]]


def _matched(known_at: str, targets_at: str, alphabet: np.ndarray, n: int, k: int, sublinear: bool):
    """(q, t, score, rank) of the queries of a task."""

    def block(g: int, country: str, ids: list[pa.Array], owners: list[int], texts: list[str], digits, base):
        known = _Known(known_at, country)
        parts, rows = [], 0
        for some in _pieces([pa.record_batch([pa.array(texts, pa.string())], ["text"])], 0):
            row, term, count = known.vectors(some.column(0).to_pylist(), digits, base, n)
            parts.append((row + rows, term, count))
            rows += some.num_rows
        q_row, q_term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(q_row):
            return
        q_weight = known.weights(q_row, q_term, count, rows, sublinear)
        names, owner_of = pa.concat_arrays(ids), np.array(owners, np.int64)
        often = np.argsort(known.idf, kind="stable")[:COLUMNS]
        often = often[known.idf[often] < 1.0 - np.log(SHARE)]
        column = np.full(len(known.idf), -1)
        column[often] = np.arange(len(often))
        q_column = column[q_term]
        wide = int(min(TARGETS, max(512, DENSE // max(1, len(often)))))
        slab = max(1, PRODUCT // max(wide, len(often)))
        starts = np.searchsorted(q_row, np.arange(rows + 1))

        def finished(best: _Best, targets: list[pa.Array]):
            found = pa.concat_arrays(targets)
            step = max(1, (1 << 16) // k)
            for low in range(0, len(owner_of), step):
                mine = owner_of[low : low + step]
                score = best.score[mine]
                i, j = np.nonzero(score > 0)
                at = best.place[mine[i], j]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(low + i)), found.take(pa.array(at)), pa.array(score[i, j]), pa.array((j + 1).astype(np.int32))], ["q", "t", "score", "rank"])

        held, best, targets, offset = None, None, [], 0
        for source, t_ids, row, term, count in _chunks(targets_at, g, country, wide):
            if source != held:
                if best is not None:
                    yield from finished(best, targets)
                held, best, targets, offset = source, _Best(rows, k), [], 0
            size = len(t_ids)
            weight = known.weights(row, term, count, size, sublinear)
            t_column = column[term]
            dense = t_column >= 0
            matrix = np.zeros((size, len(often)))
            matrix[row[dense], t_column[dense]] = weight[dense]
            order = np.flatnonzero(~dense)
            order = order[np.argsort(term[order], kind="stable")]
            owner, t_weight = row[order], weight[order]
            first = np.r_[0, np.cumsum(np.bincount(term[order], minlength=len(known.idf)))]
            for low in range(0, rows, slab):
                high = min(rows, low + slab)
                at = np.arange(starts[low], starts[high])
                some = q_column[at] >= 0
                mine = np.zeros((high - low, len(often)))
                mine[q_row[at[some]] - low, q_column[at[some]]] = q_weight[at[some]]
                scores = mine @ matrix.T
                at = at[~some]
                sizes = first[q_term[at] + 1] - first[q_term[at]]
                at, sizes = at[sizes > 0], sizes[sizes > 0]
                upto = np.cumsum(sizes)
                begin = 0
                while begin < len(at):
                    before = upto[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(upto, before + EVENTS, side="right")))
                    here, much = at[begin:end], sizes[begin:end]
                    event = np.arange(upto[end - 1] - before) + np.repeat(first[q_term[here]] - (upto[begin:end] - before) + much, much)
                    cell = np.repeat((q_row[here] - low) * size, much) + owner[event]
                    scores += np.bincount(cell, np.repeat(q_weight[here], much) * t_weight[event], scores.size).reshape(scores.shape)
                    begin = end
                best.add(low, scores, offset)
            targets.append(t_ids)
            offset += size
        if best is not None:
            yield from finished(best, targets)

    def run(batches):
        digits, base = _digits(alphabet), len(alphabet) + 1
        held, ids, owners, texts, chars = None, [], [], {}, 0
        for part in _pieces(batches, 3):
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if held is not None and (keys[begin] != held or chars > 2 * BLOCK):
                    yield from block(*held, ids, owners, list(texts), digits, base)
                    ids, owners, texts, chars = [], [], {}, 0
                held = keys[begin]
                ids.append(part.column(2).slice(begin, end - begin))
                for text in part.column(3).slice(begin, end - begin).to_pylist():
                    if text not in texts:
                        chars += len(text)
                    owners.append(texts.setdefault(text, len(texts)))
        if held is not None:
            yield from block(*held, ids, owners, list(texts), digits, base)

    return run


def _chars(records: DataFrame, column: str) -> int:
    return records.agg(F.sum(F.length(column))).first()[0] or 0


def _spread(records: DataFrame) -> DataFrame:
    cores = records.sparkSession.sparkContext.defaultParallelism
    return records if records.rdd.getNumPartitions() >= cores else records.repartition(2 * cores, "entity_id")


def top_grams(
    queries: DataFrame, targets: DataFrame, fit: DataFrame, column: str, n: int, k: int, min_df: int = 2, max_features: int = 200_000, max_share: float = 1.0, sublinear: bool = False
) -> DataFrame | None:
    """(q, t, score, rank): cosine top ``k`` of each query and target source, or None where this way is not open.

    It needs the shared folder, one that Arrow can open too, and an alphabet whose grams are numbers of 62 bits.
    """
    spark = fit.sparkSession
    at = views.folder(spark)
    if at is None or not _opens(at):
        return None
    plain = lambda df, *more: df.filter((F.col(column) != "") & F.col("country").isNotNull()).select(*more, column)
    found = _spread(plain(fit, "entity_id")).select(column).mapInArrow(_alphabet, "c int").distinct().collect()
    alphabet = np.array(sorted(r["c"] for r in found), np.int64)
    if (len(alphabet) + 1) ** n >= LARGEST:
        return None
    at = f"{at}/grams-{uuid.uuid4().hex}"
    texts = plain(fit, "entity_id", "country")
    counts = _spread(texts).select("country", column).mapInArrow(_statistics(alphabet, n), "country string, gram long, df long, total long")
    stats = counts.groupBy("country", "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter(F.col("df") >= min_df)
    stats = stats.join(texts.groupBy("country").agg(F.count("*").alias("texts")), "country").filter(F.col("df") <= F.col("texts") * max_share)
    w = Window.partitionBy("country").orderBy(F.desc("total"), "gram")
    kept = stats.withColumn("term", F.row_number().over(w)).filter(F.col("term") <= max_features)
    idf = F.log((1.0 + F.col("texts")) / (1.0 + F.col("df"))) + 1.0
    kept.select("country", "gram", idf.alias("idf"), (F.col("term") - 1).alias("term")).write.parquet(f"{at}/known")
    cores, g = spark.sparkContext.defaultParallelism, F.xxhash64("country").alias("g")
    parts = max(cores, -(-_chars(targets, column) // BLOCK))
    rows = plain(targets, g, "country", F.left("entity_id", F.lit(2)).alias("source"), F.col("entity_id").alias("id")).filter(F.length(column) >= n)
    rows = rows.repartitionByRange(parts, "g", "country", "source", "id").sortWithinPartitions("g", "country", "source", "id")
    rows.mapInArrow(_target_vectors(f"{at}/known", alphabet, n), TARGET).write.option("compression", "zstd").parquet(f"{at}/targets")
    parts = max(2 * cores, -(-_chars(queries, column) // BLOCK))
    rows = plain(queries, g, "country", F.col("entity_id").alias("id")).filter(F.length(column) >= n)
    rows = rows.withColumn("h", F.xxhash64(column)).repartitionByRange(parts, "g", "h", "id").sortWithinPartitions("g", "country").drop("h")
    return rows.mapInArrow(_matched(f"{at}/known", f"{at}/targets", alphabet, n, k, sublinear), "q string, t string, score double, rank int")


def _opens(path: str) -> bool:
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True
