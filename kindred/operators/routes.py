"""Candidate routes: exact, rare token, numeric, character TF-IDF, key blocks, dense; ranks, fusion and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions import text as T
from kindred.operators import grams as GRAMS
from kindred.operators import kernel as KERNEL

ROUTE = ("source1_entity_id", "target_id", "route", "route_score")


def exact(queries: DataFrame, targets: DataFrame, fields: tuple[str, ...], name: str) -> DataFrame:
    """Pairs of one country with equal, non-blank fields."""
    keep = reduce(lambda a, b: a & b, [F.col(f) != "" for f in fields])
    q = queries.filter(keep).select(F.col("entity_id").alias("source1_entity_id"), "country", *fields)
    t = targets.filter(keep).select(F.col("entity_id").alias("target_id"), "country", *fields)
    return q.join(t, ["country", *fields]).select("source1_entity_id", "target_id", F.lit(name).alias("route"), F.lit(1.0).alias("route_score"))


def first_exact(queries: DataFrame, targets: DataFrame, field: str, name: str, k: int = 100) -> DataFrame:
    """Pairs of one country with an equal, non-blank field: the first ``k`` targets by id of each source.

    All scores are one and ties go by id, so these are the pairs that a cut of the ranked route at ``k`` keeps; a value
    that many targets share is cut before the join. The join compares hashes, and then the values.
    """
    key = F.xxhash64("country", field)
    w = Window.partitionBy("key", "country", field, F.left("entity_id", F.lit(2))).orderBy("entity_id")
    t = targets.filter(F.col(field) != "").select("entity_id", "country", field, key.alias("key"))
    t = t.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    t = t.select(F.col("entity_id").alias("target_id"), F.col("country").alias("tc"), F.col(field).alias("tv"), "key")
    q = queries.filter(F.col(field) != "").select(F.col("entity_id").alias("source1_entity_id"), F.col("country").alias("qc"), F.col(field).alias("qv"), key.alias("key"))
    same = q.join(t, "key").filter((F.col("qc") == F.col("tc")) & (F.col("qv") == F.col("tv")))
    return same.select("source1_entity_id", "target_id", F.lit(name).alias("route"), F.lit(1.0).alias("route_score"))


def token_table(records: DataFrame) -> DataFrame:
    """(entity_id, country, field, token): distinct tokens of three characters or more with a letter."""
    both = F.explode(
        F.concat(
            F.transform(T.word_tokens(F.col("n")), lambda t: F.struct(F.lit("name").alias("field"), t.alias("token"))),
            F.transform(T.word_tokens(F.col("a")), lambda t: F.struct(F.lit("address").alias("field"), t.alias("token"))),
        )
    )
    return records.select("entity_id", "country", both.alias("x")).select("entity_id", "country", "x.field", "x.token")


def token_stats(tokens: DataFrame, owners: DataFrame, train: tuple[int, ...] = (-1, 1, 2, 3)) -> DataFrame:
    """(country, field, token, full_df, train_df): how many targets have a token, and how many that training may see."""
    owned = tokens.join(owners.select(F.col("target_id").alias("entity_id"), "owner_fold"), "entity_id")
    return owned.groupBy("country", "field", "token").agg(
        F.count("*").alias("full_df"), F.count_if(F.col("owner_fold").isin(*train)).alias("train_df")
    )


def rare_keys(query_tokens: DataFrame, stats: DataFrame, max_df: int = 1000, keys: int = 3) -> DataFrame:
    """The rarest ``keys`` tokens of each query record and field among those that at most ``max_df`` targets have."""
    w = Window.partitionBy("entity_id", "field").orderBy("train_df", "full_df", "token")
    known = query_tokens.join(stats, ["country", "field", "token"]).filter(F.col("full_df").between(1, max_df))
    return known.withColumn("key_rank", F.row_number().over(w)).filter(F.col("key_rank") <= keys)


def rare_hits(keys: DataFrame, target_tokens: DataFrame) -> DataFrame:
    """(source1_entity_id, target_id, field, shared_tokens, rarity_score) by an inverted index join."""
    postings = target_tokens.select("country", "field", "token", F.col("entity_id").alias("target_id"))
    return (
        keys.select(F.col("entity_id").alias("source1_entity_id"), "country", "field", "token", "train_df")
        .join(postings, ["country", "field", "token"])
        .groupBy("source1_entity_id", "target_id", "field")
        .agg(F.count("*").alias("shared_tokens"), F.sum(1.0 / (F.col("train_df") + 1)).alias("rarity_score"))
    )


def rare_routes(hits: DataFrame) -> DataFrame:
    score = F.col("shared_tokens") + F.least("rarity_score", F.lit(0.99))
    return hits.select("source1_entity_id", "target_id", F.concat(F.lit("rare_"), "field").alias("route"), score.alias("route_score"))


def numeric_route(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Rare-name hits whose addresses share a run of digits."""
    digits = lambda df, key: df.select(F.col("entity_id").alias(key), T.numbers(F.col("a")).alias(f"{key}_numbers"))
    rows = hits.filter("field = 'name'").join(digits(queries, "source1_entity_id"), "source1_entity_id")
    rows = rows.join(digits(targets, "target_id"), "target_id").filter(F.arrays_overlap("source1_entity_id_numbers", "target_id_numbers"))
    return rare_routes(rows).withColumn("route", F.lit("numeric_name"))


def rank_routes(routes: DataFrame, k: int = 100) -> DataFrame:
    """The best ``k`` of each query record, route and target source; ties by target id.

    Scores are rounded to nine digits before they are compared, so that the order of additions makes no difference.
    """
    w = Window.partitionBy("source1_entity_id", "route", F.left("target_id", F.lit(2))).orderBy(F.desc(F.round("route_score", 9)), "target_id")
    return routes.withColumn("route_rank", F.row_number().over(w)).filter(F.col("route_rank") <= k)


def fuse(ranked: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion with the routes of each pair and its rank within the query record, by scores of twelve digits."""
    pairs = ranked.groupBy("source1_entity_id", "target_id").agg(
        F.sum(1.0 / (F.col("route_rank") + constant)).alias("fusion_score"),
        F.array_join(F.array_sort(F.collect_list("route")), ",").alias("routes"),
        F.min("route_rank").alias("best_route_rank"),
    )
    w = Window.partitionBy("source1_entity_id").orderBy(F.desc(F.round("fusion_score", 12)), "target_id")
    return pairs.withColumn("candidate_rank", F.row_number().over(w))


def token_candidates(queries: DataFrame, targets: DataFrame, owners: DataFrame, max_df: int = 1000, keys: int = 3, k: int = 100) -> DataFrame:
    """All token routes of all query records, ranked (before fusion)."""
    target_tokens = token_table(targets)
    query_tokens = token_table(queries)
    selected = rare_keys(query_tokens, token_stats(target_tokens, owners), max_df, keys)
    hits = rare_hits(selected, target_tokens)
    routes = [
        first_exact(queries, targets, "n", "exact_name", k), first_exact(queries, targets, "a", "exact_address", k), rare_routes(hits),
        numeric_route(hits, queries, targets),
    ]
    return rank_routes(reduce(DataFrame.unionByName, [r.select(*ROUTE) for r in routes]), k)


def grams(text: Column, n: int, analyzer: str = "char") -> Column:
    """Terms of a text, repeats included: n-grams of characters, of words padded with spaces (char_wb), or n-grams of words."""
    if analyzer == "char":
        return T.char_grams(text, n)
    if analyzer == "word":
        ts = T.tokens(text)
        runs = F.transform(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: F.array_join(F.slice(ts, i, n), " "))
        return F.when(F.size(ts) >= n, runs).otherwise(F.array().cast("array<string>"))
    if analyzer != "char_wb":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    padded = F.transform(T.tokens(text), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda t: F.when(F.length(t) >= n, T.char_grams(t, n)).otherwise(F.array(t))))


#: Characters of texts whose grams one task counts; rows of n-gram statistics that are sent to every executor.
COUNTED, SENT = 1 << 21, 1_000_000


def _by_record(records: DataFrame, column: str, parts: int | None) -> DataFrame:
    """Whole records dealt out by id, so that their grams are counted and gathered where the text lies."""
    rows = records.select("entity_id", "country", column)
    return rows.repartition(parts, "entity_id") if parts else rows.repartition("entity_id")


def _parts(records: DataFrame, column: str) -> int:
    chars = records.agg(F.sum(F.length(column))).first()[0] or 0
    return max(records.sparkSession.sparkContext.defaultParallelism, -(-chars // COUNTED))


def gram_vectors(records: DataFrame, column: str, n: int, idf: DataFrame, analyzer: str = "char", sublinear: bool = False, parts: int | None = None) -> DataFrame:
    """(id, country, terms, weights): TF-IDF with unit length for each record that has a known gram; terms are numbers."""
    counts = (
        _by_record(records, column, parts).select("entity_id", "country", F.explode(grams(F.col(column), n, analyzer)).alias("gram"))
        .groupBy("entity_id", "country", "gram")
        .agg(F.count("*").alias("tf"))
    )
    tf = F.log(F.col("tf")) + 1.0 if sublinear else F.col("tf")
    raw = counts.join(idf, ["country", "gram"]).withColumn("w", tf * F.col("idf"))
    rows = raw.groupBy("entity_id", "country").agg(F.collect_list(F.struct("term", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select(
        F.col("entity_id").alias("id"), "country", F.left("entity_id", F.lit(2)).alias("source"), F.col("x.term").alias("terms"),
        F.transform("x.w", lambda v: v / F.col("norm")).alias("weights"),
    )


def gram_idf(records: DataFrame, column: str, n: int, min_df: int = 2, max_features: int = 200_000, analyzer: str = "char", max_share: float = 1.0, parts: int | None = None) -> DataFrame:
    """(country, gram, idf, term), smooth, of each country's ``max_features`` grams with the most occurrences; ties by gram.

    Grams of fewer than ``min_df`` texts or of more than ``max_share`` of them are none. ``term`` numbers a country's grams.
    """
    texts = records.filter(F.col(column) != "")
    found = _by_record(texts, column, parts).select("entity_id", "country", F.explode(grams(F.col(column), n, analyzer)).alias("gram"))
    per_text = found.groupBy("country", "gram", "entity_id").agg(F.count("*").alias("tf"))
    stats = per_text.groupBy("country", "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    sizes = texts.groupBy("country").agg(F.count("*").alias("texts"))
    stats = stats.join(sizes, "country").filter(F.col("df") <= F.col("texts") * max_share)
    w = Window.partitionBy("country").orderBy(F.desc("total"), "gram")
    kept = stats.withColumn("term", F.row_number().over(w)).filter(F.col("term") <= max_features)
    idf = F.log((1.0 + F.col("texts")) / (1.0 + F.col("df"))) + 1.0
    return kept.select("country", "gram", idf.alias("idf"), F.col("term").cast("long").alias("term"))


def _routed(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.col("q").alias("source1_entity_id"), F.col("t").alias("target_id"), F.lit(name).alias("route"), F.col("score").alias("route_score"), F.col("rank").alias("route_rank"))


def gram_route(
    queries: DataFrame, targets: DataFrame, fit: DataFrame, column: str = "n", n: int = 3, k: int = 100, name: str = "name_char3", min_df: int = 2,
    min_score: float = 0.0, analyzer: str = "char", sublinear: bool = False, max_share: float = 1.0, sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Cosine top ``k`` for each query record and target source, positive scores of ``min_score`` or more, by blocks.

    Characters go by ``grams.top_grams`` where it is open; ``sizes`` asks for blocks of both sides.
    """
    found = GRAMS.top_grams(queries, targets, fit, column, n, k, min_df, max_share=max_share, sublinear=sublinear) if analyzer == "char" and not sizes else None
    if found is not None:
        return _routed(found.filter(F.col("score") >= min_score), name)
    parts = _parts(fit, column), _parts(queries, column), _parts(targets, column)
    idf = gram_idf(fit, column, n, min_df, analyzer=analyzer, max_share=max_share, parts=parts[0]).persist(StorageLevel.DISK_ONLY)
    if idf.count() <= SENT:
        idf = F.broadcast(idf)
    q, t = (gram_vectors(r, column, n, idf, analyzer, sublinear, p) for r, p in ((queries, parts[1]), (targets, parts[2])))
    blocks = None if sizes else tuple(KERNEL.term_blocks(r, "country", F.length(column), r is queries) for r in (queries, targets))
    found = KERNEL.top_products(q.drop("source"), t, "country", KERNEL.sparse, k, sizes, blocks).filter(F.col("score") >= min_score)
    return _routed(found, name)


def index_route(queries: DataFrame, vectors: DataFrame, idf: DataFrame, column: str = "n", n: int = 3, k: int = 100, name: str = "name_char3") -> DataFrame:
    """The n-gram route over a written index (vectors, terms) of the targets."""
    q = gram_vectors(queries, column, n, idf).drop("source")
    found = KERNEL.top_products(q, vectors, "country", KERNEL.sparse, k)
    return _routed(found, name)


def key_blocks(queries: DataFrame, targets: DataFrame, key: Column, cap: int = 20) -> DataFrame:
    """Pairs of one country and key, if at most ``cap`` targets have it, with both block sizes."""
    sized = lambda df, role, n: df.withColumn("key", key).filter("key <> ''").withColumn(
        n, F.count("*").over(Window.partitionBy("country", "key"))
    ).select(F.col("entity_id").alias(role), "country", "key", n)
    t = sized(targets, "target_id", "block_targets").filter(F.col("block_targets") <= cap)
    return sized(queries, "source1_entity_id", "block_queries").join(t, ["country", "key"])


def dense_route(queries: DataFrame, targets: DataFrame, k: int = 20, group: str = "label", sizes: tuple[int, int] = (KERNEL.QUERIES, KERNEL.TARGETS)) -> DataFrame:
    """(q, t, score, rank): top ``k`` by positive cosine within a group, never of a row with itself, by blocks."""
    side = lambda df: df.select(F.col("vec_id").alias("id"), group, F.col("embedding").alias("vector"))
    return KERNEL.top_products(side(queries), side(targets).withColumn("source", F.lit("")), group, KERNEL.dense, k, sizes)


def sorted_neighbours(records: DataFrame, ranges: int = 64) -> DataFrame:
    """Each record with the one before it in its country by (n, a, entity_id).

    Records are sorted in at most ``ranges`` ranges of (country, first 100 characters of n), cut at values of a sample, and
    the last record of a range is handed to the next one. Records that agree in all of these meet in one range.
    """
    key = F.struct("country", F.left("n", F.lit(100)).alias("n"))
    sample = records.select(key.alias("k")).orderBy(F.xxhash64("entity_id")).limit(ranges * 20).select("k.*").distinct().orderBy("country", "n").collect()
    cuts = sample[:: max(1, -(-len(sample) // ranges))]
    above = [F.struct(F.lit(r["country"]).alias("country"), F.lit(r["n"]).alias("n")) <= key for r in cuts]
    rows = records.withColumn("range", sum((c.cast("int") for c in above), F.lit(0)))
    order = ["country", "n", "a", "entity_id"]
    w = Window.partitionBy("range").orderBy(*order)
    prior = rows.withColumn("prior", F.lag(F.struct(*order)).over(w))
    ends = rows.groupBy("range").agg(F.max(F.struct(*order)).alias("end"))  # one row for each range
    handed = ends.select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    joined = prior.join(F.broadcast(handed), "range").withColumn("prior", F.coalesce("prior", "handed"))
    prev = F.when(F.col("prior.country") == F.col("country"), F.col("prior"))
    return joined.select(*records.columns, prev["n"].alias("prev_n"), prev["a"].alias("prev_a"), prev["entity_id"].alias("prev_id"))


def evaluate(candidates: DataFrame, folds: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per query record: candidates, links found, links in all, any and all found, and the best F0.5 they allow."""
    flagged = candidates.select("source1_entity_id", "target_id").distinct().join(pairs.withColumn("hit", F.lit(1)), ["source1_entity_id", "target_id"], "left")
    counted = flagged.groupBy("source1_entity_id").agg(F.count("*").alias("candidates"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    rows = folds.join(counted, "source1_entity_id", "left").fillna(0, ["candidates", "found"])
    best = F.when(F.col("n_matches") == 0, 1.0).otherwise(1.25 * F.col("found") / (F.col("found") + 0.25 * F.col("n_matches")))
    return rows.select(
        "source1_entity_id", "country", "fold", "n_matches", "candidates", "found",
        (F.col("found") > 0).alias("any_found"), (F.col("found") == F.col("n_matches")).alias("all_found"), best.alias("oracle_f05"),
    )


def leave_one_out(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each route: links only it finds and links found without it."""
    hits = ranked.join(pairs, ["source1_entity_id", "target_id"], "left_semi").select("source1_entity_id", "target_id", "route").distinct()
    n = F.count("*").over(Window.partitionBy("source1_entity_id", "target_id"))
    total = hits.select("source1_entity_id", "target_id").distinct().agg(F.count("*").alias("all_links"))
    by_route = hits.withColumn("n", n).groupBy("route").agg(F.count("*").alias("links"), F.count_if(F.col("n") == 1).alias("only_here"))
    return by_route.join(F.broadcast(total)).select("route", "links", "only_here", (F.col("all_links") - F.col("only_here")).alias("links_without"))
