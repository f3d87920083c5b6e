"""Audits and profiles of record files: integrity, distributions, vocabulary, affixes, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions import text as T

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Texts that stand for a missing value, and script ranges.
MISSING = ("na", "n/a", "null", "none", "nan")
SCRIPTS = {
    "devanagari": r"[ऀ-ॿ]", "tamil": r"[஀-௿]", "cyrillic": r"[Ѐ-ӿ]",
    "cjk": r"[一-鿿]", "arabic": r"[؀-ۿ]",
}


def record_stats(records: DataFrame, prefixes: str = "^S[123]-") -> DataFrame:
    """Rows, distinct values, characters and ids with a bad prefix."""
    return records.agg(
        F.count("*").alias("n"), F.countDistinct("entity_id").alias("unique_ids"), F.countDistinct("business_name").alias("unique_names"),
        F.countDistinct("business_address").alias("unique_addresses"),
        F.sum(F.length("entity_id") + F.length("business_name") + F.length("business_address") + F.length("country")).alias("characters"),
        F.count_if(~F.col("entity_id").rlike(prefixes)).alias("invalid_prefixes"),
    )


def field_stats(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row per field: nulls, empties, blanks, missing markers, and the mean, range and quantiles of its length."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")
    size = F.length("v")
    return records.select(each).select("x.field", "x.v").groupBy("field").agg(
        F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == "").alias("empties"),
        F.count_if(F.trim("v") == "").alias("blanks"), F.count_if(F.lower(F.trim("v")).isin(*MISSING)).alias("markers"),
        F.avg(size).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"),
        F.percentile(size, F.array(*map(F.lit, QUANTILES))).alias("quantiles"),
    )


def duplicate_groups(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Groups of more than one row, rows beyond the first of each, and the largest group."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    return groups.agg(
        F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_rows"),
        F.coalesce(F.max("copies"), F.lit(0)).alias("largest_group"),
    )


def text_patterns(records: DataFrame) -> DataFrame:
    name, address = F.col("business_name"), F.col("business_address")
    both = F.concat(name, address)
    return records.agg(
        F.count_if(name.rlike(r"[^\x00-\x7F]")).alias("nonascii_name"), F.count_if(address.rlike(r"[^\x00-\x7F]")).alias("nonascii_address"),
        *[F.count_if(both.rlike(p)).alias(s) for s, p in SCRIPTS.items()],
        F.count_if(address.rlike(r"\b[0-9]{5}(-[0-9]{4})?\b")).alias("postal5_like"), F.count_if(address.rlike(r"\b[0-9]{6}\b")).alias("postal6_like"),
        F.count_if(name.rlike("[0-9]")).alias("name_with_digits"), F.count_if(address.rlike("[0-9]")).alias("address_with_digits"),
    )


def integrity(queries: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(check, n) of the truth: pairs, records with and without links, unknown ids on either side, repeated pairs, targets
    with several owners, pairs across countries, and targets that nobody has."""
    q = queries.select(F.col("entity_id").alias("source1_entity_id"), F.col("country").alias("qc"))
    t = targets.select(F.col("entity_id").alias("target_id"), F.col("country").alias("tc"))
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    linked = pairs.select("source1_entity_id").distinct()
    checks = [
        count(pairs, "positive_pairs"),
        count(q.join(linked, "source1_entity_id", "left_semi"), "linked_queries"),
        count(q.join(linked, "source1_entity_id", "left_anti"), "singletons"),
        count(pairs.join(q, "source1_entity_id", "left_anti"), "unknown_queries"),
        count(pairs.join(t, "target_id", "left_anti"), "unknown_targets"),
        count(pairs.groupBy("source1_entity_id", "target_id").count().filter("count > 1"), "duplicate_pairs"),
        count(pairs.groupBy("target_id").agg(F.countDistinct("source1_entity_id").alias("n")).filter("n > 1"), "shared_targets"),
        count(pairs.join(q, "source1_entity_id").join(t, "target_id").filter("qc <> tc"), "across_countries"),
        count(t.join(pairs, "target_id", "left_anti"), "free_targets"),
    ]
    return reduce(DataFrame.unionByName, checks)


def overlap(test: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of ``test`` whose id, and whose whole record, is in ``train``."""
    ids = test.join(train.select("entity_id"), "entity_id", "left_semi").agg(F.lit("shared_ids").alias("check"), F.count("*").alias("n"))
    keys = ["business_name", "business_address", "country"]
    rows = test.join(train.select(*keys), keys, "left_semi").agg(F.lit("shared_records").alias("check"), F.count("*").alias("n"))
    return ids.unionByName(rows)


def block_volume(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """How many pairs an equal-name block join has, and its largest block, without making the pairs."""
    count = lambda df, name: df.filter("n <> ''").groupBy("country", "n").agg(F.count("*").alias(name))
    product = F.col("c1") * F.col("c2")
    return count(queries, "c1").join(count(targets, "c2"), ["country", "n"]).agg(
        F.coalesce(F.sum(product), F.lit(0)).alias("pairs"), F.coalesce(F.max(product), F.lit(0)).alias("largest_block")
    )


def vocabulary(records: DataFrame, field: str) -> DataFrame:
    """(token, df, idf, first_df, last_df): how many records have a token at all, first and last."""
    rows = records.select(T.tokens(F.col(field)).alias("ts")).filter("size(ts) > 0")
    each = rows.select(
        F.explode(
            F.transform(
                F.array_distinct("ts"),
                lambda t: F.struct(t.alias("token"), (t == F.element_at("ts", 1)).cast("int").alias("f"), (t == F.element_at("ts", -1)).cast("int").alias("l")),
            )
        ).alias("x")
    )
    stats = each.groupBy(F.col("x.token").alias("token")).agg(F.count("*").alias("df"), F.sum("x.f").alias("first_df"), F.sum("x.l").alias("last_df"))
    total = rows.agg(F.count("*").alias("total"))
    idf = F.log((F.col("total") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return stats.join(F.broadcast(total)).select("token", "df", "first_df", "last_df", idf.alias("idf"))


def df_bucket(df: Column) -> Column:
    out = F.when(df == 1, "1").when(df == 2, "2").when(df <= 5, "3-5").when(df <= 10, "6-10").when(df <= 100, "11-100")
    return out.when(df <= 1000, "101-1000").otherwise("1001+")


def top_affixes(records: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most frequent first and last tokens of names by country; ties by token."""
    ts = T.tokens(F.col("n"))
    ends = F.explode(F.array(F.struct(F.lit("first").alias("side"), F.element_at("ts", 1).alias("affix")), F.struct(F.lit("last").alias("side"), F.element_at("ts", -1).alias("affix"))))
    counted = records.select("country", ts.alias("ts")).filter("size(ts) > 0").select("country", ends.alias("x"))
    counted = counted.groupBy("country", "x.side", "x.affix").agg(F.count("*").alias("n"))
    w = Window.partitionBy("country", "side").orderBy(F.desc("n"), "affix")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pair_rates(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Flags of each linked pair: equal fields, shared numbers and postal codes, acronyms, accents, missing addresses, name Jaccard."""
    s = queries.select(F.col("entity_id").alias("source1_entity_id"), "country", F.col("n").alias("sn"), F.col("a").alias("sa"))
    t = targets.select(F.col("entity_id").alias("target_id"), F.col("n").alias("tn"), F.col("a").alias("ta"))
    rows = pairs.join(s, "source1_entity_id").join(t, "target_id")
    sn, sa, tn, ta = (F.col(c) for c in ("sn", "sa", "tn", "ta"))
    return rows.select(
        "source1_entity_id", "target_id", "country", ((sn == tn) & (sn != "")).alias("exact_name"), ((sa == ta) & (sa != "")).alias("exact_address"),
        F.arrays_overlap(T.numbers(sa), T.numbers(ta)).alias("numeric_overlap"),
        ((F.size(T.numbers(sa)) > 0) & (F.size(T.numbers(ta)) > 0)).alias("numeric_both"),
        F.arrays_overlap(T.postal_codes(sa), T.postal_codes(ta)).alias("postal_overlap"),
        ((T.acronym(sn) == T.acronym(tn)) & (F.length(T.acronym(sn)) > 1)).alias("acronym_equal"),
        ((T.strip_accents(sn) == T.strip_accents(tn)) & (sn != "")).alias("accent_fold_equal"),
        tn.rlike(r"[^\x00-\x7F]").alias("nonascii_target"), ((sa == "") | (ta == "")).alias("missing_address"),
        T.jaccard(F.split(sn, " "), F.split(tn, " ")).alias("name_jaccard"), T.jaccard(F.split(sa, " "), F.split(ta, " ")).alias("address_jaccard"),
    )
