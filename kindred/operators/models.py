"""Pair features, fitting masks and weights, out-of-fold scoring, calibration and record-linkage EM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions import similarity as S
from kindred.functions import text as T


def relate_numbers(a: Column, b: Column) -> dict[str, Column]:
    """Overlap, conflict (both have some, none shared), Jaccard and relation of the first runs of digits."""
    x, y = T.numbers(a), T.numbers(b)
    shared, both = F.size(F.array_intersect(x, y)), (F.size(x) > 0) & (F.size(y) > 0)
    first = lambda c: F.regexp_extract(c, "([0-9]+)", 1)
    known = (first(a) != "") & (first(b) != "")
    return {
        "numeric_overlap": (shared > 0).cast("float"), "numeric_conflict": (both & (shared == 0)).cast("float"),
        "numeric_jaccard": F.coalesce(T.jaccard(x, y), F.lit(0.0)).cast("float"),
        "first_number_equal": (known & (first(a) == first(b))).cast("float"), "first_number_conflict": (known & (first(a) != first(b))).cast("float"),
    }


def canonical_relation(a: Column, b: Column) -> dict[str, Column]:
    """The same over canonical numbers, and whether only leading zeros or scripts kept the raw ones apart."""
    x, y = T.canonical_numbers(a), T.canonical_numbers(b)
    shared, both = F.size(F.array_intersect(x, y)), (F.size(x) > 0) & (F.size(y) > 0)
    raw = F.arrays_overlap(T.numbers(a), T.numbers(b))
    return {
        "canonical_overlap": (shared > 0).cast("float"), "canonical_conflict": (both & (shared == 0)).cast("float"),
        "canonical_jaccard": F.coalesce(T.jaccard(x, y), F.lit(0.0)).cast("float"), "canonical_rescue": ((shared > 0) & ~raw).cast("float"),
    }


def transliterated(text: Column, spellings: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the spelling of each text from (n, spelling), the text itself if it is ASCII. A miss raises."""
    joined = rows.withColumn("_t", text).join(spellings.select(F.col("n").alias("_t"), F.col("spelling").alias("_s")), "_t", "left")
    plain = ~F.col("_t").rlike(r"[^\x00-\x7F]")
    missing = F.raise_error(F.concat(F.lit("no spelling of "), "_t")).cast("string")
    return joined.withColumn(name, F.when(plain, F.col("_t")).when(F.col("_s").isNotNull(), F.col("_s")).otherwise(missing)).drop("_t", "_s")


def set_sides(records: DataFrame) -> DataFrame:
    """(entity_id, words, chars, numbers, no_address): all that set features need of records (entity_id, n, a).

    Distinct words of the name and distinct numbers of the address are space-joined, which is little beside the texts.
    """
    return records.select(
        "entity_id", F.array_join(F.array_distinct(T.tokens(F.col("n"))), " ").alias("words"), F.length("n").alias("chars"),
        F.array_join(F.array_distinct(T.numbers(F.col("a"))), " ").alias("numbers"), (F.col("a") == "").alias("no_address"),
    )


def set_features(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(source1_entity_id, target_id, 5 features) of pairs of these ids, from the :func:`set_sides` of both; no text goes to its pairs."""
    side = lambda rows, key, x: rows.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "entity_id"])
    rows = pairs.select("source1_entity_id", "target_id").join(side(queries, "source1_entity_id", "q"), "source1_entity_id").join(side(targets, "target_id", "t"), "target_id")
    x, y, u, v = (T.tokens(F.col(c)) for c in ("q_words", "t_words", "q_numbers", "t_numbers"))
    least, most = F.least("q_chars", "t_chars"), F.greatest("q_chars", "t_chars")
    both = F.size(F.array_intersect(x, y))
    some = lambda v: F.when(least == 0, 0.0).otherwise(v)
    none = F.lit(0)
    return rows.select(
        "source1_entity_id", "target_id", some(2.0 * both / F.nullif(F.size(x) + F.size(y), none)).alias("name_dice"),
        some(both / F.nullif(F.least(F.size(x), F.size(y)), none)).alias("name_containment"), some(least / F.nullif(most, none)).alias("name_length_ratio"),
        F.col("q_no_address").cast("int").alias("query_address_missing"), F.arrays_overlap(u, v).cast("int").alias("numeric_overlap"),
    )


def pair_features(pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, target_id, 40 floats) of pairs with columns sn, sa, tn, ta, sc, tc.

    Text features of names and addresses, their product, numbers, missing addresses, country and source. Distinct
    texts are compared once in an Arrow batch.
    """
    sn, sa, tn, ta = (F.col(c) for c in ("sn", "sa", "tn", "ta"))
    rows = pairs.withColumns({"nf": S.text_features_column(sn, tn), "af": S.text_features_column(sa, ta)})
    out = [F.col(f"nf.{f}").cast("float").alias(f"name_{f}") for f in S.FEATURES] + [F.col(f"af.{f}").cast("float").alias(f"address_{f}") for f in S.FEATURES]
    more = {
        "name_address_product": (F.col("nf.jaro_winkler") * F.col("af.jaro_winkler")).cast("float"),
        "query_address_missing": (sa == "").cast("float"), "target_address_missing": (ta == "").cast("float"),
        "country_equal": (F.col("sc") == F.col("tc")).cast("float"), "target_is_s2": F.col("target_id").startswith("S2-").cast("float"),
    } | relate_numbers(sa, ta) | canonical_relation(sa, ta)
    return rows.select("source1_entity_id", "target_id", *out, *[c.alias(k) for k, c in more.items()])


def fit_rows(rows: DataFrame, allowed: Sequence[int]) -> DataFrame:
    """Rows that a fit on ``allowed`` folds may see: of their query records, with targets that they or nobody owns."""
    return rows.filter(F.col("fold").isin(*allowed) & F.col("owner_fold").isin(-1, *allowed))


def country_weights(queries: DataFrame, allowed: Sequence[int]) -> DataFrame:
    """(country, weight): N / (countries * n) over the allowed folds, so that countries weigh the same."""
    counts = queries.filter(F.col("fold").isin(*allowed)).groupBy("country").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select("country", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def owned_negative_weight(rows: DataFrame, allowed: Sequence[int], folds: int = 5) -> Column:
    """Inverse probability weight: negatives with an owner are seen in ``allowed`` of ``folds`` folds only."""
    return F.when((F.col("label") == 0) & (F.col("owner_fold") >= 0), folds / len(allowed)).otherwise(1.0)


def reliability(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate, brier) by score; one is in the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier")
    )


def rank_auc(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve with ties at half, from counts by distinct score; no global row order is needed."""
    by_score = rows.groupBy(p).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    # distinct scores, ranged over a coarse bucket first so that the running sum is local to it
    bucket = F.floor(F.col(p) * 1000)
    coarse = by_score.groupBy(bucket.alias("b")).agg(F.sum("neg").alias("bneg"))
    before = coarse.select("b", F.coalesce(F.sum("bneg").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    w = Window.partitionBy("b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    local = by_score.withColumn("b", bucket).withColumn("inside", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(before, "b")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2.0))
    return local.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def _curve(rows: DataFrame, p: str, y: str, falling: bool, steps: int = 1000) -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg): running counts by distinct score, summed in ``steps`` buckets and between them."""
    by_score = rows.groupBy(F.col(p).alias("score")).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    by_score = by_score.withColumn("b", F.floor(F.col("score") * steps))
    order = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    ahead = Window.orderBy(order("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    coarse = by_score.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    coarse = coarse.select("b", F.coalesce(F.sum("bp").over(ahead), F.lit(0.0)).alias("before_pos"), F.coalesce(F.sum("bn").over(ahead), F.lit(0.0)).alias("before_neg"))
    w = Window.partitionBy("b").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, 0)
    held = by_score.withColumns({"cp": F.sum("pos").over(w), "cn": F.sum("neg").over(w)}).join(coarse, "b")
    return held.select("score", "pos", "neg", (F.col("before_pos") + F.col("cp")).alias("cum_pos"), (F.col("before_neg") + F.col("cn")).alias("cum_neg"))


def ks_statistic(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """The greatest distance between the distributions of the scores of both classes."""
    curve = _curve(rows, p, y, False)
    total = curve.agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    return curve.join(F.broadcast(total)).agg(F.max(F.abs(F.col("cum_pos") / F.nullif("tp", F.lit(0.0)) - F.col("cum_neg") / F.nullif("tn", F.lit(0.0)))).alias("ks"))


def average_precision(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Precision at each distinct score, weighted by the share of positives that it adds."""
    curve = _curve(rows, p, y, True)
    return curve.agg((F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("ap"))


def fellegi_sunter(rows: DataFrame, features: Sequence[str], iterations: int = 60, start: float = 0.15, smooth: float = 1e-3) -> DataFrame:
    """(pattern columns, n, match_probability): EM over the counts of agreement patterns.

    ``features`` are small integers from 0. Patterns are counted once in Spark; their number is bounded by the product of
    the levels, not by the pairs, and the iterations run over them on the driver.
    """
    import numpy as np

    counted = rows.groupBy(*features).agg(F.count("*").alias("n")).orderBy(*features)
    table = counted.toPandas()
    x, n = table[list(features)].to_numpy(np.int64), table["n"].to_numpy(float)
    levels = [int(x[:, j].max()) + 1 if len(x) else 1 for j in range(x.shape[1])]
    share = start
    up = [np.linspace(1, 3, k) / np.linspace(1, 3, k).sum() for k in levels]
    down = [v[::-1].copy() for v in up]
    g = np.zeros(len(x))
    for _ in range(iterations if len(x) else 0):
        odds = np.log(share / (1 - share)) + sum(np.log(up[j][x[:, j]] / down[j][x[:, j]]) for j in range(len(levels)))
        g = 1 / (1 + np.exp(-odds))
        share = float(np.clip((g * n).sum() / n.sum(), 1e-9, 1 - 1e-9))
        for probabilities, weight in ((up, g * n), (down, (1 - g) * n)):
            for j, k in enumerate(levels):
                mass = np.bincount(x[:, j], weights=weight, minlength=k) + smooth
                probabilities[j] = mass / mass.sum()
    table["match_probability"] = g
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    return rows.sparkSession.createDataFrame(table, f"{kinds}, match_probability double")


def out_of_fold(rows: DataFrame, features: Sequence[str], folds: Sequence[int], iterations: int = 10, seed: int = 7) -> DataFrame:
    """Scores of every fold by boosted trees fitted on the other folds, owner-safe: keys, fold, label and p."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(rows)
    parts = []
    for held in folds:
        model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=iterations, maxDepth=4, seed=seed).fit(fit_rows(made, [f for f in folds if f != held]))
        scored = model.transform(made.filter(F.col("fold") == held))
        parts.append(scored.select("source1_entity_id", "target_id", "fold", "label", vector_to_array("probability")[1].alias("p")))
    return reduce(DataFrame.unionByName, parts)


def platt(rows: DataFrame, p: str = "p", y: str = "label") -> Callable[[DataFrame], DataFrame]:
    """A logistic calibration of the clipped log odds, as a function that adds ``calibrated``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    assemble = VectorAssembler(inputCols=["_logit"], outputCol="_logits")
    prepare = lambda df: assemble.transform(df.withColumn("_logit", F.log(clipped / (1 - clipped))))
    model = LogisticRegression(featuresCol="_logits", labelCol=y).fit(prepare(rows))
    return lambda df: model.transform(prepare(df)).withColumn("calibrated", vector_to_array("probability")[1]).drop("_logits", "_logit", "rawPrediction", "probability", "prediction")


def isotonic(rows: DataFrame, p: str = "p", y: str = "label") -> Callable[[DataFrame], DataFrame]:
    """A monotone calibration of the scores, as a function that adds ``calibrated``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    assemble = VectorAssembler(inputCols=[p], outputCol="_score")
    model = IsotonicRegression(featuresCol="_score", labelCol=y, predictionCol="calibrated").fit(assemble.transform(rows.withColumn(y, F.col(y).cast("double"))))
    return lambda df: model.transform(assemble.transform(df)).drop("_score")


def stacked(rows: DataFrame, p: str = "p", label: str = "label", extra: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A logistic stacker over the log odds of a score, its rank and gap in the record and ``extra`` columns, as a function that adds ``stacked``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w = Window.partitionBy("source1_entity_id")
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    assemble = VectorAssembler(inputCols=["_logit", "_rank", "_gap", *extra], outputCol="_stack", handleInvalid="keep")

    def prepared(df: DataFrame) -> DataFrame:
        made = {"_logit": F.log(clipped / (1 - clipped)), "_rank": F.row_number().over(w.orderBy(F.desc(p), "target_id")).cast("double"), "_gap": F.max(p).over(w) - F.col(p)}
        return assemble.transform(df.withColumns(made))

    model = LogisticRegression(featuresCol="_stack", labelCol=label, regParam=0.01).fit(prepared(rows))
    drop = ("_stack", "_logit", "_rank", "_gap", "rawPrediction", "probability", "prediction")
    return lambda df: model.transform(prepared(df)).withColumn("stacked", vector_to_array("probability")[1]).drop(*drop)


def nested_out_of_fold(rows: DataFrame, features: Sequence[str], folds: Sequence[int], queries: DataFrame, iterations: int = 10) -> DataFrame:
    """(fold, threshold, macro_f05) of each outer fold, with a threshold that was chosen on inner folds only.

    The other folds score each other out of fold; the threshold with the best macro F0.5 over them, the higher one of a
    tie, is applied to the outer fold, which a model of all the others scores. ``queries`` has q, fold and actual.
    """
    from kindred.operators import decisions as D

    as_claims = lambda df: df.select(F.col("source1_entity_id").alias("q"), F.col("target_id").alias("t"), "p", F.col("label").alias("y"))
    out = []
    for outer in folds:
        inner = [f for f in folds if f != outer]
        scores = out_of_fold(fit_rows(rows, inner), features, inner, iterations)
        best = D.best_threshold(D.threshold_sweep(as_claims(scores), queries.filter(F.col("fold").isin(*inner)).select("q", "actual"))).first()
        held = out_of_fold(rows, features, [outer, *inner], iterations).filter(F.col("fold") == outer)
        chosen = as_claims(held.filter(F.col("p") >= best["threshold"]))
        found = chosen.groupBy("q").agg(F.count("*").alias("predicted"), F.sum("y").alias("tp"))
        scored = queries.filter(F.col("fold") == outer).join(found, "q", "left").fillna(0, ["predicted", "tp"])
        macro = F.avg(D.f05(F.col("tp"), F.col("predicted"), F.col("actual"))).alias("macro_f05")
        out.append(scored.agg(macro).select(F.lit(outer).alias("fold"), F.lit(best["threshold"]).alias("threshold"), "macro_f05"))
    return reduce(DataFrame.unionByName, out)


def ablation(rows: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], folds: Sequence[int], iterations: int = 10) -> DataFrame:
    """(dropped, features, auc): out-of-fold AUC with all features and without those of each group, named by their prefixes."""
    out = []
    for name, prefixes in {"none": (), **groups}.items():
        kept = [f for f in features if not f.startswith(tuple(prefixes))] if prefixes else list(features)
        scored = out_of_fold(rows, kept, folds, iterations)
        out.append(rank_auc(scored, "p", "label").select(F.lit(name).alias("dropped"), F.lit(len(kept)).alias("features"), "auc"))
    return reduce(DataFrame.unionByName, out)


def prior_threshold(scored: DataFrame, rate: float, p: str = "p") -> DataFrame:
    """(threshold, kept): the least score that keeps at most ``rate`` of the pairs, from counts by distinct score."""
    counts = _curve(scored.withColumn("_y", F.lit(1)), p, "_y", True)
    total = scored.agg((F.count("*") * F.lit(rate)).alias("most"))
    fits = counts.join(F.broadcast(total)).filter(F.col("cum_pos") <= F.col("most"))
    return fits.agg(F.min("score").alias("threshold"), F.max("cum_pos").cast("long").alias("kept"))


def mined_phrases(pairs: DataFrame, source: str, target: str, entity: str, support: int = 10, entities: int = 8, share: float = 0.9) -> DataFrame:
    """(old, new, n, records, share): replacements of at most two tokens, without digits, between linked texts.

    Kept if they occur ``support`` times in ``entities`` records and are ``share`` of what replaces the old phrase.
    """

    def opcodes(batches):
        for part in batches:
            out = []
            for key, a, b in zip(part["e"], part["s"], part["t"], strict=True):
                x, y = (a or "").split(), (b or "").split()
                for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if tag == "replace" and j - i <= 2 and m - k <= 2:
                        old, new = " ".join(x[i:j]), " ".join(y[k:m])
                        if not any(c.isdigit() for c in old + new):
                            out.append((key, old, new))
            yield pd.DataFrame(out, columns=["e", "old", "new"])

    rows = pairs.select(F.col(entity).alias("e"), F.col(source).alias("s"), F.col(target).alias("t"))
    kind = rows.schema["e"].dataType.simpleString()
    found = rows.mapInPandas(opcodes, f"e {kind}, old string, new string")
    counted = found.groupBy("old", "new").agg(F.count("*").alias("n"), F.countDistinct("e").alias("records"))
    whole = counted.groupBy("old").agg(F.sum("n").alias("whole"))
    part = counted.join(whole, "old").withColumn("share", F.col("n") / F.col("whole")).drop("whole")
    return part.filter((F.col("n") >= support) & (F.col("records") >= entities) & (F.col("share") >= share))


def categorise(rules: Mapping[str, Column], default: str = "other") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for name, condition in reversed(rules.items()):
        out = F.when(condition, name).otherwise(out)
    return out


def normal_interval(scores: DataFrame, column: str, z: float = 1.96) -> DataFrame:
    """(records, mean, se, low, high): the normal approximation of a mean's 95 % interval."""
    row = scores.agg(F.count(column).alias("records"), F.avg(column).alias("mean"), (F.stddev_samp(column) / F.sqrt(F.count(column))).alias("se"))
    return row.select("records", "mean", "se", (F.col("mean") - z * F.col("se")).alias("low"), (F.col("mean") + z * F.col("se")).alias("high"))


def bootstrap(scores: DataFrame, column: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """(low, mean, high): a 95 % interval of the mean by Poisson resampling, all draws in one pass over the records."""
    weights = [F.sum(F.col(column) * w).alias(f"s{i}") for i, w in enumerate(_poisson(draws, seed))]
    counts = [F.sum(w).alias(f"c{i}") for i, w in enumerate(_poisson(draws, seed))]
    row = scores.agg(F.avg(column).alias("mean"), *weights, *counts)
    means = F.array_sort(F.array(*[F.col(f"s{i}") / F.nullif(F.col(f"c{i}"), F.lit(0)) for i in range(draws)]))
    return row.select(means[int(0.025 * draws)].alias("low"), "mean", means[int(0.975 * draws)].alias("high"))


def _poisson(draws: int, seed: int) -> list[Column]:
    """Poisson(1) counts by inversion of a hash of the record and the draw, so they do not depend on partitions."""
    out = []
    for i in range(draws):
        u = F.pmod(F.xxhash64("q", F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003.0
        out.append(F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.9197, 2).when(u < 0.98101, 3).when(u < 0.99634, 4).otherwise(5))
    return out
