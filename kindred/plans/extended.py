"""Registered queries of guards, rescues, slices, decisions and stage-two features, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.operators import checks as C
from kindred.operators import decisions as D
from kindred.operators import features as V
from kindred.operators import models as M
from kindred.operators import ranking as K
from kindred.operators import rescue as X
from kindred.operators import routes as R
from kindred.operators import slices as L
from kindred.plans.catalog import CHOSEN, CLAIMS, F05, RECORDS, ROUTES, TOP, _chosen, grams_sql, r6, register

# Guards


@register("f_hash_sample", "SELECT entity_id FROM nrm WHERE substr(sha256(entity_id), 1, 2) IN ('00', '01', '02', '03')", RECORDS)
def f_hash_sample(w):
    n = w.norm
    return C.sampled(n.queries.unionByName(n.targets), "entity_id", ("00", "01", "02", "03")).select("entity_id")


@register("f_strict_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status FROM orders")
def f_strict_map(w):
    return w.table("orders").select("o_orderkey", C.strict_map(F.col("o_orderstatus"), {"F": "finished", "O": "open", "P": "pending"}).alias("status"))


@register("f_incomplete", "SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR lang IS NULL OR source IS NULL) AS incomplete FROM documents")
def f_incomplete(w):
    return C.incomplete(w.table("documents"), ["text", "lang", "source"])


@register("j_cardinality", """SELECT 'names' AS keys, count(*) FILTER (l > 1) AS left_repeats, count(*) FILTER (r > 1) AS right_repeats, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS shared,
  CASE WHEN count(*) FILTER (l > 1) > 0 THEN 'm' ELSE '1' END || ':' || CASE WHEN count(*) FILTER (r > 1) > 0 THEN 'm' ELSE '1' END AS relation
  FROM (SELECT country, n, count(*) AS l FROM s GROUP BY ALL) FULL JOIN (SELECT country, n, count(*) AS r FROM t GROUP BY ALL) USING (country, n)
  UNION ALL SELECT 'ids', 0, 0, count(*), '1:1' FROM folds""", RECORDS)  # fmt: skip
def j_cardinality(w):
    n = w.norm
    names = C.cardinality(n.queries, n.targets, ["country", "n"]).select(F.lit("names").alias("keys"), "*")
    ids = C.cardinality(n.queries.withColumnRenamed("entity_id", "source1_entity_id"), w.folds, ["source1_entity_id"])
    return names.unionByName(ids.select(F.lit("ids").alias("keys"), "*"))


@register("j_validated_one_to_one", "SELECT source1_entity_id, country, fold, n_matches FROM folds", RECORDS)
def j_validated_one_to_one(w):
    q = w.norm.queries.select(F.col("entity_id").alias("source1_entity_id"), "country")
    return C.joined_once(q, w.folds.drop("country"), ["source1_entity_id"]).select("source1_entity_id", "country", "fold", "n_matches")


PARITY = CLAIMS + """,
lft AS (SELECT q, t, p, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS k FROM claims WHERE (q * 31 + CAST(substr(t, 4) AS BIGINT)) % 10 <> 0),
rgt AS (SELECT q, t, p2 AS p, row_number() OVER (PARTITION BY q ORDER BY p2 DESC, t) AS k FROM (SELECT *, CASE WHEN q % 5 = 0 THEN 1 - p ELSE p END AS p2 FROM claims) WHERE (q * 31 + CAST(substr(t, 4) AS BIGINT)) % 11 <> 0)
"""


@register("j_route_parity", """SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS shared,
  count(*) FILTER (a.k <> b.k) AS rank_changes, round(max(abs(a.p - b.p)), 6) AS max_delta FROM lft a FULL JOIN rgt b USING (q, t)""", PARITY)  # fmt: skip
def j_route_parity(w):
    number = F.col("q") * 31 + F.substring("t", 4, 20).cast("long")
    ranked = lambda df: K.first_by(df, ["q"], [F.desc("p"), F.asc("t")], 1 << 30, "k")
    left = ranked(w.claims.filter(number % 10 != 0))
    right = ranked(w.claims.withColumn("p", F.when(F.col("q") % 5 == 0, 1 - F.col("p")).otherwise(F.col("p"))).filter(number % 11 != 0))
    return C.parity(left, right, ["q", "t"], "k", "p").withColumn("max_delta", r6("max_delta"))


@register("a_digests", """SELECT CAST(('0x' || substr(sha256(entity_id), 1, 16))::UBIGINT % 64 AS INTEGER) AS part, count(*) AS n,
  sha256(string_agg(length(entity_id) || ':' || entity_id || length(country) || ':' || country || length(n) || ':' || n, '' ORDER BY entity_id)) AS digest FROM nrm GROUP BY 1""", RECORDS)  # fmt: skip
def a_digests(w):
    from kindred.sources import roles

    n = w.norm
    return C.digests(n.queries.unionByName(n.targets), roles.shard(F.col("entity_id"), 64), ["entity_id"], ["entity_id", "country", "n"])


@register("d_test_order", """SELECT source1_entity_id, matched_entity_ids, row_number() OVER (ORDER BY sha256(source1_entity_id), source1_entity_id) AS place
  FROM (SELECT source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY target_id), '') AS matched_entity_ids FROM folds LEFT JOIN pairs USING (source1_entity_id) GROUP BY 1)""", RECORDS)  # fmt: skip
def d_test_order(w):
    from kindred.sources import delimited

    order = K.numbered(w.norm.queries.select(F.col("entity_id").alias("source1_entity_id")), [F.sha2("source1_entity_id", 256), F.col("source1_entity_id")], "place")
    return C.reordered(delimited.lists(w.norm.queries, w.pairs), order, "source1_entity_id").select("source1_entity_id", "matched_entity_ids", "place")


@register("w_group_ids", "SELECT entity_id, CAST(('0x' || substr(sha256('=' || country || '|=' || n || '|=' || a), 1, 15))::UBIGINT AS BIGINT) AS gid FROM t", RECORDS)
def w_group_ids(w):
    return w.norm.targets.select("entity_id", C.group_id("country", "n", "a").alias("gid"))


@register("k_worst_errors", """SELECT kind, q, t, p, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY error DESC, q, t) AS place FROM
  (SELECT *, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS kind, abs(p - y) AS error FROM claims) WHERE error >= 0.5) WHERE place <= 200""", CLAIMS)  # fmt: skip
def k_worst_errors(w):
    return C.worst(w.claims, "p", "y", 200, ["q", "t"]).select("kind", "q", "t", "p", "place")


# Rescues and cuts


@register("a_union_max", "SELECT q, t, max(p) AS p FROM (SELECT q, t, p FROM claims WHERE p >= 0.5 UNION ALL SELECT q, t, 1 - p FROM claims WHERE q % 2 = 0 UNION ALL SELECT q, t, 0.25::DOUBLE FROM claims WHERE y = 1) GROUP BY ALL", CLAIMS)
def a_union_max(w):
    c = w.claims
    parts = [c.filter("p >= 0.5").select("q", "t", "p", "y"), c.filter("q % 2 = 0").select("q", "t", (1 - F.col("p")).alias("p")), c.filter("y = 1").select("q", "t", F.lit(0.25).cast("float").alias("p"))]
    return X.union_max(parts)


@register("u_route_union", "SELECT source1_entity_id, target_id FROM ranked WHERE route = 'exact_name' UNION SELECT source1_entity_id, target_id FROM ranked WHERE route LIKE 'rare%'", ROUTES)
def u_route_union(w):
    two = lambda c: w.ranked.filter(c).select("source1_entity_id", "target_id")
    return two("route = 'exact_name'").union(two("route LIKE 'rare%'")).distinct()


@register("k_topk_ties", """SELECT t, q, p, CAST(place AS INTEGER) AS place, max(place) OVER (PARTITION BY t) = 5 AND p = min(p) OVER (PARTITION BY t) AS boundary FROM
  (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS place FROM claims WHERE p > 0) WHERE place <= 5""", CLAIMS)  # fmt: skip
def k_topk_ties(w):
    return X.top_k(w.claims, ["t"], "p", ["q"], 5).select("t", "q", "p", "place", "boundary")


@register("k_route_caps", "SELECT source1_entity_id, target_id, route, CAST(route_rank AS INTEGER) AS route_rank FROM ranked WHERE route_rank <= CASE route WHEN 'exact_name' THEN 20 WHEN 'exact_address' THEN 20 WHEN 'numeric_name' THEN 50 WHEN 'rare_name' THEN 100 WHEN 'rare_address' THEN 50 END", ROUTES)
def k_route_caps(w):
    caps = {"exact_name": 20, "exact_address": 20, "numeric_name": 50, "rare_name": 100, "rare_address": 50}
    return X.capped(w.ranked, caps).select("source1_entity_id", "target_id", "route", "route_rank")


@register("u_fused_caps", """SELECT source1_entity_id, target_id, CAST(candidate_rank AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY round(f, 12) DESC, target_id) AS candidate_rank,
  row_number() OVER (PARTITION BY source1_entity_id, left(target_id, 2) ORDER BY round(f, 12) DESC, target_id) AS k FROM (SELECT source1_entity_id, target_id, sum(1.0::DOUBLE / (60 + route_rank)) AS f FROM ranked GROUP BY ALL)) WHERE k <= 20""", ROUTES)  # fmt: skip
def u_fused_caps(w):
    fused = R.fuse(w.ranked).withColumn("f", F.round("fusion_score", 12)).withColumn("side", F.left("target_id", F.lit(2)))
    return K.first_by(fused, ["source1_entity_id", "side"], [F.desc("f"), F.asc("target_id")], 20).select("source1_entity_id", "target_id", "candidate_rank")


PARTS = CLAIMS + ", named AS (SELECT c.*, p_name AS text FROM claims c JOIN part ON p_partkey = CAST(substr(t, 4) AS BIGINT))\n"


def _texts(w):
    side = F.when(F.col("p_partkey") % 2 == 0, "S2-").otherwise("S3-")
    return w.table("part").select(F.concat(side, F.col("p_partkey").cast("string")).alias("t"), F.col("p_name").alias("text"))


@register("r_anchor_rescue", """SELECT q, t, p, anchor, round(sim, 6) AS similarity FROM (SELECT a.q, a.t, a.p, b.t AS anchor, jaro_winkler_similarity(a.text, b.text) AS sim,
  row_number() OVER (PARTITION BY a.q, a.t ORDER BY jaro_winkler_similarity(a.text, b.text) DESC, b.t) AS k FROM named a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS place FROM named WHERE p >= 0.7) WHERE place <= 5) b USING (q)
  WHERE a.p >= 0.2 AND a.p < 0.7 AND jaro_winkler_similarity(a.text, b.text) >= 0.8) WHERE k = 1""", PARTS)  # fmt: skip
def r_anchor_rescue(w):
    return X.anchors(w.claims, _texts(w), S.jaro_winkler_bytes_udf, 0.7, 0.2, 0.8).withColumn("similarity", r6("similarity"))


@register("k_bounded_rerank", """SELECT q, t, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN n > 25 THEN s END DESC, q) AS k FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n, jaro_winkler_similarity(text, 'blue bolt') * p AS s FROM named)) WHERE n <= 25 OR k <= 20""", PARTS)
def k_bounded_rerank(w):
    score = S.jaro_winkler_bytes_udf("text", F.lit("blue bolt")) * F.col("p")
    return X.bounded_rerank(w.claims.join(_texts(w), "t"), ["t"], score, ["q"], 25, 20).select("q", "t", "p")


@register("j_pairs_outside", "SELECT q, t, p FROM claims ANTI JOIN (SELECT q, t FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS k FROM claims) WHERE k <= 2) USING (q, t)", CLAIMS)
def j_pairs_outside(w):
    return X.outside(w.claims, K.first_by(w.claims, ["q"], [F.desc("p"), F.asc("t")], 2)).select("q", "t", "p")


@register("r_dense_new_pairs", """SELECT q, t, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS t, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) > 0) WHERE k BETWEEN 13 AND 20""")  # fmt: skip
def r_dense_new_pairs(w):
    e = w.table("embeddings")
    found = R.dense_route(e, e, 20)
    return X.outside(found, found.filter("rank <= 12")).select("q", "t", r6("score").alias("score"), "rank")


@register("r_pool_block", """SELECT q, t, key, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS place FROM
  (SELECT a.entity_id AS q, b.entity_id AS t, split_part(a.n, ' ', 1) AS key, jaro_winkler_similarity(left(a.n, 60), left(b.n, 60)) AS score FROM s a JOIN t b ON split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1)
   WHERE a.n <> '' AND split_part(b.n, ' ', 1) IN (SELECT split_part(n, ' ', 1) FROM t WHERE n <> '' GROUP BY 1 HAVING count(*) <= 500))) WHERE place <= 3""", RECORDS)  # fmt: skip
def r_pool_block(w):
    side = lambda df: df.select(F.col("entity_id").alias("id"), "n")
    score = S.jaro_winkler_bytes_udf(F.left("q_n", F.lit(60)), F.left("t_n", F.lit(60)))
    found = X.pool_block(side(w.norm.queries), side(w.norm.targets), F.substring_index("n", " ", 1), score)
    return found.withColumn("score", r6("score"))


CATEGORIES = {
    "C01": ("y = 1 AND p < 0.02", lambda p, y, t, q: (y == 1) & (p < 0.02)), "C02": ("y = 1 AND p < 0.2", lambda p, y, t, q: (y == 1) & (p < 0.2)),
    "C03": ("y = 1 AND p < 0.5 AND left(t, 2) = 'S3'", lambda p, y, t, q: (y == 1) & (p < 0.5) & t.startswith("S3")),
    "C04": ("y = 1 AND p < 0.5", lambda p, y, t, q: (y == 1) & (p < 0.5)), "C05": ("y = 1 AND p < 0.7", lambda p, y, t, q: (y == 1) & (p < 0.7)),
    "C06": ("y = 0 AND p >= 0.99", lambda p, y, t, q: (y == 0) & (p >= 0.99)), "C07": ("y = 0 AND p >= 0.9 AND q % 7 = 0", lambda p, y, t, q: (y == 0) & (p >= 0.9) & (q % 7 == 0)),
    "C08": ("y = 0 AND p >= 0.9", lambda p, y, t, q: (y == 0) & (p >= 0.9)), "C09": ("y = 0 AND p >= 0.7 AND left(t, 2) = 'S3'", lambda p, y, t, q: (y == 0) & (p >= 0.7) & t.startswith("S3")),
    "C10": ("y = 0 AND p >= 0.7", lambda p, y, t, q: (y == 0) & (p >= 0.7)), "C11": ("p BETWEEN 0.4 AND 0.6", lambda p, y, t, q: p.between(0.4, 0.6)),
}


@register("f_twelve_categories", "SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, (c, _) in CATEGORIES.items()) + " ELSE 'C12' END AS category, count(*) AS n FROM claims GROUP BY 1", CLAIMS)
def f_twelve_categories(w):
    rules = {n: rule(F.col("p"), F.col("y"), F.col("t"), F.col("q")) for n, (_, rule) in CATEGORIES.items()}
    return w.claims.groupBy(M.categorise(rules, "C12").alias("category")).agg(F.count("*").alias("n"))


@register("l_prior_threshold", "SELECT min(p) AS threshold, max(c) AS kept FROM (SELECT p, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS c, sum(n) OVER () AS total FROM (SELECT p, count(*) AS n FROM claims GROUP BY 1)) WHERE c <= total * 0.17::DOUBLE", CLAIMS)
def l_prior_threshold(w):
    return M.prior_threshold(w.claims, 0.17)


# Slices


@register("f_error_flags", """SELECT flag, n FROM (SELECT count(*) FILTER (y = 1 AND p < 0.5) AS missed, count(*) FILTER (y = 0 AND p >= 0.7) AS false_merge, count(*) FILTER (left(t, 2) = 'S3' AND y = 1) AS second_source, count(*) FILTER (p BETWEEN 0.4 AND 0.6) AS uncertain FROM claims)
  UNPIVOT (n FOR flag IN (missed, false_merge, second_source, uncertain))""", CLAIMS)  # fmt: skip
def f_error_flags(w):
    p, y = F.col("p"), F.col("y")
    return L.flag_counts(w.claims, {"missed": (y == 1) & (p < 0.5), "false_merge": (y == 0) & (p >= 0.7), "second_source": F.col("t").startswith("S3") & (y == 1), "uncertain": p.between(0.4, 0.6)})


@register("a_slice_report", """SELECT slice, count(*) AS n, round(avg(p), 6) AS mean_p, CAST(sum(y) AS BIGINT) AS links FROM (SELECT 'all' AS slice, * FROM claims UNION ALL SELECT 'low', * FROM claims WHERE p < 0.3 UNION ALL SELECT 'even', * FROM claims WHERE q % 2 = 0 UNION ALL SELECT 's3', * FROM claims WHERE left(t, 2) = 'S3') GROUP BY 1""", CLAIMS)
def a_slice_report(w):
    slices = {"low": F.col("p") < 0.3, "even": F.col("q") % 2 == 0, "s3": F.col("t").startswith("S3")}
    return L.slice_report(w.claims, slices, [F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), F.sum("y").alias("links")])


RECALL = ROUTES + """,
lk AS (SELECT p.*, f.country, left(p.target_id, 2) AS src, CASE WHEN n_matches = 1 THEN '1' WHEN n_matches <= 3 THEN '2-3' ELSE '4+' END AS bucket,
  CAST(EXISTS (SELECT 1 FROM ranked r WHERE r.route LIKE 'rare%' AND r.source1_entity_id = p.source1_entity_id AND r.target_id = p.target_id) AS INTEGER) AS hit FROM pairs p JOIN folds f USING (source1_entity_id))
"""


@register("a_recall_tables", """SELECT dimension, value, count(*) AS links, CAST(sum(hit) AS BIGINT) AS found, round(avg(hit), 6) AS recall FROM (SELECT 'country' AS dimension, country AS value, hit FROM lk UNION ALL SELECT 'source', src, hit FROM lk
  UNION ALL SELECT 'matches', bucket, hit FROM lk UNION ALL SELECT 'country_source', country || '|' || src, hit FROM lk) GROUP BY ALL""", RECALL)  # fmt: skip
def a_recall_tables(w):
    links = w.pairs.join(w.folds.select("source1_entity_id", "country", "n_matches"), "source1_entity_id")
    src = F.left("target_id", F.lit(2))
    bucket = F.when(F.col("n_matches") == 1, "1").when(F.col("n_matches") <= 3, "2-3").otherwise("4+")
    dimensions = {"country": F.col("country"), "source": src, "matches": bucket, "country_source": F.concat_ws("|", "country", src)}
    return L.recall_table(links, w.ranked.filter("route LIKE 'rare%'"), dimensions).withColumn("recall", r6("recall"))


@register("a_candidate_volume", """SELECT country, count(*) AS records, CAST(sum(candidates) AS BIGINT) AS candidates, round(avg(candidates), 6) AS mean_candidates, quantile_cont(candidates, 0.5) AS median, round(quantile_cont(candidates, 0.95), 6) AS p95, max(candidates) AS max_candidates,
  CAST(sum(found) AS BIGINT) AS found, CAST(sum(n_matches) AS BIGINT) AS links, round(sum(found) / nullif(sum(n_matches), 0)::DOUBLE, 6) AS recall, round(avg(CAST(found > 0 AS INT)), 6) AS any_rate, round(avg(CAST(found = n_matches AS INT)), 6) AS all_rate,
  round(avg(CASE WHEN n_matches = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * found / (found + 0.25::DOUBLE * n_matches) END), 6) AS oracle, round(1 - sum(candidates)::DOUBLE / (count(*) * any_value(pool)), 6) AS reduction
  FROM (SELECT f.source1_entity_id, f.country, n_matches, count(DISTINCT c.target_id) AS candidates, count(DISTINCT p.target_id) AS found FROM folds f LEFT JOIN ranked c USING (source1_entity_id) LEFT JOIN pairs p ON p.source1_entity_id = c.source1_entity_id AND p.target_id = c.target_id GROUP BY ALL)
  JOIN (SELECT country, count(*) AS pool FROM t GROUP BY 1) USING (country) GROUP BY 1""", ROUTES)  # fmt: skip
def a_candidate_volume(w):
    rows = L.candidate_volume(R.evaluate(w.ranked, w.folds, w.pairs), w.norm.targets)
    return rows.withColumns({c: r6(c) for c in ("mean_candidates", "p95", "recall", "any_rate", "all_rate", "oracle", "reduction")})


@register("a_incremental_union", """SELECT CAST(step AS INTEGER) AS step, route, CAST(sum(nl) OVER (ORDER BY step) AS BIGINT) AS links, nl AS new_links, CAST(sum(nc) OVER (ORDER BY step) AS BIGINT) AS candidates, nc AS new_candidates FROM
  (SELECT step, route, count(first) AS nc, count(p.target_id) AS nl FROM (VALUES (1, 'exact_name'), (2, 'rare_name'), (3, 'rare_address'), (4, 'numeric_name')) v(step, route)
   LEFT JOIN (SELECT source1_entity_id, target_id, min(CASE route WHEN 'exact_name' THEN 1 WHEN 'rare_name' THEN 2 WHEN 'rare_address' THEN 3 WHEN 'numeric_name' THEN 4 END) AS first FROM ranked GROUP BY ALL) x ON x.first = v.step
   LEFT JOIN pairs p ON p.source1_entity_id = x.source1_entity_id AND p.target_id = x.target_id GROUP BY ALL)""", ROUTES)  # fmt: skip
def a_incremental_union(w):
    return L.incremental_union(w.ranked, w.pairs, ["exact_name", "rare_name", "rare_address", "numeric_name"])


@register("a_population", """SELECT side, country, measure, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.95), 4) AS p95, count(*) FILTER (v IS NULL) AS missing FROM
  (SELECT left(entity_id, 2) AS side, country, 'name_length' AS measure, length(n)::DOUBLE AS v FROM nrm UNION ALL SELECT left(entity_id, 2), country, 'name_tokens', CASE WHEN n = '' THEN NULL ELSE len(string_split(n, ' '))::DOUBLE END FROM nrm
   UNION ALL SELECT left(entity_id, 2), country, 'digits', len(regexp_extract_all(a, '[0-9]'))::DOUBLE FROM nrm) GROUP BY ALL""", RECORDS)  # fmt: skip
def a_population(w):
    n = w.norm
    rows = n.queries.unionByName(n.targets).withColumn("side", F.left("entity_id", F.lit(2)))
    measures = {"name_length": F.length("n"), "name_tokens": F.when(F.col("n") != "", F.size(F.split("n", " "))), "digits": F.regexp_count("a", F.lit("[0-9]"))}
    found = L.population(rows, measures, ["side", "country"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median", "p95")})


@register("a_test_shift", """SELECT bucket, left_n, right_n, round(left_n::DOUBLE / l, 6) AS left_share, round(right_n::DOUBLE / r, 6) AS right_share, round(((left_n + 0.5) / (l + 0.5 * k) - (right_n + 0.5) / (r + 0.5 * k)) * ln(((left_n + 0.5) / (l + 0.5 * k)) / ((right_n + 0.5) / (r + 0.5 * k))), 6) + 0.0 AS psi
  FROM (SELECT *, sum(left_n) OVER () AS l, sum(right_n) OVER () AS r, count(*) OVER () AS k FROM (SELECT country || '|' || least(len(string_split(n, ' ')) // 4, 5) AS bucket, count(*) FILTER (left(entity_id, 2) = 'S1') AS left_n, count(*) FILTER (left(entity_id, 2) <> 'S1') AS right_n FROM nrm GROUP BY 1))""", RECORDS)  # fmt: skip
def a_test_shift(w):
    size = F.least(F.floor(F.size(F.split("n", " ")) / 4), F.lit(5)).cast("string")
    rows = L.shift(w.norm.queries, w.norm.targets, F.concat_ws("|", "country", size))
    return rows.withColumns({"left_share": r6("left_share"), "right_share": r6("right_share"), "psi": r6("psi") + 0.0})


LINKED = RECORDS + """,
neg AS (SELECT s.entity_id AS source1_entity_id, t.entity_id AS target_id, s.n AS sn, t.n AS tn FROM s JOIN t USING (country, a) WHERE a <> '' ),
lnk AS (SELECT s.n AS sn, t.n AS tn, s.a AS sa, t.a AS ta FROM pairs JOIN s ON s.entity_id = source1_entity_id JOIN t ON t.entity_id = target_id)
"""


def _linked(w):
    n = w.norm
    q = n.queries.select(F.col("entity_id").alias("source1_entity_id"), F.col("n").alias("sn"), F.col("a").alias("sa"))
    t = n.targets.select(F.col("entity_id").alias("target_id"), F.col("n").alias("tn"), F.col("a").alias("ta"))
    return w.pairs.join(q, "source1_entity_id").join(t, "target_id")


@register("a_view_ablation", """SELECT view, n, equal, negative_n, negative_equal FROM (SELECT 'norm' AS view, count(*) AS n, count(*) FILTER (sn = tn AND sn <> '') AS equal FROM lnk UNION ALL SELECT 'token_set', count(*), count(*) FILTER (sn <> '' AND list_sort(list_distinct(string_split(sn, ' '))) = list_sort(list_distinct(string_split(tn, ' ')))) FROM lnk
  UNION ALL SELECT 'compact', count(*), count(*) FILTER (sn <> '' AND replace(sn, ' ', '') = replace(tn, ' ', '')) FROM lnk) JOIN
  (SELECT 'norm' AS view, count(*) AS negative_n, count(*) FILTER (sn = tn AND sn <> '') AS negative_equal FROM neg UNION ALL SELECT 'token_set', count(*), count(*) FILTER (sn <> '' AND list_sort(list_distinct(string_split(sn, ' '))) = list_sort(list_distinct(string_split(tn, ' ')))) FROM neg
  UNION ALL SELECT 'compact', count(*), count(*) FILTER (sn <> '' AND replace(sn, ' ', '') = replace(tn, ' ', '')) FROM neg) USING (view)""", LINKED)  # fmt: skip
def a_view_ablation(w):
    n = w.norm
    side = lambda df, x: df.filter("a <> ''").select("country", "a", F.col("n").alias(x))
    others = side(n.queries, "sn").join(side(n.targets, "tn"), ["country", "a"])
    sn, tn = F.col("sn"), F.col("tn")
    form = lambda name: (T.OPERATIONS[name](sn), T.OPERATIONS[name](tn))
    drop = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return L.view_ablation(_linked(w), others, {"norm": (sn, tn), "token_set": form("token_set"), "compact": (drop(sn), drop(tn))})


@register("a_pattern_unions", r"""SELECT pattern, n FROM (SELECT count(*) FILTER (regexp_matches(business_address, '\b[0-9]{5}\b')) AS postal5, count(*) FILTER (regexp_matches(business_address, '\b[0-9]{6}\b')) AS postal6, count(*) FILTER (regexp_matches(business_name, '[&+/]')) AS joined_name, count(*) FILTER (regexp_matches(business_name, '[-'']')) AS hyphen_name,
  count(*) FILTER (regexp_matches(business_address, '\b[0-9]{5}\b') OR regexp_matches(business_address, '\b[0-9]{6}\b') OR regexp_matches(business_name, '[&+/]') OR regexp_matches(business_name, '[-'']')) AS "any" FROM raw) UNPIVOT (n FOR pattern IN (postal5, postal6, joined_name, hyphen_name, "any"))""", RECORDS)  # fmt: skip
def a_pattern_unions(w):
    name, address = F.col("business_name"), F.col("business_address")
    return L.union_counts(w.every, {"postal5": address.rlike(r"\b[0-9]{5}\b"), "postal6": address.rlike(r"\b[0-9]{6}\b"), "joined_name": name.rlike("[&+/]"), "hyphen_name": name.rlike("[-']")})


@register("a_edit_profile", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN x = y THEN 'same' WHEN list_sort(string_split(x, ' ')) = list_sort(string_split(y, ' ')) THEN 'reordered' WHEN contains(x, y) OR contains(y, x) THEN 'contained' WHEN levenshtein(x, y) <= 2 THEN 'edit_1_2' WHEN levenshtein(x, y) <= 5 THEN 'edit_3_5' ELSE 'edit_6_up' END AS kind
  FROM (SELECT strip_accents(n) AS x, strip_accents(prev_n) AS y FROM (SELECT n, lag(n) OVER (PARTITION BY country ORDER BY n, a, entity_id) AS prev_n FROM nrm) WHERE prev_n IS NOT NULL)) GROUP BY 1""", RECORDS)  # fmt: skip
def a_edit_profile(w):
    n = w.norm
    rows = R.sorted_neighbours(n.queries.unionByName(n.targets)).filter("prev_n IS NOT NULL")
    texts = rows.select(T.strip_accents(F.col("n")).alias("x"), T.strip_accents(F.col("prev_n")).alias("y"))
    return L.edit_profile(texts, F.col("x"), F.col("y"))


# Decisions


@register("d_joint_thresholds", f"""SELECT pair_threshold, empty_threshold, round(avg({F05}), 6) AS macro_f05 FROM (SELECT a.g / 1000.0::DOUBLE AS pair_threshold, b.g / 1000.0::DOUBLE AS empty_threshold, e.q, actual, count(c.t) AS predicted, coalesce(sum(c.y), 0) AS tp
  FROM entities e CROSS JOIN (VALUES (200), (400), (600), (800)) AS a(g) JOIN (VALUES (200), (400), (600), (800), (900)) AS b(g) ON b.g >= a.g LEFT JOIN (SELECT q, max(p) AS top FROM claims GROUP BY 1) m ON m.q = e.q
  LEFT JOIN claims c ON c.q = e.q AND round(c.p * 1000, 6) >= a.g AND round(m.top * 1000, 6) >= b.g GROUP BY ALL) GROUP BY ALL""", CLAIMS)  # fmt: skip
def d_joint_thresholds(w):
    return D.joint_threshold(w.claims, w.entities, [200, 400, 600, 800], [200, 400, 600, 800, 900]).withColumn("macro_f05", r6("macro_f05"))


@register("d_expected_prefix_biased", """SELECT q, t, round(b, 6) AS p, CAST(k AS INTEGER) AS k, round(u, 6) AS utility FROM (SELECT *, max(u) OVER (PARTITION BY q) AS bu, min(k) FILTER (u = mu) OVER (PARTITION BY q) AS bk FROM
  (SELECT *, max(u) OVER (PARTITION BY q) AS mu FROM (SELECT *, round(1.25::DOUBLE * sum(b) OVER (PARTITION BY q ORDER BY k) / (k + 0.25::DOUBLE * sum(b) OVER (PARTITION BY q)), 9) AS u,
   round(exp(sum(ln(greatest(1 - b, 1e-12))) OVER (PARTITION BY q)) + 0.1::DOUBLE, 9) AS none FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY b DESC, t) AS k FROM
   (SELECT q, t, 1 / (1 + exp(-(ln(x / (1 - x)) - 0.5))) AS b FROM (SELECT q, t, least(greatest(p, 1e-6), 1 - 1e-6) AS x FROM claims))) WHERE k <= 20))) WHERE bu > none AND k <= bk""", CLAIMS)  # fmt: skip
def d_expected_prefix_biased(w):
    return D.expected_prefix(w.claims, empty_bonus=0.1, bias=-0.5).withColumns({"utility": r6("utility"), "p": r6("p")})


UNITS = CLAIMS + ", units AS (SELECT t, 'u' || CAST(substr(t, 4) AS BIGINT) // 3 AS unit FROM (SELECT DISTINCT t FROM claims) WHERE CAST(substr(t, 4) AS BIGINT) % 3 <> 2)\n"


@register("d_owned_units", "SELECT q, t, p FROM (SELECT c.*, first_value(q) OVER (PARTITION BY coalesce(unit, 't:' || t) ORDER BY p DESC, q) AS best FROM claims c LEFT JOIN units USING (t)) WHERE q = best", UNITS)
def d_owned_units(w):
    number = F.substring("t", 4, 20).cast("long")
    units = w.claims.select("t").distinct().filter(number % 3 != 2).select("t", F.concat(F.lit("u"), F.floor(number / 3).cast("string")).alias("unit"))
    return D.owned_units(w.claims, units)


def _cross_sql() -> str:
    half = "CAST(('0x' || substr(sha256(t), 1, 8))::UBIGINT % 2 AS INTEGER)"
    lead = "round(max(p) OVER (PARTITION BY t) - coalesce(nth_value(p, 2) OVER (PARTITION BY t ORDER BY p DESC, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1), 9)"
    return f"""kept AS (SELECT m AS margin, h AS half, q, t FROM (SELECT *, {half} AS h, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS k, {lead} AS lead FROM claims), (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) v(m) WHERE k = 1 AND lead >= m),
tr AS (SELECT q, t, {half} AS half FROM truth),
grid AS (SELECT m AS margin, h AS half FROM (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) a(m), (VALUES (0), (1)) b(h)),
sc AS (SELECT g.margin, g.half, e.q, (SELECT count(*) FROM kept k WHERE k.margin = g.margin AND k.half = g.half AND k.q = e.q) AS predicted, (SELECT count(*) FROM kept k SEMI JOIN tr USING (q, t) WHERE k.margin = g.margin AND k.half = g.half AND k.q = e.q) AS tp,
  (SELECT count(*) FROM tr WHERE tr.half = g.half AND tr.q = e.q) AS actual FROM grid g, entities e),
tb AS (SELECT margin, half, round(avg({F05}), 12) AS f FROM sc GROUP BY ALL),
pick AS (SELECT half, margin FROM (SELECT *, row_number() OVER (PARTITION BY half ORDER BY f DESC, margin) AS k FROM tb) WHERE k = 1)
"""


@register("d_cross_fitted_drop", "SELECT tb.half, tb.margin, round(f, 6) AS macro_f05 FROM pick JOIN tb ON tb.half = 1 - pick.half AND tb.margin = pick.margin", CLAIMS + "," + _cross_sql())
def d_cross_fitted_drop(w):
    return D.cross_fitted_drop(w.claims, w.truth, w.entities, [0.01, 0.05, 0.2]).withColumn("macro_f05", r6("macro_f05"))


@register("d_hard_pairs", "SELECT q, t, p, reason FROM (SELECT *, CASE WHEN y = 0 AND p >= 0.7 THEN 'false_positive' WHEN y = 1 AND p < 0.7 THEN 'false_negative' WHEN p BETWEEN 0.2 AND 0.95 THEN 'uncertain' END AS reason FROM claims) WHERE reason IS NOT NULL", CLAIMS)
def d_hard_pairs(w):
    return D.hard_pairs(w.claims).select("q", "t", "p", "reason")


@register("d_stacked_overrides", """SELECT q, t FROM kept UNION ALL SELECT q, t FROM (SELECT c.q, c.t, row_number() OVER (PARTITION BY c.t ORDER BY c.q) AS k FROM claims c ANTI JOIN (SELECT t FROM kept) x ON x.t = c.t WHERE c.q % 13 = 2) WHERE k = 1""",
  CHOSEN + ", kept AS (SELECT q, t FROM chosen WHERE q % 11 <> 0)")
def d_stacked_overrides(w):
    drop = _chosen(w).filter("q % 11 = 0").select("q", "t", F.lit(False).alias("keep"))
    add = w.claims.filter("q % 13 = 2").select("q", "t", F.lit(True).alias("keep"))
    return D.stack_overrides(_chosen(w), [drop, add])


# Scores


@register("w_nullable_z", """SELECT q, t, round((v - avg(v) OVER w) / (coalesce(stddev_samp(v) OVER w, 1) + 1.0::DOUBLE), 6) + 0.0 AS v_z FROM (SELECT *, CASE WHEN y = 0 OR p > 0.5 THEN p END AS v FROM claims) WINDOW w AS (PARTITION BY q)""", CLAIMS)
def w_nullable_z(w):
    rows = w.claims.withColumn("v", F.when((F.col("y") == 0) | (F.col("p") > 0.5), F.col("p")))
    return K.qnorm(rows, ["v"], default=1.0, floor=1.0).select("q", "t", (r6("v_z") + 0.0).alias("v_z"))


@register("w_joint_stratum_top", """SELECT q, t, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY left(t, 2), y, q % 5, CAST(floor(p * 4) AS INTEGER) ORDER BY sha256(q || '|' || t), q, t) AS place FROM claims) WHERE place <= 20""", CLAIMS)
def w_joint_stratum_top(w):
    rows = w.claims.withColumns({"side": F.left("t", F.lit(2)), "m": F.col("q") % 5, "b": F.floor(F.col("p") * 4), "h": F.sha2(F.concat_ws("|", F.col("q").cast("string"), "t"), 256)})
    return K.first_by(rows, ["side", "y", "m", "b"], [F.asc("h"), F.asc("q"), F.asc("t")], 20).select("q", "t", "place")


@register("a_owner_summary", "SELECT t, first(q ORDER BY p DESC, q) AS owner, count(DISTINCT q) AS claimants, round(stddev_samp(p), 6) AS std, round(median(p), 6) AS median, max(p) AS top FROM claims GROUP BY 1", CLAIMS)
def a_owner_summary(w):
    first = F.min_by("q", F.struct((-F.col("p")).alias("less"), "q"))
    return w.claims.groupBy("t").agg(first.alias("owner"), F.countDistinct("q").alias("claimants"), r6(F.stddev_samp("p")).alias("std"), r6(F.median("p")).alias("median"), F.max("p").alias("top"))


@register("m_shifted_scores", "SELECT q, t, round(1 / (1 + exp(-(ln(x / (1 - x)) + 0.75))), 6) AS p FROM (SELECT q, t, least(greatest(p, 1e-6), 1 - 1e-6) AS x FROM claims)", CLAIMS)
def m_shifted_scores(w):
    return w.claims.select("q", "t", r6(D.shifted(F.col("p"), 0.75)).alias("p"))


@register("m_number_xor", r"""SELECT source1_entity_id, target_id, len(list_filter(x, lambda v: NOT list_contains(y, v))) + len(list_filter(y, lambda v: NOT list_contains(x, v))) AS differing FROM (SELECT source1_entity_id, target_id, list_distinct(regexp_extract_all(s.a, '[0-9]+')) AS x, list_distinct(regexp_extract_all(t.a, '[0-9]+')) AS y FROM pairs JOIN s ON s.entity_id = source1_entity_id JOIN t ON t.entity_id = target_id)""", RECORDS)
def m_number_xor(w):
    x, y = T.numbers(F.col("sa")), T.numbers(F.col("ta"))
    return _linked(w).select("source1_entity_id", "target_id", (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))).cast("long").alias("differing"))


@register("l_ks_statistic", """SELECT round(max(abs(cp / tp - cn / tn)), 6) AS ks FROM (SELECT sum(pos) OVER (ORDER BY p) AS cp, sum(neg) OVER (ORDER BY p) AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM claims GROUP BY 1))""", CLAIMS)
def l_ks_statistic(w):
    return M.ks_statistic(w.claims).withColumn("ks", r6("ks"))


@register("l_average_precision", """SELECT round(sum(pos * cum / (cum + neg_cum)) / any_value(total), 6) AS ap FROM (SELECT pos, sum(pos) OVER w AS cum, sum(neg) OVER w AS neg_cum, sum(pos) OVER () AS total FROM (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM claims GROUP BY 1) WINDOW w AS (ORDER BY p DESC))""", CLAIMS)
def l_average_precision(w):
    return M.average_precision(w.claims).withColumn("ap", r6("ap"))


# Stage-two features, over short business records that are made of parts by arithmetic on their keys

PART_RECORDS = r"""
raw2 AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'S1-' WHEN 1 THEN 'S2-' ELSE 'S3-' END || p_partkey AS entity_id, p_brand AS country, p_partkey AS k, p_size,
  p_name || ' ' || lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' ltd' WHEN 1 THEN ' services inc' WHEN 2 THEN '.com' ELSE '' END AS business_name,
  CASE WHEN p_partkey % 5 = 3 THEN '' ELSE p_size || '-' || (p_partkey % 17) || CASE p_partkey % 5 WHEN 0 THEN ' Main St New York' WHEN 1 THEN ' park rd Calcutta WB' WHEN 2 THEN ' 5 ave NY' ELSE ' oak ln bombay mh' END END AS business_address FROM part),
d0 AS (SELECT *, trim(regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(business_address), '[^a-z0-9]+', ' ', 'g')) AS a FROM raw2),
d AS (SELECT *, list_distinct(string_split(n, ' ')) AS words, list_filter(string_split(n, ' '), lambda x, i: x NOT IN ('ltd', 'inc', 'services', 'com') AND list_position(string_split(n, ' '), x) = i) AS core,
  CASE k % 5 WHEN 0 THEN ['main', 'street', 'st_ny'] WHEN 1 THEN ['park', 'road', 'kolkata', 'st_wb'] WHEN 2 THEN ['avenue', 'st_ny'] WHEN 4 THEN ['oak', 'lane', 'mumbai', 'st_mh'] ELSE [] END AS address,
  CASE k % 5 WHEN 0 THEN ['st_ny'] WHEN 1 THEN ['st_wb'] WHEN 2 THEN ['st_ny'] WHEN 4 THEN ['st_mh'] ELSE [] END AS states,
  replace(array_to_string(list_filter(string_split(n, ' '), lambda x: x NOT IN ('com', 'www')), ' '), ' ', '') AS compact, regexp_replace(a, '[^0-9]', '', 'g') AS digits FROM d0),
cand AS (SELECT q, t, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS place FROM (SELECT x.entity_id AS q, y.entity_id AS t, ((x.k * 7919 + y.k * 104729) % 1000) / 1000.0::DOUBLE AS p FROM d x JOIN d y USING (country, p_size) WHERE left(x.entity_id, 2) = 'S1' AND left(y.entity_id, 2) <> 'S1')) WHERE place <= 12),
total AS (SELECT count(*)::DOUBLE AS n FROM d WHERE left(entity_id, 2) = 'S1'),
idf1 AS (SELECT token, ln((SELECT n FROM total) / (count(*) + 1)) AS w FROM (SELECT unnest(words) AS token FROM d WHERE left(entity_id, 2) = 'S1') GROUP BY 1 HAVING count(*) >= 2),
wt1 AS (SELECT entity_id, token, coalesce(w, ln((SELECT n FROM total) / 2)) AS w FROM (SELECT entity_id, unnest(words) AS token FROM d) LEFT JOIN idf1 USING (token)),
nrm1 AS (SELECT entity_id, sum(w * w) AS s FROM wt1 GROUP BY 1),
pc AS (SELECT c.*, x.core AS qc, y.core AS tc, x.address AS qa, y.address AS ta, x.states AS qs, y.states AS ts, x.compact AS qk, y.compact AS tk, x.digits AS qd, y.digits AS td, x.business_name AS qn, y.business_name AS tn, x.business_address AS qb, y.business_address AS tb FROM cand c JOIN d x ON x.entity_id = q JOIN d y ON y.entity_id = t)
"""


def _part_records(w):
    k = F.col("p_partkey")
    prefix = F.when(k % 3 == 0, "S1-").when(k % 3 == 1, "S2-").otherwise("S3-")
    form = F.when(k % 4 == 0, " ltd").when(k % 4 == 1, " services inc").when(k % 4 == 2, ".com").otherwise("")
    place = F.when(k % 5 == 0, " Main St New York").when(k % 5 == 1, " park rd Calcutta WB").when(k % 5 == 2, " 5 ave NY").otherwise(" oak ln bombay mh")
    address = F.when(k % 5 == 3, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-"), (k % 17).cast("string"), place))
    return w.table("part").select(
        F.concat(prefix, k.cast("string")).alias("entity_id"), F.col("p_brand").alias("country"), k.alias("k"), "p_size",
        F.concat("p_name", F.lit(" "), F.lower("p_type"), form).alias("business_name"), address.alias("business_address"),
    )


def _part_pairs(records):
    q = records.filter("entity_id LIKE 'S1-%'").select(F.col("entity_id").alias("q"), "country", "p_size", F.col("k").alias("kq"))
    t = records.filter("entity_id NOT LIKE 'S1-%'").select(F.col("entity_id").alias("t"), "country", "p_size", F.col("k").alias("kt"))
    rows = q.join(t, ["country", "p_size"]).select("q", "t", (((F.col("kq") * 7919 + F.col("kt") * 104729) % 1000) / 1000.0).alias("p"))
    return K.first_by(rows, ["q"], [F.desc("p"), F.asc("t")], 12).drop("place")


def _stage_two(w):
    records = _part_records(w)
    held = V.described(records)
    pairs = _part_pairs(records)
    return pairs, held, V.pair_features(pairs, held, held.filter("entity_id LIKE 'S1-%'"))


_SET2 = "len(list_intersect({0}, {1}))"


@register("l_stage2_pairs", f"""SELECT q, t, CAST(qb = '' AS INT) AS q_address_missing, CAST(len(qc) > 0 AND qc = tc AS INT) AS core_equal, round(jaro_winkler_similarity(array_to_string(qc, ' '), array_to_string(tc, ' ')), 5) AS core_jw,
  round({_SET2.format("qc", "tc")}::DOUBLE / least(len(qc), len(tc)), 5) AS core_containment, round({_SET2.format("qc", "tc")}::DOUBLE / len(list_distinct(list_concat(qc, tc))), 5) AS core_jaccard, len(qc) - {_SET2.format("qc", "tc")} AS core_q_only, len(tc) - {_SET2.format("qc", "tc")} AS core_t_only,
  round(coalesce((SELECT sum(a.w * a.w) FROM wt1 a JOIN wt1 b USING (token) WHERE a.entity_id = q AND b.entity_id = t), 0) / sqrt((SELECT s FROM nrm1 WHERE entity_id = q) * (SELECT s FROM nrm1 WHERE entity_id = t)), 5) AS name_cosine,
  round(coalesce((SELECT max(a.w) FROM wt1 a JOIN wt1 b USING (token) WHERE a.entity_id = q AND b.entity_id = t), 0), 5) AS name_shared_max,
  round(coalesce((SELECT max(a.w) FROM wt1 a WHERE a.entity_id = q AND a.token NOT IN (SELECT token FROM wt1 WHERE entity_id = t)), 0), 5) AS name_q_missing_max,
  round(coalesce((SELECT max(a.w) FROM wt1 a WHERE a.entity_id = t AND a.token NOT IN (SELECT token FROM wt1 WHERE entity_id = q)), 0), 5) AS name_t_missing_max,
  round(jaro_winkler_similarity(qk, tk), 5) AS compact_jw, CAST(tn LIKE '%.com' AS INT) AS t_domain, round(CASE WHEN len(qa) > 0 AND len(ta) > 0 THEN {_SET2.format("qa", "ta")}::DOUBLE / len(list_distinct(list_concat(qa, ta))) ELSE 0 END, 5) AS address_jaccard,
  CAST(list_has_any(qs, ts) AS INT) AS state_equal, CAST(len(qs) > 0 AND len(ts) > 0 AND NOT list_has_any(qs, ts) AS INT) AS state_conflict, round(CASE WHEN qd <> '' AND td <> '' THEN jaro_winkler_similarity(qd, td) ELSE 0 END, 5) AS digits_jw FROM pc""", PART_RECORDS)  # fmt: skip
def l_stage2_pairs(w):
    rows = _stage_two(w)[2]
    whole = ("q_address_missing", "core_equal", "core_q_only", "core_t_only", "t_domain", "state_equal", "state_conflict")
    parts = ("core_jw", "core_containment", "core_jaccard", "name_cosine", "name_shared_max", "name_q_missing_max", "name_t_missing_max", "compact_jw", "address_jaccard", "digits_jw")
    return rows.select("q", "t", *[F.col(c).cast("int").alias(c) for c in whole], *[F.round(c, 5).alias(c) for c in parts])


@register("l_stage2_context", """SELECT c.q, c.t, round(ln(x / (1 - x)), 5) AS base_logit, CAST(row_number() OVER (PARTITION BY c.q ORDER BY p DESC, c.t) AS INTEGER) AS rank, round(max(p) OVER w - p, 5) AS gap_top, CAST(sum(CAST(p >= 0.9 AS INT)) OVER w AS INTEGER) AS n_strong, CAST(sum(CAST(p >= 0.5 AS INT)) OVER w AS INTEGER) AS n_mid,
  round(coalesce(sn, 0), 5) AS sibling_name, CAST(coalesce(sc, 0) AS INTEGER) AS sibling_copy FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS x FROM cand) c
  LEFT JOIN (SELECT a.q, a.t, max(jaro_winkler_similarity(array_to_string(a.tc, ' '), array_to_string(b.tc, ' '))) AS sn, max(CAST(a.tn = b.tn AND a.tb = b.tb AS INT)) AS sc FROM pc a JOIN pc b ON a.q = b.q AND b.p >= 0.9 AND a.t <> b.t GROUP BY ALL) m ON m.q = c.q AND m.t = c.t WINDOW w AS (PARTITION BY c.q)""", PART_RECORDS)  # fmt: skip
def l_stage2_context(w):
    records = _part_records(w)
    rows = V.context_features(_part_pairs(records), V.described(records))
    return rows.select("q", "t", F.round("base_logit", 5).alias("base_logit"), *[F.col(c).cast("int").alias(c) for c in ("rank", "n_strong", "n_mid", "sibling_copy")], *[F.round(c, 5).alias(c) for c in ("gap_top", "sibling_name")])


@register("l_stage2_all")
def l_stage2_all(w):
    pairs, held, made = _stage_two(w)
    names = [c for c in made.columns if c not in ("q", "t")]
    return V.context_features(pairs, held).join(K.qnorm(made, names), ["q", "t"])


@register("l_resolver_features", """SELECT q, t, CAST(a1 = b1 AS INT) AS name_equal, CAST(qb = '' AS INT) AS q_no_address, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 5) AS name_jaccard, CAST(len(list_intersect(x, y)) = least(len(x), len(y)) AS INT) AS name_within, CAST(left(t, 2) = 'S3' AS INT) AS t_third, round(length(b1)::DOUBLE / length(a1), 5) AS name_length_ratio
  FROM (SELECT *, array_to_string(x, ' ') AS a1, array_to_string(y, ' ') AS b1 FROM (SELECT *, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(qn), '[^a-z0-9]+', ' ', 'g')), ' '), lambda v: v NOT IN ('ltd', 'inc')))) AS x, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(tn), '[^a-z0-9]+', ' ', 'g')), ' '), lambda v: v NOT IN ('ltd', 'inc')))) AS y FROM pc))""", PART_RECORDS)  # fmt: skip
def l_resolver_features(w):
    records = _part_records(w)
    side = lambda s: records.select(F.col("entity_id").alias(s), F.col("business_name").alias(f"{s}n"), F.col("business_address").alias(f"{s}a"))
    rows = V.resolver_features(_part_pairs(records).join(side("q"), "q").join(side("t"), "t"))
    return rows.select("q", "t", *[F.col(c).cast("int").alias(c) for c in ("name_equal", "q_no_address", "name_within", "t_third")], *[F.round(c, 5).alias(c) for c in ("name_jaccard", "name_length_ratio")])


SPELLED = RECORDS + ", map_ AS (SELECT DISTINCT n, strip_accents(n) AS spelling FROM nrm WHERE NOT regexp_full_match(n, '[\\x00-\\x7F]*')), sp AS (SELECT nrm.entity_id, country, coalesce(spelling, nrm.n) AS n, a FROM nrm LEFT JOIN map_ USING (n))\n"


@register("t_spelled", "SELECT entity_id, n FROM sp", SPELLED)
def t_spelled(w):
    return _spelled(w).select("entity_id", "n")


def _spelled(w):
    n = w.norm
    rows = n.queries.unionByName(n.targets)
    table = rows.filter(F.col("n").rlike(r"[^\x00-\x7F]")).select("n", T.strip_accents(F.col("n")).alias("spelling")).distinct()
    return M.transliterated(F.col("n"), table, rows, "spelled").select("entity_id", "country", F.col("spelled").alias("n"), "a")


@register("r_spelled_char3_topk", TOP.format(k=100), grams_sql().replace("FROM nrm WHERE length(n) >= 3", "FROM sp WHERE length(n) >= 3").replace("docs AS (SELECT country, count(*) AS texts FROM t WHERE", "docs AS (SELECT country, count(*) AS texts FROM sp WHERE left(entity_id, 2) <> 'S1' AND").replace(RECORDS, SPELLED))
def r_spelled_char3_topk(w):
    rows = _spelled(w)
    q, t = rows.filter("entity_id LIKE 'S1-%'"), rows.filter("entity_id NOT LIKE 'S1-%'")
    found = R.gram_route(q, t, t, name="spelled_char3")
    return found.select("source1_entity_id", "target_id", F.round("route_score", 4).alias("route_score"))


@register("r_word_topk", """SELECT source1_entity_id, target_id, round(route_score, 4) AS route_score FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, left(target_id, 2) ORDER BY route_score DESC, target_id) AS k FROM sim WHERE route_score > 0) WHERE k <= 20 AND route_score >= 0.05""",
  RECORDS + """,
gr AS (SELECT entity_id, country, unnest(string_split(n, ' ')) AS gram FROM nrm WHERE n <> ''),
tf AS (SELECT entity_id, country, gram, 1 + ln(count(*)) AS tf, count(*) AS c FROM gr GROUP BY ALL),
docs AS (SELECT country, count(*) AS texts FROM t WHERE n <> '' GROUP BY 1),
idf AS (SELECT country, gram, ln((1.0 + texts) / (1.0 + df)) + 1 AS idf FROM (SELECT country, gram, count(*) AS df FROM tf WHERE left(entity_id, 2) <> 'S1' GROUP BY ALL HAVING count(*) >= 2) JOIN docs USING (country) WHERE df <= texts * 0.5::DOUBLE),
wt0 AS (SELECT entity_id, country, gram, tf * idf AS w FROM tf JOIN idf USING (country, gram)),
wt AS (SELECT entity_id, country, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS weight FROM wt0),
sim AS (SELECT q.entity_id AS source1_entity_id, x.entity_id AS target_id, round(sum(q.weight * x.weight), 9) AS route_score FROM wt q JOIN wt x USING (country, gram) WHERE left(q.entity_id, 2) = 'S1' AND left(x.entity_id, 2) <> 'S1' GROUP BY ALL)
""")  # fmt: skip
def r_word_topk(w):
    n = w.norm
    rows = R.gram_route(n.queries, n.targets, n.targets, n=1, k=20, name="word", analyzer="word", sublinear=True, max_share=0.5, min_score=0.05)
    return rows.select("source1_entity_id", "target_id", F.round("route_score", 4).alias("route_score"))


def _text_sql(name: str, a: str, b: str) -> str:
    """Text features of two columns that SQL has, zero where one is blank."""
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    both, size = f"len(list_intersect({x}, {y}))", lambda v: f"len(list_distinct({v}))"
    found = {
        "exact": f"CAST({a} = {b} AS DOUBLE)", "jaro_winkler": f"jaro_winkler_similarity({a}, {b})", "levenshtein": f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE",
        "jaccard": f"{both}::DOUBLE / len(list_distinct(list_concat({x}, {y})))", "dice": f"2.0::DOUBLE * {both} / ({size(x)} + {size(y)})", "containment": f"{both}::DOUBLE / least({size(x)}, {size(y)})",
        "length_ratio": f"least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}))", "first_equal": f"CAST({x}[1] = {y}[1] AS DOUBLE)", "last_equal": f"CAST({x}[-1] = {y}[-1] AS DOUBLE)",
    }
    return ", ".join(f"round(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE {v} END, 4) AS {name}_{k}" for k, v in found.items())


_N = "list_distinct(regexp_extract_all({0}, '[0-9]+'))"
_Z = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))"


def _number_sql(name: str, form: str) -> str:
    x, y = form.format("sa"), form.format("ta")
    both = f"len(list_intersect({x}, {y}))"
    return f"CAST({both} > 0 AS INT) AS {name}_overlap, CAST(len({x}) > 0 AND len({y}) > 0 AND {both} = 0 AS INT) AS {name}_conflict, round(coalesce({both}::DOUBLE / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0), 4) AS {name}_jaccard"


_FIRST = "regexp_extract({0}, '[0-9]+')"
_TEXT = ("exact", "jaro_winkler", "levenshtein", "jaccard", "dice", "containment", "length_ratio", "first_equal", "last_equal")
_FLAGS = ("query_address_missing", "target_address_missing", "country_equal", "target_is_s2", "numeric_overlap", "numeric_conflict", "canonical_overlap", "canonical_conflict", "first_number_equal", "first_number_conflict")


@register("l_pair_features", f"""SELECT q AS source1_entity_id, t AS target_id, {_text_sql("name", "sn", "tn")}, {_text_sql("address", "sa", "ta")}, CAST(sa = '' AS INT) AS query_address_missing, CAST(ta = '' AS INT) AS target_address_missing, 1 AS country_equal, CAST(left(t, 2) = 'S2' AS INT) AS target_is_s2,
  {_number_sql("numeric", _N)}, {_number_sql("canonical", _Z)}, CAST({_FIRST.format("sa")} <> '' AND {_FIRST.format("sa")} = {_FIRST.format("ta")} AS INT) AS first_number_equal, CAST({_FIRST.format("sa")} <> '' AND {_FIRST.format("ta")} <> '' AND {_FIRST.format("sa")} <> {_FIRST.format("ta")} AS INT) AS first_number_conflict
  FROM (SELECT q, t, x.n AS sn, x.a AS sa, y.n AS tn, y.a AS ta FROM cand JOIN d x ON x.entity_id = q JOIN d y ON y.entity_id = t)""", PART_RECORDS)  # fmt: skip
def l_pair_features(w):
    from kindred.sources import roles

    raw = _part_records(w)
    norm = roles.normalized(raw)
    side = lambda key, s: norm.select(F.col("entity_id").alias(key), F.col("n").alias(f"{s}n"), F.col("a").alias(f"{s}a"), F.col("country").alias(f"{s}c"))
    pairs = _part_pairs(raw).select(F.col("q").alias("source1_entity_id"), F.col("t").alias("target_id"))
    made = M.pair_features(pairs.join(side("source1_entity_id", "s"), "source1_entity_id").join(side("target_id", "t"), "target_id"))
    parts = [f"{n}_{k}" for n in ("name", "address") for k in _TEXT] + ["numeric_jaccard", "canonical_jaccard"]
    return made.select("source1_entity_id", "target_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in parts], *[F.col(c).cast("int").alias(c) for c in _FLAGS])


@register("l_mined_phrases")
def l_mined_phrases(w):
    """Replacements between the names of candidate pairs that agree in their first word."""
    from kindred.sources import roles

    raw = _part_records(w)
    names = roles.normalized(raw).select("entity_id", "n")
    rows = _part_pairs(raw).join(names.withColumnsRenamed({"entity_id": "q", "n": "qn"}), "q").join(names.withColumnsRenamed({"entity_id": "t", "n": "tn"}), "t")
    near = rows.filter(F.substring_index("qn", " ", 1) == F.substring_index("tn", " ", 1))
    return M.mined_phrases(near, "tn", "qn", "q", support=2, entities=2, share=0.2)


def _bounds_sql() -> str:
    return f"""SELECT count(*) AS records, round(avg(f), 6) AS mean, round(stddev_samp(f) / sqrt(count(*)), 6) AS se, round(avg(f) - 1.96::DOUBLE * stddev_samp(f) / sqrt(count(*)), 6) AS low, round(avg(f) + 1.96::DOUBLE * stddev_samp(f) / sqrt(count(*)), 6) AS high
  FROM (SELECT {F05} AS f FROM (SELECT e.q, count(c.t) AS predicted, count(x.t) AS tp, actual FROM entities e LEFT JOIN (SELECT q, t FROM claims WHERE p >= 0.7) c USING (q) LEFT JOIN truth x ON x.q = c.q AND x.t = c.t GROUP BY e.q, actual))"""


@register("d_normal_interval", _bounds_sql(), CLAIMS)
def d_normal_interval(w):
    return M.normal_interval(D.entity_scores(w.claims.filter("p >= 0.7"), w.truth, w.entities), "f05").withColumns({c: r6(c) for c in ("mean", "se", "low", "high")})


@register("d_paired_difference", f"""SELECT count(*) AS records, round(avg(g - f), 6) AS mean, round(stddev_samp(g - f) / sqrt(count(*)), 6) AS se, round(avg(g - f) - 1.96::DOUBLE * stddev_samp(g - f) / sqrt(count(*)), 6) AS low, round(avg(g - f) + 1.96::DOUBLE * stddev_samp(g - f) / sqrt(count(*)), 6) AS high FROM
  (SELECT q, {F05} AS f FROM (SELECT e.q, count(c.t) AS predicted, count(x.t) AS tp, actual FROM entities e LEFT JOIN (SELECT q, t FROM claims WHERE p >= 0.7) c USING (q) LEFT JOIN truth x ON x.q = c.q AND x.t = c.t GROUP BY e.q, actual)) JOIN
  (SELECT q, {F05} AS g FROM (SELECT e.q, count(c.t) AS predicted, count(x.t) AS tp, actual FROM entities e LEFT JOIN (SELECT q, t FROM claims WHERE p >= 0.9) c USING (q) LEFT JOIN truth x ON x.q = c.q AND x.t = c.t GROUP BY e.q, actual)) USING (q)""", CLAIMS)  # fmt: skip
def d_paired_difference(w):
    scores = lambda p: D.entity_scores(w.claims.filter(F.col("p") >= p), w.truth, w.entities)
    both = C.joined_once(scores(0.7).select("q", F.col("f05").alias("f")), scores(0.9).select("q", F.col("f05").alias("g")), ["q"])
    return M.normal_interval(both.withColumn("d", F.col("g") - F.col("f")), "d").withColumns({c: r6(c) for c in ("mean", "se", "low", "high")})
