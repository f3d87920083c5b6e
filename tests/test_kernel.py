"""Blocked products, indexes, verified stores and stage-two kernels against plain Python."""

import difflib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.operators import features as V
from kindred.operators import kernel, models, routes
from kindred.operators import ranking as K
from kindred.sources import delimited


def vectors(rng, n, prefix):
    rows = []
    for i in range(n):
        terms = rng.sample(range(40), rng.randint(0, 6))
        rows.append((f"{prefix}-{i:03d}", rng.choice(["x", "y", None]), prefix if prefix == "S1" else rng.choice(["S2", "S3"]), terms, [rng.choice([0.25, 0.5, 1.0]) for _ in terms]))
    return rows


@pytest.mark.parametrize("sizes", [(1024, 4096), (7, 5), (1, 1)])
def test_blocks_do_not_change_the_best(spark, sizes):
    rng = random.Random(1)
    qs, ts = vectors(rng, 30, "S1"), vectors(rng, 80, "T")
    kinds = "id string, country string, source string, terms array<long>, weights array<double>"
    found = kernel.top_products(spark.createDataFrame(qs, kinds).drop("source"), spark.createDataFrame(ts, kinds), "country", kernel.sparse, 3, sizes)
    expected = []
    for q, qc, _, qt, qw in qs:
        for side in ("S2", "S3"):
            scored = []
            for t, tc, ts_, tt, tw in ts:
                s = round(sum(a * b for (x, a), (y, b) in itertools.product(zip(qt, qw, strict=True), zip(tt, tw, strict=True)) if x == y), 9)
                if qc is not None and qc == tc and ts_ == side and s > 0:
                    scored.append((-s, t))
            expected += [(q, t, -s, i + 1) for i, (s, t) in enumerate(sorted(scored)[:3])]
    assert sorted((r.q, r.t, r.score, r["rank"]) for r in found.collect()) == sorted(expected)


def test_an_index_gives_the_route_it_was_made_of(spark, tmp_path):
    rng = random.Random(2)
    name = lambda: " ".join(rng.choice(["acme", "tool", "works", "blue", "bolt"]) for _ in range(3))
    rows = [(f"S1-{i}", rng.choice("ab"), name(), "") for i in range(20)] + [(f"S{rng.choice('23')}-{i}", rng.choice("ab"), name(), "") for i in range(60)]
    every = spark.createDataFrame(rows, "entity_id string, country string, n string, a string")
    q, t = every.filter("entity_id LIKE 'S1%'"), every.filter("entity_id NOT LIKE 'S1%'")
    idf = routes.gram_idf(t, "n", 3)
    delimited.write_index(routes.gram_vectors(t, "n", 3, idf), idf, f"{tmp_path}/index")
    again = routes.index_route(q, *delimited.read_index(spark, f"{tmp_path}/index"), k=5)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again) == key(routes.gram_route(q, t, t, k=5)) and again.count()


def test_analyzers(spark):
    df = spark.createDataFrame([("ab c",), ("",)], "t string")
    get = lambda *a: [r[0] for r in df.select(routes.grams(F.col("t"), *a)).collect()]
    assert get(3) == [["ab ", "b c"], []] and get(3, "char_wb") == [[" ab", "ab ", " c "], []] and get(2, "word") == [["ab c"], []]


def test_objects_are_stored_once(spark, tmp_path):
    at = f"{tmp_path}/object.json"
    digest = delimited.write_report(spark, at, {"b": 1, "a": None})
    assert delimited.write_report(spark, at, {"a": None, "b": 1}) == digest and delimited.read_config(spark, at, ["a", "b"]) == {"a": None, "b": 1}
    assert delimited.read_object(spark, at + ".sha256").decode() == digest
    with pytest.raises(FileExistsError):
        delimited.put_object(spark, at, b"other")
    with pytest.raises(ValueError):
        delimited.read_config(spark, at, ["a"])
    delimited.write_tsv(spark.createDataFrame([(1, 'a "b"'), (2, None)], "k int, t string").coalesce(1), f"{tmp_path}/rows")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/rows").collect()) == ['1\ta "b"', "2\t", "k\tt"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_partial_ratio_is_that_of_all_windows():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        x, y = sorted((a, b), key=len)
        if not x:
            continue
        windows = [y[max(0, e - len(x)) : min(e, len(y))] for e in range(1, len(y) + len(x))]
        assert S.partial_ratio(a, b) == pytest.approx(max(2 * plain_lcs(x, w) / (len(x) + len(w)) for w in windows)), (a, b)


def test_editops_turn_one_text_into_the_other():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        ops = S.editops(a, b)
        out, shift = list(a), 0
        for kind, i, j in ops:
            if kind == "replace":
                out[i + shift] = b[j]
            elif kind == "delete":
                del out[i + shift]
                shift -= 1
            else:
                out.insert(i + shift, b[j])
                shift += 1
        assert "".join(out) == b and len(ops) == S.edit_distance(a, b)


def test_morphology_of_equal_and_unlike_texts():
    same, unlike = S.morphology("acme tool works", "acme tool works"), S.morphology("atw", "acme tool works")
    assert len(same) == 17 and all(v == pytest.approx(1) for k, v in same.items() if k != "acronym_of") and unlike["acronym_of"] == 1.0 and unlike["jaccard"] == 0
    assert S.morphology("", "")["ratio"] == 1.0 and difflib.SequenceMatcher(None, "", "").ratio() == 1.0


def test_number_relations():
    assert [V.relation("12", x) for x in (["12"], ["123"], ["13"], ["9"], [], ["312", "12"])] == [1, 2, 3, 0, 0, 1]
    assert V.relation("1234", ["234", "34"]) == 2 and V.relation("12345", ["234"]) == 4 and V.relation("12345", ["234", "12346"]) == 3 and V.relation("1", ["12"]) == 0


def test_stage_two_features_of_a_pair(spark):
    rows = [("S1-1", "x", "Acme Tool Works Pvt Ltd", "4-03 Park Ave, New York"), ("S2-1", "x", "ACME tool workz", "403 park avenue NY"), ("S3-2", "x", "Zeta www.zeta.com", None), ("S1-3", "x", None, "")]
    held = V.described(spark.createDataFrame(rows, "entity_id string, country string, business_name string, business_address string"))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-3", "S2-1")], "q string, t string")
    made = V.pair_features(pairs, held, held.filter("entity_id LIKE 'S1%'"))
    names = [c for c in made.columns if c not in ("q", "t")]
    assert len(names) == 48
    near, far, none = (r.asDict() for r in made.orderBy("q", "t").collect())
    assert near["core_jaccard"] == 0.5 and near["core_cover_q"] == 1.0 and near["state_equal"] == 1.0 and near["state_conflict"] == 0.0
    assert near["number_exact"] == pytest.approx(1 / 3) and near["number_first"] == 5.0 and near["number_q_unmatched"] >= 1 and near["t_second"] == 1.0
    assert near["skeleton_jw"] > near["core_jw"] - 0.05 and near["initials_match"] == 0.0
    assert far["t_address_missing"] == 1.0 and far["t_domain"] == 1.0 and far["address_jaccard"] == 0.0 and far["number_q_unmatched"] == -1.0
    assert none["core_jw"] == 0.0 and none["q_address_missing"] == 1.0 and all(v is not None and math.isfinite(v) for k, v in none.items() if k not in ("q", "t"))
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.95), ("S1-1", "S3-2", 0.4)], "q string, t string, p double")
    both = {r.t: r for r in V.context_features(scored, held).collect()}
    assert both["S2-1"]["rank"] == 1 and both["S2-1"].sibling_name == 0.0 and both["S3-2"].n_strong == 1 and both["S3-2"].gap_top == pytest.approx(0.55)
    assert len(K.qnorm(made, names).columns) == 2 + 96


def test_resolver_features_and_spelled_comparison(spark):
    df = spark.createDataFrame([("S1-1", "S3-1", "Société X SARL", "007 r. de Paris", "x societe", "7 rue de paris"), ("S1-2", "S2-2", None, None, "", "")], "q string, t string, qn string, qa string, tn string, ta string")
    one, two = V.resolver_features(df).orderBy("q").collect()
    assert len(one) == 16 and (one.name_equal, one.address_equal, one.first_number_equal, one.numbers_shared, one.t_third, one.address_grams) == (1, 1, 1, 1, 1, 1)
    assert two.q_no_address == 1 and two.numbers_differing == -1 and two.name_within == 0
    found = df.select(*[c.alias(k) for k, c in V.compare_spelled(F.lit("acme tool"), F.lit("tool acme")).items()]).first()
    assert found.spelled_exact == 0 and found.spelled_token_sort == 1.0


def labelled(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        rows.append((f"S1-{i // 3}", f"S2-{i}", i // 3 % 3, -1, label, label + rng.gauss(0, 0.4), rng.random()))
    return spark.createDataFrame(rows, "source1_entity_id string, target_id string, fold int, owner_fold int, label int, name_x double, address_x double")


def test_nested_folds_ablation_and_stackers(spark):
    rows = labelled(spark).cache()
    queries = rows.groupBy(F.col("source1_entity_id").alias("q"), "fold").agg(F.sum("label").alias("actual"))
    nested = models.nested_out_of_fold(rows, ["name_x", "address_x"], [0, 1, 2], queries, 3).collect()
    assert sorted(r.fold for r in nested) == [0, 1, 2] and all(0 < r.threshold < 1 and r.macro_f05 > 0.5 for r in nested)
    table = {r.dropped: r for r in models.ablation(rows, ["name_x", "address_x"], {"name": ["name_"], "address": ["address_"]}, [0, 1, 2], 3).collect()}
    assert table["none"].auc > 0.85 and table["name"].auc < 0.65 < table["address"].auc and table["name"].features == 1
    scored = rows.withColumn("p", 1 / (1 + F.exp(-F.col("name_x"))))
    smooth = models.isotonic(scored)(scored).orderBy("p").collect()
    assert all(a.calibrated <= b.calibrated + 1e-9 for a, b in zip(smooth, smooth[1:], strict=False))
    stack = models.stacked(scored, extra=["address_x"])(scored)
    assert models.rank_auc(stack, "stacked", "label").first().auc > 0.85 and set(rows.columns) < set(stack.columns)
