import pytest

from kindred.operators import decisions as D
from kindred.operators import ranking as K
from kindred.operators import routes as R
from kindred.sources import delimited, roles


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("tp", "predicted", "actual", "expected"), [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 1, 0.0), (2, 3, 2, 5 / 7), (1, 1, 2, 5 / 6), (1, 2, 1, 5 / 9)]
)
def test_f05(spark, tp, predicted, actual, expected):
    row = frame(spark, "tp int, p int, a int", (tp, predicted, actual))
    assert row.select(D.f05(row.tp, row.p, row.a).alias("f")).first()["f"] == pytest.approx(expected)


def test_threshold_sweep_prefers_the_higher_of_a_tie(spark):
    scored = frame(spark, "q long, t string, p double, y int", (1, "S2-a", 0.8, 1), (1, "S2-b", 0.3, 0), (2, "S2-c", 0.4, 0))
    queries = frame(spark, "q long, actual long", (1, 1), (2, 0), (3, 0))
    sweep = D.threshold_sweep(scored, queries)
    assert sweep.count() == 99
    best = D.best_threshold(sweep).first()
    assert best["threshold"] == pytest.approx(0.80) and best["macro_f05"] == pytest.approx(1.0)


SCORED = "q string, t string, p double"


def test_rules(spark):
    rows = frame(spark, SCORED, ("a", "S2-1", 0.9), ("a", "S3-1", 0.5), ("a", "S2-2", 0.8), ("b", "S2-3", 0.5), ("b", "S3-3", 0.5))
    pick = lambda rule, **o: pairs_of(D.decide(rows, rule, 0.7, **o), "q", "t")
    assert pick("global") == [("a", "S2-1"), ("a", "S2-2")]
    assert pick("salvage", other=0.5) == [("a", "S2-1"), ("a", "S2-2"), ("b", "S2-3")]
    assert pick("two_source", other=0.5) == [("a", "S2-1"), ("a", "S2-2"), ("a", "S3-1")]
    assert pick("cap", cap=1) == [("a", "S2-1")]
    assert pick("margin", other=0.05) == [("a", "S2-1")]


def test_expected_prefix_takes_the_shorter_of_a_tie_and_may_be_empty(spark):
    rows = frame(spark, SCORED, ("a", "S2-1", 0.95), ("a", "S2-2", 0.9), ("a", "S2-3", 0.05), ("b", "S2-4", 0.1))
    assert pairs_of(D.expected_prefix(rows), "q", "t") == [("a", "S2-1"), ("a", "S2-2")]


def test_ownership(spark):
    rows = frame(spark, SCORED, ("a", "t", 0.9), ("b", "t", 0.9), ("c", "t", 0.5), ("c", "u", 0.4))
    assert pairs_of(D.owned(rows), "q", "t") == [("a", "t"), ("c", "u")]
    assert pairs_of(D.owned(rows, "max"), "q", "t") == [("b", "t"), ("c", "u")]
    assert pairs_of(D.ownership_variant(rows, "drop_close"), "q", "t") == [("c", "u")]
    assert len(pairs_of(D.ownership_variant(rows, "margin"), "q", "t")) == 4
    assert len(pairs_of(D.ownership_variant(rows, "none"), "q", "t")) == 4


def test_source_completion_and_conflicts(spark):
    chosen = frame(spark, SCORED, ("a", "S2-1", 0.9), ("b", "S2-2", 0.9))
    scored = frame(spark, SCORED, ("a", "S3-1", 0.6), ("b", "S3-1", 0.7), ("a", "S3-2", 0.54), ("a", "S2-9", 0.99))
    assert pairs_of(D.complete_sources(chosen, scored), "q", "t") == [("a", "S2-1"), ("b", "S2-2"), ("b", "S3-1")]


def test_additions_expansion_overrides_swap(spark):
    chosen = frame(spark, SCORED, ("a", "S2-1", 0.9))
    extra = frame(spark, SCORED, ("b", "S2-1", 0.99), ("b", "S2-2", 0.85), ("c", "S2-2", 0.85), ("c", "S2-3", 0.7))
    assert pairs_of(D.add_unclaimed(chosen, extra), "q", "t") == [("a", "S2-1"), ("b", "S2-2")]
    targets = frame(spark, "entity_id string, country string, n string, a string", ("S2-1", "x", "n", None), ("S2-2", "x", "n", None), ("S2-3", "y", "n", None))
    assert pairs_of(D.expand_copies(chosen, targets), "q", "t") == [("a", "S2-1"), ("a", "S2-2")]
    overrides = frame(spark, "q string, t string, keep boolean", ("a", "S2-1", False), ("b", "S2-1", True), ("c", "S2-1", True), ("c", "S2-7", True))
    assert pairs_of(D.apply_overrides(chosen, overrides), "q", "t") == [("b", "S2-1"), ("c", "S2-7")]
    groups = frame(spark, "q string, country string", ("a", "x"), ("b", "y"))
    assert pairs_of(D.swap_group(chosen, extra, groups, ["x"]), "q", "t") == []


def test_loss_parts_add_up(spark):
    truth = frame(spark, "q string, t string", ("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"))
    scored = frame(spark, "q string, t string", ("a", "1"), ("a", "2"), ("a", "9"), ("c", "8"))
    chosen = frame(spark, "q string, t string", ("a", "1"), ("a", "9"), ("c", "8"))
    queries = frame(spark, "q string", ("a",), ("b",), ("c",), ("d",))
    for r in D.loss_parts(scored, chosen, truth, queries).collect():
        assert r.loss == pytest.approx(r.singleton_merge + r.false_pairs + r.rejected_links + r.unretrieved_links)


def test_validate(spark):
    lists = frame(spark, "q string, t string", ("S1-a", "S2-1"), ("S1-a", "S2-1"), ("S1-x", "T-9"), ("S1-b", None))
    found = {r.check: r.violations for r in D.validate(lists, lists, frame(spark, "q string", ("S1-a",), ("S1-b",), ("S1-c",)), frame(spark, "t string", ("S2-1",))).collect()}
    assert found == {"missing_query": 1, "unknown_query": 1, "repeated_pair": 1, "bad_prefix": 1, "unknown_target": 1, "not_a_candidate": 0, "shared_target": 0}


def test_windows(spark):
    rows = frame(spark, "q string, t string, p double, ce double", ("a", "1", 0.0, None), ("a", "2", 0.0, 0.5), ("b", "3", 0.4, 0.2))
    context = {r.t: r for r in K.query_context(rows, ["p"]).collect()}
    assert context["1"].p_rel == 0 and context["3"].p_rel == 1
    z = {r.t: r.p_z for r in K.qnorm(rows, ["p"]).collect()}
    assert z == {"1": 0.0, "2": 0.0, "3": 0.0}
    ranked = {r.t: r.ce_rank for r in K.rank_ignoring_nulls(rows, "ce").collect()}
    assert ranked == {"1": None, "2": 1, "3": 1}
    assert {r.q: r.margin for r in K.top_margin(rows).collect()} == {"a": 0.0, "b": 0.4}


def test_exact_and_token_routes(spark):
    schema = "entity_id string, country string, n string, a string"
    q = frame(spark, schema, ("S1-1", "x", "acme tools", "12 main road"), ("S1-2", "x", "", ""))
    t = frame(spark, schema, ("S2-1", "x", "acme tools", "12 main road"), ("S2-2", "y", "acme tools", "12 main road"), ("S3-3", "x", "acme acme", "99 side"), ("S2-4", "x", "", ""))
    owners = frame(spark, "target_id string, owner_fold int", ("S2-1", 0), ("S2-2", -1), ("S3-3", 1), ("S2-4", -1))
    assert pairs_of(R.exact(q, t, ("n", "a"), "e"), "source1_entity_id", "target_id") == [("S1-1", "S2-1")]
    ranked = R.token_candidates(q, t, owners)
    assert pairs_of(ranked, "target_id", "route") == [
        ("S2-1", "exact_address"), ("S2-1", "exact_name"), ("S2-1", "numeric_name"), ("S2-1", "rare_address"), ("S2-1", "rare_name"), ("S3-3", "rare_name"),
    ]
    fused = R.fuse(ranked).collect()
    assert fused[0].target_id == "S2-1" and fused[0].candidate_rank == 1
    assert fused[0].routes == "exact_address,exact_name,numeric_name,rare_address,rare_name"


def test_gram_route_drops_zero_scores_and_breaks_ties_by_id(spark):
    schema = "entity_id string, country string, n string, a string"
    q = frame(spark, schema, ("S1-1", "x", "abcdef", ""))
    t = frame(spark, schema, *[(f"S2-{i}", "x", "abcdef", "") for i in range(5)], ("S2-9", "x", "zzzzzz", ""), ("S2-8", "x", "zzzzzz", ""))
    rows = R.gram_route(q, t, t, k=3).collect()
    assert [(r.target_id, r.route_rank) for r in sorted(rows, key=lambda r: r.route_rank)] == [("S2-0", 1), ("S2-1", 2), ("S2-2", 3)]


def test_key_blocks_cap(spark):
    from pyspark.sql import functions as F

    schema = "entity_id string, country string, n string"
    q = frame(spark, schema, ("S1-1", "x", "k"))
    t = frame(spark, schema, *[(f"S2-{i}", "x", "k") for i in range(3)])
    assert R.key_blocks(q, t, F.col("n"), cap=3).count() == 3
    assert R.key_blocks(q, t, F.col("n"), cap=2).count() == 0


def test_folds_and_shards(spark):
    import hashlib

    from pyspark.sql import functions as F

    ids = [f"S1-{i}" for i in range(50)]
    rows = frame(spark, "i string", *[(i,) for i in ids]).select("i", roles.fold(F.col("i")).alias("f"), roles.shard(F.col("i"), 64).alias("s")).collect()
    for r in rows:
        assert r.f == int(hashlib.sha256(f"20260925|{r.i}".encode()).hexdigest()[:8], 16) % 5
        assert r.s == int.from_bytes(hashlib.sha256(r.i.encode()).digest()[:8], "big") % 64
    with pytest.raises(ValueError):
        roles.fold(F.col("i"), folds=1)


def test_tsv_is_strict_and_lossless(spark, tmp_path):
    good = tmp_path / "a.tsv"
    good.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tX\nS1-2\t"q\tNULL\té\n', encoding="utf-8")
    rows = delimited.read_tsv(spark, str(good)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", "NA", "", "X"), ("S1-2", '"q', "NULL", "é")]
    bad = tmp_path / "b.tsv"
    bad.write_text("id\tname\n1\t2\n")
    with pytest.raises(ValueError):
        delimited.read_tsv(spark, str(bad))


def test_lists_round_trip_and_reject(spark, tmp_path):
    queries = frame(spark, "entity_id string", ("S1-1",), ("S1-2",))
    pairs = frame(spark, "source1_entity_id string, target_id string", ("S1-1", "S3-1"), ("S1-1", "S2-1"))
    path = str(tmp_path / "lists")
    delimited.write_lists(delimited.lists(queries, pairs), path)
    lines = sorted(line for part in (tmp_path / "lists").glob("part-*") for line in part.read_text().splitlines())
    assert lines == ["S1-1\tS2-1,S3-1", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    for bad in ("S2-1,S2-1", "S2-1,", " S2-1", "S1-4", "S2-1\t"):
        with pytest.raises(Exception):  # noqa: B017
            delimited.parse_lists(frame(spark, "source1_entity_id string, m string", ("S1-1", bad)), "m").collect()


def test_merge_shards_and_verified_write(spark, tmp_path):
    one, two = (frame(spark, "source1_entity_id string, x int", (f"S1-{i}", i)) for i in (1, 2))
    required = frame(spark, "entity_id string", ("S1-1",), ("S1-2",))
    assert delimited.merge_shards([one, two], required).count() == 2
    with pytest.raises(ValueError):
        delimited.merge_shards([one, one], required)
    with pytest.raises(ValueError):
        delimited.merge_shards([one], required)
    assert delimited.write_verified(one, str(tmp_path / "v"), ["x"]).count() == 1
