"""Results that must not depend on the order of additions or on what a character is."""

import duckdb

from kindred.operators import routes as R
from kindred.operators import slices as L
from kindred.plans import catalog, extended  # noqa: F401


def test_fused_scores_that_agree_in_twelve_digits_are_ties(spark):
    ranks = {"S2-a": (1, 24, 80), "S2-b": (1, 45, 45)}  # one sum, but not in doubles
    rows = [("S1-1", t, f"r{i}", k) for t, ks in ranks.items() for i, k in enumerate(ks)]
    ranked = spark.createDataFrame(rows, "source1_entity_id string, target_id string, route string, route_rank int")
    assert {r.target_id: r.candidate_rank for r in R.fuse(ranked).collect()} == {"S2-a": 1, "S2-b": 2}


def test_route_scores_that_agree_in_nine_digits_are_ties(spark):
    rows = [("S1-1", "S2-a", "r", 1.5), ("S1-1", "S2-b", "r", 1.5 + 1e-12)]
    routes = spark.createDataFrame(rows, "source1_entity_id string, target_id string, route string, route_score double")
    assert {r.target_id: r.route_rank for r in R.rank_routes(routes).collect()} == {"S2-a": 1, "S2-b": 2}


def test_edit_profile_counts_bytes_as_its_sql(spark):
    pairs = [("straße", "strave"), ("aßßb", "axyb"), ("aßßßb", "axyzb"), ("日本 x", "ab x"), ("abc", "abd"), ("été", "ete")]
    df = spark.createDataFrame(pairs, "x string, y string")
    found = {r.kind: r.n for r in L.edit_profile(df, df.x, df.y).collect()}
    case = catalog.SQL["a_edit_profile"]
    kind = case[case.index("CASE WHEN x = y") : case.index(" END AS kind") + 4]
    values = ", ".join(f"('{x}', '{y}')" for x, y in pairs)
    assert found == dict(duckdb.sql(f"SELECT {kind} AS kind, count(*) FROM (VALUES {values}) v(x, y) GROUP BY 1").fetchall())


def test_edit_profile_reads_whole_names(spark, tmp_path):
    head = "a long name that goes on " * 5  # 125 characters before anything differs
    names = [head + x for x in ("one", "one", "onex", "one two three")] + ["b" * 90 + x for x in ("cde", "xyz")]
    rows = [(i, n, "en", f"src{i % 20:03d}", len(n)) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.kind: r.n for r in catalog.QUERIES["a_edit_profile"](spark, str(tmp_path)).collect()}
    assert found == {"same": 1, "contained": 1, "edit_6_up": 2, "edit_3_5": 1}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(con.sql(catalog.SQL["a_edit_profile"]).fetchall())
