"""u_fused_caps takes its ranks from scores of twelve digits."""

from types import SimpleNamespace

from kindred.plans import catalog, extended  # noqa: F401


def test_ranks_of_fused_caps_ignore_the_last_digits(spark, monkeypatch):
    ranks = {"S2-a": (1, 24, 80), "S2-b": (1, 45, 45)}  # one sum, but not in doubles
    rows = [("S1-1", t, f"r{i}", k) for t, ks in ranks.items() for i, k in enumerate(ks)]
    ranked = spark.createDataFrame(rows, "source1_entity_id string, target_id string, route string, route_rank int")
    found = extended.u_fused_caps(SimpleNamespace(ranked=ranked)).collect()
    assert {r.target_id: r.candidate_rank for r in found} == {"S2-a": 1, "S2-b": 2}
