"""Texts are sent to their pairs in jobs of bounded size."""

from kindred.llm import overlap


def test_texts_go_to_their_pairs_in_several_jobs(spark, monkeypatch):
    assert overlap.slices(10 * overlap.SENT, 2 * overlap.SENT) == 5 and overlap.slices(0, 0) == 1
    monkeypatch.setattr(overlap, "slices", lambda sent, stored: 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(20)] + [(99, "another text without a copy")]
    found = overlap.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=100)
    assert sorted(r.component_id for r in found.collect()) == [0] * 20 + [99]
