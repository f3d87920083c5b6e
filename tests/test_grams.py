"""The n-gram route over written targets: equal to the blocked products for any chunks, and nothing is sent twice."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from kindred.operators import grams, routes
from kindred.sources import views


def _sides(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("ab 😀") for _ in range(rng.randint(0, 20)))
    side = lambda heads, n: [(f"{rng.choice(heads)}-{i}", rng.choice(["x", "y", ""]), text()) for i in range(n)]
    kinds = "entity_id string, country string, n string"
    return spark.createDataFrame([*side(["S1"], 60), ("S1-z", "y", "abqab c"), ("S1-zz", "y", "abqab c"), ("S1-y", "z", "abc")], kinds), spark.createDataFrame(side(["S2", "S3"], 150), kinds)


def test_whole_query_blocks_meet_written_targets(spark, monkeypatch):
    q, t = _sides(spark)
    key = lambda df: {(r.source1_entity_id, r.target_id): (r.route_rank, round(r.route_score, 9)) for r in df.collect()}
    blocks = key(routes.gram_route(q, t, t, k=4, sizes=(16, 32)))
    found = routes.gram_route(q, t, t, k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # blocks sent vectors once for each block of the other side and sorted the best of every pair of blocks
    assert "Window" not in plan and "FlatMapCoGroups" not in plan and plan.count("Exchange") == 1
    assert key(found) == blocks and len(blocks) > 100

    at = max(glob.glob(f"{views.folder(spark).removeprefix('file://')}/grams-*"), key=lambda p: os.path.getmtime(p))
    alphabet = np.array(sorted({ord(c) for r in t.collect() for c in r.n}), np.int64)
    rows = q.filter("n <> ''").selectExpr("xxhash64(country) AS g", "country", "entity_id AS id", "n").orderBy("g").toArrow()
    for name, value in {"TARGETS": 7, "DENSE": 64, "PRODUCT": 40, "EVENTS": 3, "TERMS": 20, "PIECE": 30, "COLUMNS": 2}.items():
        monkeypatch.setattr(grams, name, value)
    run = grams._matched(f"{at}/known", f"{at}/targets", alphabet, 3, 4, False)
    small = pa.Table.from_batches(list(run(rows.to_batches()))).to_pylist()
    assert {(r["q"], r["t"]): (r["rank"], round(r["score"], 9)) for r in small} == blocks


@pytest.mark.parametrize("largest", [1 << 62, 5000])
def test_grams_are_counted_within_their_text(monkeypatch, largest):
    monkeypatch.setattr(grams, "LARGEST", largest)
    alphabet = np.array(sorted(map(ord, "ab日")), np.int64)
    texts = ["abab", "", "b", "日ab", "a?ab", "bbbb"]
    row, gram, count = grams.gram_counts(texts, grams._digits(alphabet), 4, 2)
    spelled = ["".join("?ab日"[g // 4**j % 4] for j in (1, 0)) for g in gram.tolist()]
    want = [(i, g, n) for i, t in enumerate(texts) for g, n in sorted({t[j : j + 2]: sum(t[m : m + 2] == t[j : j + 2] for m in range(len(t) - 1)) for j in range(len(t) - 1) if "?" not in t[j : j + 2]}.items())]
    assert list(zip(row.tolist(), spelled, count.tolist(), strict=True)) == want


def test_best_of_chunks_are_the_best_of_all():
    rng = np.random.default_rng(3)
    scores = np.round(rng.random((20, 300)), 1)  # many ties
    best = grams._Best(20, 5)
    for at in range(0, 300, 60):
        for low in (0, 10):
            best.add(low, scores[low : low + 10, at : at + 60], at)
    for i in range(20):
        assert best.place[i].tolist() == sorted(range(300), key=lambda j: (-scores[i, j], j))[:5]
