"""What the near-duplicate and suffix stages move: few texts of dissimilar pairs, and few spans of a long passage."""

import random

import numpy as np
import pyarrow as pa

from kindred.llm import overlap, suffix


def test_long_dissimilar_texts_are_not_sent_to_their_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, own = words(3000), [words(3000) for _ in range(3)]
    near = shared + own[0][:-20] + words(20)
    rows = [(i, " ".join(t)) for i, t in enumerate([shared + own[0], shared + own[1], shared + own[2], near])]
    sent, slices = [], overlap.slices
    monkeypatch.setattr(overlap, "slices", lambda n, stored: sent.append(n) or slices(n, stored))
    found = overlap.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    assert sum(sent) <= 2 * len(rows[0][1])  # the texts of the similar pair only


def test_spans_of_a_passage_are_merged_by_text():
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(4000))
    texts = [b"a" * 300 + passage, b"b" * 250 + passage, passage + b"c" * 260]
    owner, at, _ = suffix.anchors(texts)
    at = [(at[owner == i] * 2).tolist() for i in range(3)]
    columns = [pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([1, 1, 1]), pa.array([t.decode() for t in texts]), pa.array(at)]
    batch = pa.RecordBatch.from_arrays(columns, ["k1", "k2", "copies", "text", "at"])
    rows = [r for b in suffix._contexts([batch]) for r in b.to_pylist() if r["s"] is not None]
    covered = {}
    for r in rows:
        covered.setdefault(r["k1"], []).append((r["s"], r["e"]))
    for key, begin in ((1, 300), (2, 250), (3, 0)):
        assert any(s <= begin + 200 and e >= begin + 3800 for s, e in covered[key])
    assert len(rows) <= 9


def test_merged_spans_cover_the_same_bytes():
    rng = np.random.default_rng(5)
    k1, k2, s = rng.integers(-2, 2, 500), rng.integers(0, 3, 500), rng.integers(0, 3000, 500)
    e = s + rng.integers(1, 60, 500)
    bytes_of = lambda *c: {(a, b, i) for a, b, x, y in zip(*(v.tolist() for v in c), strict=True) for i in range(x, y)}
    merged = suffix._merged(k1, k2, s, e)
    assert bytes_of(*merged) == bytes_of(k1, k2, s, e)
    assert len(merged[0]) < 500 and all(len(x) == 0 for x in suffix._merged(*(np.empty(0, np.int64),) * 4))
