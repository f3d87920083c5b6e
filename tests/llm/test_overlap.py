"""The near-duplicate stage of the pipeline against brute force over five-word shingles."""

import random

import corpus_pipeline as P
import pytest

from kindred.llm import overlap


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]

    def edited(text, times):
        out = list(text)
        for _ in range(times):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    opening = prose(40)
    docs = [prose(120) for _ in range(30)]
    docs += [edited(t, 1) for t in docs[:20]] + [edited(t, rng.randint(1, 6)) for t in docs[:20]]
    docs += [opening + prose(30) for _ in range(40)]
    one = opening + prose(60)
    docs += [edited(one, rng.randint(0, 3)) for _ in range(60)]
    docs += [prose(n) for n in (1, 2, 3, 4, 5, 6)] * 2 + [[], []]
    rng.shuffle(docs)
    return [(i, " ".join(t)) for i, t in enumerate(docs)] + [(None, " ".join(docs[0])), (999, None)]


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), k) if x is not None], default=None)
    return sorted(((k, least[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("small", "block"), [(16, 2048), (2, 5)])
def test_components_are_those_of_all_similar_pairs(spark, small, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = overlap.near_duplicates(df, small=small, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_one_changed_word_goes_in_the_pipeline(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(120)]
        rows += [(i, " ".join(text)), (1001 + i, " ".join([*text[:60], "another", *text[61:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == list(range(60))
