"""Blocks of n-gram routes and overrides in bounded work."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import kernel, routes


def test_short_texts_make_few_blocks(spark):
    rows = spark.range(60_000).select(F.lit("x").alias("country"), F.lit(50).alias("terms"))
    count = lambda queries: kernel.term_blocks(rows, "country", F.col("terms"), queries).first()["blocks"]
    assert count(True) == 8 and count(False) == 1  # 59 and 15 blocks of 1024 and 4096 rows sent 60 times the vectors


def test_grams_are_counted_where_the_text_lies(spark):
    rows = spark.createDataFrame([("S2-1", "x", "abcabc"), ("S2-2", "x", "abcd")], "entity_id string, country string, n string")
    idf = routes.gram_idf(rows, "n", 3, 1, parts=3)
    plan = routes.gram_vectors(rows, "n", 3, F.broadcast(idf), parts=3)._jdf.queryExecution().executedPlan().toString()
    outer = plan.split("BroadcastExchange")[0]
    assert outer.count("Exchange hashpartitioning") <= 1 and "entity_id" in plan


@pytest.mark.parametrize("dense", [0, 200, 1 << 22])
def test_dense_columns_do_not_change_products(monkeypatch, dense):
    monkeypatch.setattr(kernel, "DENSE", dense)
    monkeypatch.setattr(kernel, "HELD", 100)
    rng = random.Random(4)

    def table(n):
        terms = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(n)]
        return pa.table({"terms": pa.array(terms, pa.list_(pa.int64())), "weights": pa.array([[rng.random() for _ in t] for t in terms], pa.list_(pa.float64()))})

    q, t = table(25), table(40)
    wide = lambda x: np.array([[dict(zip(a, b, strict=True)).get(i, 0.0) for i in range(30)] for a, b in zip(x["terms"].to_pylist(), x["weights"].to_pylist(), strict=True)])
    score = kernel.sparse(q, t)
    assert np.allclose([score(i) for i in range(25)], wide(q) @ wide(t).T, atol=1e-12)
