"""The pipeline on planted rows, nulls and empty tables, and the import guard of the entry module."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

ROOT = Path(P.__file__).parent
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled prose, junk and insults; an exact copy, a near copy and a passage that repeats."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        text, quality, toxic = prose(120), 1, 0
        if i % 5 == 1:
            text, quality = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in text.split()), 0
        elif i % 5 == 2:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "moron", "pathetic", "idi0t"]))
            text, toxic = " ".join(parts), 1
        docs.append((i, text))
        labels.append((i, quality, toxic))
    passage = prose(90)
    docs += [(1000, docs[0][1]), (1001, docs[0][1].replace(docs[0][1].split()[60], "another", 1)), (1002, docs[0][1])]
    docs += [(2000 + k, f"{prose(80)} {passage} {prose(80)}") for k in range(3)]
    docs += [(3000, None), (3001, ""), (None, prose(100)), (3002, docs[3][1]), (3002, docs[3][1])]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), passage


def test_stages(spark, folder):
    at, passage = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    before = docs.count()
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "quality_classifier", "simhash", "suffix_dedup", "packing"]

    docs = stages["toxicity"](spark, docs, at)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.schema.simpleString() == spark.read.parquet(f"{at}/documents.parquet").schema.simpleString()
    assert sum(i % 5 == 2 for i in ids if i is not None and i < 300) <= 3 and sum(i % 5 in (0, 3, 4) for i in ids if i is not None and i < 300) >= 175
    docs = stages["quality_classifier"](spark, docs, at)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(i % 5 == 1 for i in ids if i is not None and i < 300) <= 3 and sum(i % 5 in (0, 3, 4) for i in ids if i is not None and i < 300) >= 170
    docs = stages["simhash"](spark, docs, at).cache()
    rows = docs.collect()
    ids = [r.doc_id for r in rows]
    assert 0 in ids and not {1000, 1002} & set(ids) and ids.count(3002) == 0 and ids.count(3) == 1
    assert {2000, 2001, 2002} <= set(ids)
    rest = stages["suffix_dedup"](spark, docs, at)
    after = {r.doc_id: r for r in rest.collect()}
    assert len(after) == len(rows)
    for r in rows:
        if r.doc_id in (2000, 2001, 2002):
            assert passage not in after[r.doc_id].text and after[r.doc_id].n_chars == len(after[r.doc_id].text) < r.n_chars
        elif r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id not in (0, 1001):
            assert after[r.doc_id].text == r.text
    packed = stages["packing"](spark, rest, at)
    assert packed.count() == len(rows) < before


def test_run_and_empty_documents(spark, folder, tmp_path):
    assert P.run(spark, folder[0]).count() > 100
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names_stay(spark, folder):
    names = ["score", "k1", "k2", "head", "copy_number", "kept", "n_bytes", "n_removed", "removed_spans", "spans_s", "s", "e", "found", "row", "body", "held_row", "key_a", "fp", "c0", "key"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema).withColumns({c: F.lit(f"mine {c}") for c in names})
    docs = docs.withColumn("of.id", F.col("doc_id"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in names) and all(r["of.id"] == r.doc_id for r in rows), name
    assert P.STAGES[-1][1](spark, docs, folder[0]).count() == 60


def test_ids_of_several_texts_and_null_ids_are_separate_documents(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(rng.choice("abcdefghijkl") * rng.randint(1, 9) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, None), (8, ""), (9, d), (9, d)]
    found = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(1, a), (5, b), (None, c), (7, None), (9, d)]))


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from kindred.llm import common

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})()

    with pytest.raises(RuntimeError):
        common.checkpoint_folder(Session())


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    for name in ("kindred", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "kindred" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
