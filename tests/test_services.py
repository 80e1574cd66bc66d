"""Resumed runs, batched calls and the vector index."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from shelfwise.operators import calls, retrieval, vector_index
from shelfwise.operators.runs import ResumableRun
from shelfwise.sources.work import exists, work_folder


def test_broken_run_goes_on(spark, tmp_path):
    items = spark.createDataFrame([(i, f"n{i}") for i in range(200)], "id long, name string")
    enrich = lambda b: b.select("id", F.upper("name").alias("label"), F.when(F.col("id") % 10 == 0, "no_data").alias("error"))
    whole = ResumableRun(spark, str(tmp_path / "whole"), 6)
    assert whole.start(items, "id", enrich) == 6
    broken = ResumableRun(spark, str(tmp_path / "broken"), 6)
    n = []

    def dies(batch):
        n.append(1)
        # the third batch dies in its tasks, with its folder begun
        return enrich(batch).withColumn("label", F.when(F.lit(len(n)) == 3, F.raise_error(F.lit("service down"))).otherwise(F.col("label")))

    with pytest.raises(Exception, match="service down"):
        broken.start(items, "id", dies)
    assert len(broken.committed()) == 2 and broken.rows().count() < 200
    # the source has changed meanwhile: the run keeps to the items it began with
    again = ResumableRun(spark, str(tmp_path / "broken"), 6)
    assert again.start(items.filter("id < 5"), "id", enrich) == 4 and again.start(items, "id", enrich) == 0
    assert sorted(map(tuple, again.rows().collect())) == sorted(map(tuple, whole.rows().collect()))
    assert tuple(again.report().first()) == (6, 6, 200, 200, 20)
    # rows that are written but not committed are not the run's
    spark.range(3).selectExpr("id", "'x' AS label", "'x' AS error").write.parquet(str(tmp_path / "broken" / "rows" / "00099"))
    assert again.rows().count() == 200
    none = ResumableRun(spark, str(tmp_path / "none"), 2)
    assert none.start(items.filter("false"), "id", enrich) == 2 and none.rows().count() == 0
    assert exists(spark, str(tmp_path)) and work_folder(spark, "x") != work_folder(spark, "x")


class Flaky:
    """Fails on a batch's first tries where its first text says so; answers in another order, as two numbers."""

    def __init__(self):
        self.seen = {}

    def __call__(self, texts):
        assert 0 < len(texts) <= 7
        n = self.seen[texts[0]] = self.seen.get(texts[0], 0) + 1
        if n <= int(texts[0].split("-")[1]):
            raise ConnectionError("busy")
        if texts[0].startswith("short"):
            return [(0, [1.0, 2.0])] if len(texts) > 1 else []
        return [(i, [float(len(t)), float(i)]) for i, t in enumerate(texts)][::-1]


def test_calls(spark):
    waits = spark.sparkContext.accumulator(0)
    rows = [(i, None if i % 11 == 5 else f"t{i}-{i % 4}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = calls.call_in_batches(df, "text", Flaky(), ArrayType(DoubleType()), size=7, tries=3, first_wait=1.0, wait=lambda s: waits.add(int(s))).cache().collect()
    assert sorted((r["id"], r["text"]) for r in got) == rows
    for r in got:
        if r["text"] is None:
            assert (r["result"], r["error"], r["tries"]) == (None, None, 0)
        elif r["result"] is None:
            assert r["error"] == "ConnectionError: busy" and r["tries"] == 3
        else:
            assert r["error"] is None and r["result"][0] == len(r["text"])
    assert {r["tries"] for r in got} >= {1, 3} and any(r["error"] for r in got)
    assert waits.value >= 3  # one second, then two


def test_calls_with_missing_answers_and_bad_names(spark):
    df = spark.createDataFrame([(1, "short-0"), (2, "x-0")], "id long, text string").coalesce(1)
    got = calls.call_in_batches(df, "text", Flaky(), ArrayType(DoubleType()), size=7, first_wait=0.0).collect()
    assert [r["error"] for r in got] == ["ValueError: 1 of 2 answers"] * 2
    with pytest.raises(ValueError, match="error"):
        calls.call_in_batches(df.withColumn("Error", F.lit(1)), "text", Flaky(), StringType())
    assert calls.call_in_batches(df.filter("false"), "text", Flaky(), StringType()).collect() == []


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_index_recall_on_the_given_vectors(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 50 = 0")
    vector_index.VectorIndex.build(vectors).write(str(tmp_path))
    index = vector_index.VectorIndex.read(spark, str(tmp_path))
    assert index.entries.count() == vectors.count()
    probes = index.probes_for(asked, 10)
    assert 1 <= probes < len(index.centroids)
    found, exact = index.search(asked, 10, probes).cache(), retrieval.nearest_to_each(vectors, asked, 10)
    assert vector_index.recall(found, exact) >= 0.9
    assert found.count() == exact.count()


def test_index_of_clusters_copies_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 3)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 8))
    # a third of the rows in one cluster, a fifth of them equal
    of = np.where(rng.random(600) < 0.3, 0, rng.integers(0, 6, 600))
    m = centre[of] + 0.05 * rng.normal(size=(600, 8))
    m[:120] = m[0]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0]), (1003, []), (1004, [None] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = vector_index.VectorIndex.build(vectors, lists=6)
    assert index.entries.count() == len(rows) and index.entries.filter(f"list = {vector_index.NOWHERE}").count() == 5
    asked = vectors.filter("vec_id % 50 = 0")
    found = index.search(asked, 10, 2)
    assert vector_index.recall(found.filter("query_id >= 120"), retrieval.nearest_to_each(vectors, asked.filter("vec_id >= 120"), 10)) == 1.0
    best = found.filter("query_id = 100").orderBy("place").collect()
    assert [r["vec_id"] for r in best] == list(range(10)) and best[0]["similarity"] == pytest.approx(1.0)
    # what is added later is found
    index.write(str(tmp_path))
    index.add(str(tmp_path), spark.createDataFrame([(2000, m[300].tolist())], "vec_id long, embedding array<double>"))
    again = vector_index.VectorIndex.read(spark, str(tmp_path))
    assert again.search(vectors.filter("vec_id = 300"), 1, 1).first()["vec_id"] == 2000
    empty = vector_index.VectorIndex.build(vectors.filter("false"))
    assert empty.search(asked, 3, 1).collect() == []
