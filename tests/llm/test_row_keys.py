"""The pipeline's stages on rows with null and reused ids, against brute force."""

import collections
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(n, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))


A, B, C, D, E = (prose(60, i) for i in range(5))
LEAK = prose(12, 9)
ROWS = [
    (1, A), (2, A + " more"), (1, B), (1, B), (None, A + " other"), (None, C), (None, D), (None, D + " more"), (None, C),
    (3, E), (3, LEAK + " " + prose(40, 20)), (None, LEAK + " " + prose(40, 21)), (4, LEAK + " " + prose(40, 22)), (4, prose(40, 23)), (None, "short text"), (5, "short text"),
]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each_group(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = collections.defaultdict(list)
    for r, row in zip(root, rows):
        groups[r].append(row)
    return {frozenset(g) for g in groups.values()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path


def test_near_duplicates_keep_one_row_of_each_group(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    groups = one_of_each_group(ROWS)
    assert len(got) == len(groups)
    for g in groups:
        mine = [r for r in got if r in g]
        assert len(mine) == 1 and mine[0][0] == min((i for i, _ in g if i is not None), default=None)


def test_decontamination_by_row(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    got = collections.Counter(tuple(r) for r in corpus_pipeline.decontamination(spark, docs, folder).collect())
    leak = re.findall("[a-z]+", LEAK)
    windows = [" ".join(leak[i : i + 10]) for i in range(len(leak) - 9)]
    assert got == collections.Counter(r for r in ROWS if not any(w in r[1] for w in windows))


def test_stages_on_no_rows_and_on_rows_without_texts(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").selectExpr("*", "'en' AS lang", "CAST(NULL AS STRING) AS source", "1L AS n_chars", "1 AS _row", "2 AS _found")
    empty = docs.filter("false")
    bare = docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", "_row", "_found")
    left = {"quality_rules": 0, "ngram_jaccard_join": 1, "decontaminate": 3, "mix_sources": 3, "token_records": 3}
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0
        got = step(spark, bare, folder)
        assert got.count() == left[name]
        assert name == "token_records" or set(got.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_repeated_ids_have_all_their_links(spark):
    from shelfwise.llm.jaccard_join import jaccard_components

    rows = [(1, A), (1, B), (2, A + " more"), (3, B + " more"), (9, C), (9, C), (8, D), (8, C + " other"), (7, None), (7, D + " x"), (5, ""), (None, B), (None, E)]
    want = {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 5: 5}
    for given in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = [tuple(r) for r in jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(3), k=5, num=8, den=10).collect()]
        assert len(got) == len(rows)
        assert all(want[i] == c for i, n, c in got if i in want)
        assert sorted((n, c) for i, n, c in got if i == 7) == [(0, 7), (57, 7)]
        assert sorted((c for i, n, c in got if i is None), key=str) == [1, None]


def test_pipeline_runs_apart(spark):
    first = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    second = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, second.collect()), key=str)
    assert want and sorted(map(tuple, first.collect()), key=str) == want


def test_schemas_that_repeat_and_keys_that_repeat(spark):
    from shelfwise.llm import chat

    schema = chat.schemas(spark)
    odd = spark.createDataFrame([("reply", None, "string", True), (None, "x", "string", True)], schema.schema)
    calls = spark.createDataFrame([("reply", '{"turn":1,"prompt":"a"}'), ("reply", '{"turn":1,"prompt":"a","prompt":"b"}'), ("reply", "[]"), ("other", "{}"), (None, None)], "name string, arguments string")
    got = chat.check_arguments(calls, schema.union(schema).union(odd)).collect()
    assert [r["valid"] for r in got] == [True, False, False, False, False]
