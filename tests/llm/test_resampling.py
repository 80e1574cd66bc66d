"""Importance resampling against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, buckets, percent, least):
    count = lambda texts: collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (r[:5] for r in rows)))


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "w" * 60, "😀x", "9", "İz", "a" * 39 + "é", "b" * 40]
    return [" ,\n"[rng.integers(3)].join(vocabulary[k] for k in rng.integers(0, 10, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("buckets", [7, 10000])
def test_against_brute_force(spark, buckets):
    rows = [*enumerate(texts(120, 1)), (200, None), (201, ""), (202, " .,"), (None, "beta gamma " * 15), (203, "beta " * 50_000)]
    target = [*texts(5, 2), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "n_words", "_at", "_range", "weight")}).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumns({"_none": F.lit(1), "doc_id": F.lit("a")})
    got = resampling.resample(docs, aim, buckets=buckets, percent=25, min_words=20)
    assert sorted(repr(list(r)) for r in got.collect()) == brute(rows, target, buckets, 25, 20)


def test_repeated_rows_count_each_and_empty_tables(spark):
    rows = [(1, "one two " * 12)] * 3 + [(2, "three four " * 12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = docs.filter("false")
    assert sorted(repr(list(r)) for r in resampling.resample(docs, docs.filter("doc_id = 2"), percent=60).collect()) == brute(rows, [x for i, x in rows if i == 2], 10000, 60, 20)
    assert resampling.resample(none, docs).collect() == []
    assert sorted(repr(list(r)) for r in resampling.resample(docs, none).collect()) == brute(rows, [], 10000, 25, 20)


def test_crc_of_words_and_pairs():
    words = [b"", b"a", b"ab" * 30, b"x" * 40, b"y" * 41, "é€😀".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    e = np.cumsum([len(w) for w in words])
    s = e - [len(w) for w in words]
    crc = resampling.crc_words(data, s, e)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert resampling.crc_pairs(data, s, e, crc).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_column_sums_are_the_matrix_counts(spark):
    docs = spark.createDataFrame([*enumerate(texts(30, 3))], "doc_id long, text string")
    matrix = resampling.count_matrix(docs, 50)
    want = collections.Counter(zlib.crc32(f.encode()) % 50 for r in docs.collect() for f in features(r["text"])[1])
    assert resampling.column_sums(matrix, 50) == [want[b] for b in range(50)]

