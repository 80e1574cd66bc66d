"""Counts kept by day, and dictionaries of many entries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import analytics, dailies, dictionary

SCAN = "event_id long, store_id long, ean long, scanned_at timestamp_ntz, status string"


def scans(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(4)), int(rng.integers(30)), f"2024-01-{rng.integers(1, 29):02d} {rng.integers(24):02d}:00:00", "error" if rng.random() < 0.2 else "view") for i in range(n)]
    return spark.createDataFrame(rows + [(n, 1, 1, None, "view")], "event_id long, store_id long, ean long, t string, status string").withColumn("scanned_at", F.col("t").cast("timestamp_ntz")).drop("t")


def metrics(df):
    return sorted((r["store_id"], r["scans"], r["products"], r["found"]) for r in df.collect())


def test_days_equal_all_scans(spark, tmp_path):
    s = scans(spark, 600, 1)
    kept = dailies.Dailies(spark, str(tmp_path))
    assert metrics(dailies.metrics(kept.days(), [("2024-01-28", 7)])) == []
    for batch in (0, 1, 1):  # a batch that comes again counts once
        kept.add(s.filter(F.col("event_id") % 3 == batch), batch)
    kept.compact(1)
    kept.compact(1)
    kept.add(s.filter("event_id % 3 = 2"), 2)  # late events of all days
    for as_of, n in (("2024-01-28", 7), ("2024-01-15", 10), ("2024-01-28", 30)):
        want = metrics(analytics.metrics(analytics.since(s, n, f"{as_of} 00:00:00")))
        assert metrics(dailies.metrics(kept.days(), [(as_of, n)])) == want
    kept.compact(2)
    assert metrics(dailies.metrics(kept.days(), [("2024-01-28", 30)])) == want
    # days before the cut are not read
    plan = kept.days("2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_days_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, (day, n) in enumerate([("2024-01-02", 3), ("2024-01-03", 2), ("2024-01-02", 4)]):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"event_id": 10 * i + k, "store_id": 1, "ean": k, "scanned_at": f"{day}T10:00:00", "status": "view"}) + "\n" for k in range(n)))
        kept = dailies.Dailies(spark, str(tmp_path / "out"))
        kept.feed(spark.readStream.schema(SCAN).json(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    got = dailies.metrics(kept.days(), [("2024-01-03", 0), ("2024-01-03", 7)]).collect()
    assert sorted((r["days"], r["scans"], r["products"]) for r in got) == [(0, 2, 2), (7, 9, 4)]


def brute(texts, terms):
    out = []
    for t in texts:
        low = (t or "").lower()
        out.append(sorted({(low.index(x.lower()), x.lower(), tag) for tag, x in terms if x and tag and x.lower() in low}))
    return out


@pytest.mark.parametrize("chars", [8_000_000, 30])
def test_terms(spark, monkeypatch, chars):
    monkeypatch.setattr(dictionary, "PASS_CHARS", chars)
    terms = [("milk", "Молок"), ("milk", "milk"), ("drink", "milk"), ("gluten", "oat"), ("x", "a"), ("x", ""), (None, "tea"), ("y", None), ("milk", "milk"), ("z", "😀 b"), ("long", "oat milk")]
    texts = ["Oat MILK and молоко", None, "", "goat 😀 B", "nothing", "milk" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"found": F.lit(1), "term": F.lit("t"), "tag": F.lit("t")}).repartition(2)
    got = {r["id"]: [(x["at"], x["term"], x["tag"]) for x in r["found"]] for r in dictionary.find_terms(df, "text", spark.createDataFrame(terms, "tag string, term string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, terms)
    assert dictionary.find_terms(df, "text", spark.createDataFrame([], "tag string, term string")).select("found").distinct().collect()[0][0] == []


def test_a_hundred_thousand_entries(spark):
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(100_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 100_000, 50)) for _ in range(20)]
    terms = [(str(i % 9), w) for i, w in enumerate(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [(x["at"], x["term"], x["tag"]) for x in r["found"]] for r in dictionary.find_terms(df, "text", spark.createDataFrame(terms, "tag string, term string")).collect()}
    assert [got[i] for i in range(20)] == brute(texts, terms)
