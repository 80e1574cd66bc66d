"""Queries over whole tables, where older ones keep to the subsets of their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise import catalog_queries
from shelfwise.functions.text import token_overlap, tokens
from shelfwise.operators import matching

FOLDER = "/root/testdata/sf0.001"


def brute_force(left, right, threshold=0.4, bonus=0.15):
    """All pairs of a block, as they were formed before."""
    side = lambda d, s: d.select(F.col("id").alias(f"id_{s}"), "block", tokens(F.col("name"), matching.STOP_WORDS).alias(f"t_{s}"), F.col("weight").alias(f"w_{s}"))
    raw = token_overlap(F.col("t_l"), F.col("t_r"))
    score = F.when(F.abs(F.col("w_l") - F.col("w_r")) < 5, F.least(F.lit(1.0), raw + bonus)).otherwise(raw)
    best = {}
    for r in side(left, "l").join(side(right, "r"), "block").select("id_l", "id_r", score.alias("s")).filter(F.col("s") >= threshold).collect():
        best[r["id_l"]] = min(best.get(r["id_l"], (0.0, None)), (-r["s"], r["id_r"]), key=lambda x: (x[0], x[1] if x[1] is not None else 1e9))
    return {k: (v[1], round(-v[0], 9)) for k, v in best.items()}


@pytest.mark.parametrize("threshold", [0.4, 0.1])
@pytest.mark.parametrize("hot", [2, 10_000])
def test_best_match_against_all_pairs(spark, monkeypatch, hot, threshold):
    monkeypatch.setattr(matching, "HOT_ROWS", hot)
    words = ["red", "red", "big", "oak", "bar", "milk", "of", "tea"]
    rows = [(i, " ".join(words[(i * k + i // 3) % 8] for k in range(1, 2 + i % 5)), float(i * 7 % 23) if i % 11 else None, ["a", "b", None][i % 7 % 3]) for i in range(160)]
    rows += [(200, "", 1.0, "a"), (201, None, 1.0, "a")]
    df = spark.createDataFrame(rows, "id int, name string, weight double, block string")
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    got = {r["id_l"]: (r["id_r"], round(r["score"], 9)) for r in matching.best_match(left, right, "block", threshold).collect()}
    assert got == brute_force(left, right, threshold) and len(got) > 40


def test_best_match_meets_on_tokens(spark):
    df = spark.createDataFrame([(i, f"only{i}", 1.0, "a") for i in range(40)], "id int, name string, weight double, block string")
    plan = matching.best_match(df, df, "block")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join Inner", x)]
    assert joins and all("_t" in x or "t_l" in x for x in joins)


def test_products_beyond_the_subsets(spark, tmp_path):
    rows = [(i, ["red oak bar", "red oak tea", "milk"][i % 3], "Brand#1", "BAR", i % 40, 1.0 + i) for i in range(1000, 1040)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    found = {n: catalog_queries.QUERIES[n](spark, str(tmp_path)).collect() for n in ("fuzzy_best_match_all", "alternatives_top3_all")}
    assert {r["id_l"] for r in found["fuzzy_best_match_all"]} == set(range(1000, 1040, 2))
    assert {r["id"] for r in found["alternatives_top3_all"]} == set(range(1000, 1040)) and len(found["alternatives_top3_all"]) == 120


def test_alternatives_equal_the_sql_of_the_subset(spark):
    # all ids of this folder are below 300
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{FOLDER}/part.parquet'")
    want = con.execute(catalog_queries.ORACLES["alternatives_top3"]).fetchall()
    got = catalog_queries.QUERIES["alternatives_top3_all"](spark, FOLDER).select("id", "place", "other", "tier").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["fuzzy_best_match_all", "sync_by_key_all", "profile_merge_all"])
def test_sql_has_no_subset(name):
    assert name in catalog_queries.ORACLES and not re.search("ean < |store_id < |value > ", catalog_queries.ORACLES[name])
