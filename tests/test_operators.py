import pytest
from pyspark.sql import functions as F

from shelfwise.operators import analytics, catalog, fitcheck, matching, merging, profiles, retrieval


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_cascade_takes_the_first_tier(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "ean string")
    one = spark.createDataFrame([("a", "x1"), ("a", "x0")], "ean string, payload string")
    two = spark.createDataFrame([("a", "y"), ("b", "y")], "ean string, payload string")
    got = catalog.cascade(keys, [("first", one), ("second", two)], ["ean"], ["payload"])
    assert rows(got, "ean", "found_status", "payload") == [("a", "first", "x0"), ("b", "second", "y"), ("c", "not_found", None)]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("A%b", None), ("ab", "x")], "name string, brand string")
    assert rows(catalog.search(df, ["name", "brand"], "a%"), "name") == [("A%b",)]
    assert catalog.search(df, ["name"], "  ").count() == 2


def test_upsert_null_overwrites_and_subset_stays(spark):
    t = spark.createDataFrame([(1, "a", "b", 1), (2, "c", "d", 2)], "k int, x string, y string, z int")
    s = spark.createDataFrame([(1, None, "n"), (3, "e", "f")], "k int, x string, y string")
    assert rows(merging.upsert(t, s, ["k"], ["x"], insert_only=["y"]).fillna("-")) == [(1, "-", "b", 1), (2, "c", "d", 2), (3, "e", "f", None)]


def test_upsert_last_of_repeated_keys(spark):
    t = spark.createDataFrame([(1, "a")], "k int, x string")
    s = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, x string, v int")
    assert rows(merging.upsert(t, s, ["k"], ["x"], order=["v"])) == [(1, "new")]


def test_sync_plan(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "h string")
    assert rows(merging.sync_plan(df("a", "b", "b"), df("b", "c"), ["h"])) == [("a", "delete"), ("b", "keep"), ("c", "insert")]


def test_snapshot(spark):
    held = spark.createDataFrame([(1, 1, "old"), (1, 2, "old"), (2, 9, "old")], "s int, k int, v string")
    fresh = spark.createDataFrame([(1, 2, "new")], "s int, k int, v string")
    assert rows(merging.replace_snapshot(held, fresh, "s", "k")) == [(1, 1, "old"), (1, 2, "new")]


def test_checks(spark):
    good, bad = catalog.split_checked(spark.createDataFrame([(1,), (-1,), (None,)], "p int"), {"price": F.col("p") >= 0})
    assert good.count() == 2 and rows(bad, "failed") == [(["price"],)]


def test_budget_keeps_the_first(spark):
    df = spark.createDataFrame([("q", 1, 900), ("q", 2, 10), ("r", 1, 5), ("r", 2, 6)], "k string, n int, c int")
    assert rows(analytics.within_budget(df, ["k"], "n", "c", 10), "k", "n") == [("q", 1), ("r", 1)]


def test_alternatives(spark):
    df = spark.createDataFrame([(1, "g", "c", 3.0), (2, "g", "c", 1.0), (3, "h", "c", 2.0), (4, "h", "d", None)], "id int, near string, wide string, price double")
    got = rows(matching.alternatives(df, "near", "wide", 2), "id", "place", "other", "tier")
    assert got[:4] == [(1, 1, 2, 0), (1, 2, 3, 1), (2, 1, 1, 0), (2, 2, 3, 1)]


PROFILE = {"user_allergens": [], "custom_allergens": [], "conditions": [], "diets": [], "halal_only": False, "halal_strict": False}
PRODUCT = {"name": "bar", "ingredients": "", "allergens": [], "traces": [], "diet_tags": [], "sugar": None, "protein": None, "alcohol": 0.0, "halal_status": "unknown"}
SCHEMA = (
    "name string, ingredients string, allergens array<string>, traces array<string>, diet_tags array<string>, sugar double, protein double, alcohol double,"
    " halal_status string, user_allergens array<string>, custom_allergens array<string>, conditions array<string>, diets array<string>, halal_only boolean, halal_strict boolean"
)


@pytest.mark.parametrize(
    "change, verdict, subjects",
    [
        ({}, "safe", []),
        ({"allergens": ["en:milk"], "user_allergens": ["milk"]}, "danger", ["milk"]),
        ({"ingredients": "Whey powder", "user_allergens": ["milk"], "allergens": ["milk"]}, "danger", ["milk"]),
        ({"traces": ["en:soy"], "user_allergens": ["soy"]}, "warning", ["soy"]),
        ({"ingredients": "with MANGO", "custom_allergens": ["Mango"]}, "danger", ["Mango"]),
        ({"sugar": 22.51, "conditions": ["diabetes"]}, "danger", ["22.51"]),
        ({"sugar": 22.5, "conditions": ["diabetes"]}, "warning", ["22.5"]),
        ({"sugar": 5.0, "conditions": ["diabetes"]}, "safe", ["5.0"]),
        ({"ingredients": "сироп", "conditions": ["diabetes"]}, "warning", ["sugar"]),
        ({"ingredients": "rye", "conditions": ["celiac"]}, "danger", ["gluten"]),
        ({"protein": 20.01, "conditions": ["pku"]}, "warning", ["protein"]),
        ({"halal_status": "no", "halal_only": True, "halal_strict": True}, "warning", ["no"]),
        ({"halal_status": "no", "halal_only": True}, "caution", ["no"]),
        ({"alcohol": 0.5, "halal_only": True}, "danger", ["alcohol"]),
        ({"ingredients": "ароматизатор", "halal_only": True}, "danger", ["ingredient"]),
        ({"diet_tags": ["contains_sugar"], "diets": ["sugar_free"]}, "caution", ["sugar_free"]),
        ({"allergens": None, "user_allergens": None, "ingredients": None, "name": None}, "safe", []),
    ],
)
def test_fit_check(spark, change, verdict, subjects):
    row = PRODUCT | PROFILE | change
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    got = fitcheck.check_fit(spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)).first()
    assert (got["verdict"], [r["subject"] for r in got["reasons"]], got["fits"]) == (verdict, subjects, verdict == "safe")


def test_profiles(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "a"], True, True), (2, ["a"], ["b"], True, False), (3, [], ["b"], False, False), (4, ["a"], [], True, False)], "id int, local_t array<string>, cloud_t array<string>, local_halal boolean, cloud_halal boolean")
    assert rows(profiles.merge_profiles(df, ["t"]), "id", "t", "halal", "action") == [(1, ["a", "b"], True, "keep_cloud"), (2, ["a", "b"], True, "ask"), (3, ["b"], False, "apply_cloud"), (4, ["a"], True, "upload")]


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0])], "vec_id int, embedding array<float>")
    assert [(r[0], r[1]) for r in retrieval.nearest(df, [2.0, 0.0], 5).select("vec_id", "similarity").collect()] == [(1, 1.0), (2, -1.0), (3, None)]


def test_chunks(spark):
    text = "intro\n# One\na\n#### deep\nb\n## Two\n" + "\n\n".join("p%d " % i + "x" * 400 for i in range(12))
    parts = retrieval.heading_chunks(spark.createDataFrame([(1, text), (2, "")], "id int, t string"), "id", "t")
    assert [r["heading"] for r in parts.orderBy("section").collect()] == ["", "One", "Two"]
    cut = [r["content"] for r in retrieval.paragraph_chunks(parts, ["id", "section"], "content").filter("section = 2").orderBy("chunk").collect()]
    assert len(cut) > 1 and all(len(c) <= 2000 for c in cut)
    assert cut[1].split("\n\n")[:2] == cut[0].split("\n\n")[-2:]
