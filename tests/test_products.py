import pytest
from pyspark.sql import functions as F

from shelfwise.functions import products as P


def value(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "f, x, wanted",
    [
        (P.nutriscore, " b ", "B"), (P.nutriscore, "Bad", None), (P.nutriscore_prefix, "Bad", "B"), (P.nutriscore_prefix, "x", None),
        (P.halal_status, "Halal", "yes"), (P.halal_status, "false", "no"), (P.halal_status, None, "unknown"),
        (P.clean_url, " https://x ", "https://x"), (P.clean_url, "ftp://x", None), (P.clean_code, " 12345678 ", "12345678"), (P.clean_code, "1234567", None),
        (P.codes_in, "4870000000001, x4870000000002 4870000000001", ["4870000000001"]), (P.shelf, "Батончик", "chocolate_bars"), (P.shelf, "x", "chocolate"),
        (P.is_uuid, "123E4567-e89b-12d3-a456-426614174000", True), (P.is_uuid, None, False),
        (P.reference_kind, "gp:1", "id"), (P.reference_kind, "12345678", "ean"), (P.reference_kind, "demo:p1", "demo"), (P.reference_kind, "1", "other"),
        (P.first_brand, " A , B", "A"), (lambda c: P.clean_text(c, 5), "<b>a</b>  bcdefg", "a bcd"), (lambda c: P.clean_text(c, 5), " <i> </i>", None),
        (P.front_matter, "---\ndomain: 'x'\nlang: \"ru\"\nempty:\n---\nbody", {"domain": "x", "lang": "ru"}), (P.front_matter, "none", {}),
        (lambda c: P.path_domain(c)["subdomain"], "a/b/c.md", "b"),
    ],
)
def test_single(spark, f, x, wanted):
    assert value(spark, (x,), "x string", f(F.col("x"))) == wanted


def test_lists(spark):
    row, schema = (["en:Milk", "en:nuts", "en:milk", "en:dust"], ["Vegan", "en:gluten-free", "HALAL"]), "tags array<string>, labels array<string>"
    assert value(spark, row, schema, P.allergens(F.col("tags"))) == ["milk", "tree_nuts"]
    assert value(spark, row, schema, P.diet_tags(F.col("labels"))) == ["vegan", "halal", "gluten_free"]
    assert value(spark, row, schema, P.additives(F.array(F.lit("en:e330")))) == ["E330"]


def test_halal_order(spark):
    rows = [(["halal"], "pork", 5.0), (None, "Pork", 0.0), (None, "x", 0.6), (None, "x", 0.5), (None, None, None)]
    df = spark.createDataFrame(rows, "l array<string>, i string, a double")
    assert [r[0] for r in df.select(P.halal_inferred(F.col("l"), F.col("i"), F.col("a"))).collect()] == ["yes", "no", "no", "unknown", "unknown"]


def test_nutrition_takes_the_first_key(spark):
    got = value(spark, ({"calories": "90", "energy-kcal_100g": "80", "sugars_100g": "x", "salt": "0.1"},), "n map<string,string>", P.nutrition(F.col("n")))
    assert (got["kcal"], got["sugar"], got["salt"], got["fat"]) == (90.0, None, 0.1, None)


def test_traces_within_the_window(spark):
    syn = {"milk": ["milk"], "soy": ["soy"]}
    text = "Sugar, soy. May contain " + "x" * 90 + " milk"
    for pad, wanted in ((text, ["milk"]), (text.replace("x" * 90, "x" * 99), [])):
        assert value(spark, (pad, ["milk", "soy"]), "i string, w array<string>", P.trace_warnings(F.col("i"), syn, F.col("w"))) == wanted


def test_admission_and_antifilter(spark):
    rows = [("12345678", "ab", ["en:kazakhstan"], None, None, "x", False), ("12345678", "ab", [], None, None, "best brand", True), ("1234567", "ab", ["en:kazakhstan"], None, None, "x", False), ("12345678", "ab", None, None, None, "x", True)]
    df = spark.createDataFrame(rows, "c string, n string, k array<string>, r string, i string, b string, d boolean")
    ok = P.admitted(*[F.col(x) for x in "cnkrib"], ["best"], F.col("d"))
    assert [r[0] for r in df.select(ok).collect()] == [True, True, False, False]
    df = spark.createDataFrame([("Acme", "milk"), ("x", "смесь"), ("x", "box 10x20"), (None, "milk")], "b string, t string")
    assert [r[0] for r in df.select(P.is_grocery(F.col("b"), F.col("t"), ["acme"], ["см"])).collect()] == [False, False, False, True]


def test_ids_images_sides(spark):
    row, schema = ("123e4567-e89b-12d3-a456-426614174000", "", "", "12 kcal", "9"), "u string, e string, i string, a string, b string"
    assert value(spark, row, schema, P.canonical_id(F.col("u"), F.col("e"), F.lit(None).cast("string"))).startswith("gp:")
    assert value(spark, row, schema, P.canonical_id(F.col("e"), F.lit("1"), F.lit("d"))) == "ean:1"
    assert value(spark, row, schema, P.image(F.col("i"), F.array().cast("array<string>"), F.lit("7"))) == "/products/7.png"
    assert value(spark, row, schema, P.shelf_text(F.lit("A"), F.col("e"))) == "A"
    assert value(spark, row, schema, P.better_side(F.col("a"), F.col("b"), True)) == "b"
    assert value(spark, row, schema, P.query_text(F.lit("x" * 300), F.array(F.lit("milk")), F.array(F.lit("soy")))) == "x" * 200 + " milk soy"
    assert value(spark, row, schema, P.localised(F.col("e"), F.col("i"), F.lit("z"))) == "z"
