import pytest
from pyspark.sql import functions as F

from shelfwise.functions import barcodes, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f, value, wanted",
    [
        (text.number_or_null, "1e3", 1000.0), (text.number_or_null, " ", None), (text.number_or_null, "NaN", None), (text.number_or_null, "85g", None),
        (text.leading_number, "85г", 85.0), (text.leading_number, "9,1", 9.0), (text.decimal_number, "9,1", 9.1), (text.leading_number, "1e3", 1000.0), (text.leading_number, ".5", 0.5), (text.leading_number, "x", None),
        (text.scraped_number, "1 200.5 kg", 1200.5), (text.scraped_number, "0", None),
        (text.string_array, '["a"," b ","a",""]', ["a", "b"]), (text.string_array, "a, b,,a", ["a", "b"]), (text.string_array, None, []),
        (text.strip_html, "<p>a</p><p>b<br/>c</p>&amp;&nbsp;d", "a, b, c, & d"), (text.strip_html, None, None),
        (text.strip_html, "<p> </p>", None), (text.strip_html, "a<>&amp;lt;b&nbsp;", "a<><b"), (text.fold_accents, "Ã`ç ñ é", "ã'ç ñ e"), (text.normalise_text, "a`b´c’d", "abc d"),
        (text.fold_accents, "Crème Brûlée", "creme brulee"),
        (text.normalise_text, "Qazaq's  Сүт—5%", "qazaqs с т 5"),
        (text.slug_title, "al-baraka", "Al Baraka"),
        (text.language, "Сүт ҚАЙМАҒЫ", "kz"), (text.language, "МОЛОКО", "ru"), (text.language, "milk", "en"),
        (text.token_estimate, "abcde", 2),
        (barcodes.is_valid_ean, "4006381333931", True), (barcodes.is_valid_ean, "4006381333932", False), (barcodes.is_valid_ean, "96385074", True),
        (barcodes.is_valid_ean, "123456789012", True), (barcodes.is_valid_ean, "12345a", False), (barcodes.is_valid_ean, None, False),
        (barcodes.padded_ean13, "400638133393", "4006381333931"),
        (barcodes.country, "4870000000000", "KZ"), (barcodes.country, "12345", "internal"), (barcodes.country, "96385074", "unknown"),
        (barcodes.image_source, "https://cdn.x/products/1.png", "local"), (barcodes.image_source, None, None),
    ],
)
def test_text(spark, f, value, wanted):
    assert one(spark, f, value) == wanted


def test_truthy_or(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), (" ", "b")], "x string, y string")
    assert [r[0] for r in df.select(text.truthy_or(F.col("x"), F.col("y"))).collect()] == ["b", "b", "a", " "]


def test_overlap_counts_repeats(spark):
    df = spark.createDataFrame([("milk milk bar", "milk bar"), ("", "milk")], "a string, b string")
    rows = df.select(text.token_overlap(text.tokens(F.col("a"), ["the"]), text.tokens(F.col("b"), ["the"]))).collect()
    assert [r[0] for r in rows] == [1.0, 0.0]


def test_rating_edges(spark):
    assert [one(spark, text.half_star, q, "int") for q in (0, 5, 50, 97, 130)] == [0.0, 0.5, 2.5, 5.0, 5.0]
    light = lambda c: text.traffic_light(c, 5, 22.5)
    assert [one(spark, light, x, "double") for x in (5.0, 5.01, 22.5, 22.51, None)] == ["low", "medium", "medium", "high", None]


def test_object_key(spark):
    df = spark.createDataFrame([("1", "http://x/a.JPEG?v=1"), ("2", "http://x/a.webp"), ("3", None)], "e string, u string")
    keys = [r[0] for r in df.select(barcodes.object_key(F.col("e"), "main", F.col("u"))).collect()]
    assert keys == ["products/1/main.jpg", "products/2/main.webp", "products/3/main.jpg"]
