"""Mixed feeds by shape, and the additive knowledge base."""

import pytest
from pyspark.sql import functions as F

from shelfwise.entity_queries import CACHE, DEMO, GLOBAL, _rows
from shelfwise.operators import additives, entities, feeds

FOLDER = "/root/testdata/sf0.001"
SHAPED = [
    ('{"canonicalId":"x","sourceMeta":{"isVerified":1}}', "entity"), ('{"canonicalId":"x","sourceMeta":null,"id":"p1"}', "demo"), ('{"ean":"1","halalStatus":null,"product_name":"a"}', "entity"),
    ('{"ean":"","halalStatus":null,"product_name":"a"}', "payload"), ('{"id":"p7","normalized_name":"a"}', "demo"), ('{"id":7,"normalized_name":"","normalized_nutriments_json":"{}"}', "cache"),
    ('{"allergens_tags":[],"ingredients_raw":"a"}', "payload"), ('{"nutriments":{},"ean":"9"}', "payload"), ('{"halal_status":"Halal","nutriments":0}', "global"), ('{"a":1}', "other"), ("[1]", "other"),
    ("5", "other"), ("0", "empty"), ("false", "empty"), ('""', "empty"), ("null", "empty"), (None, "empty"), ("", "damaged"), ('{"ean":', "damaged"), ('{"normalized_name":false}', "other"),
]


def test_first_matching_shape_wins(spark):
    df = spark.createDataFrame([(i, r, "mine") for i, (r, _) in enumerate(SHAPED)], "i int, r string, shape string")
    got = {r["i"]: r["shape"] for r in feeds.with_shape(df, "r").collect()}
    assert [got[i] for i in range(len(SHAPED))] == [s for _, s in SHAPED]
    as_variant = df.filter("r is not null and r <> '' and i <> 18").select("i", F.parse_json("r").alias("r"))
    assert {r["i"]: r["shape"] for r in feeds.with_shape(as_variant, "r").collect()} == {i: s for i, s in got.items() if i not in (16, 17, 18)}


@pytest.mark.parametrize("columns, read, shape", [(GLOBAL, entities.from_global, "global"), (CACHE, entities.from_cache, "cache"), (DEMO, entities.from_demo, "demo")])
def test_feed_equals_typed_rows(spark, columns, read, shape):
    typed = _rows(spark, FOLDER, "part", columns)
    wanted = ["source", "id", "demo_id", "ean", "name", "brand", "category", "quantity", "image", "images", "allergens", "traces", "halal_status", "nutrition", "nova_group", "manufacturer", "specs", "nutriscore", "is_enriched"]
    got = feeds.entities_of(typed.select(F.to_json(F.struct("*")).alias("r")), "r", columns=wanted)
    text = lambda df: sorted(map(str, df.select(*wanted).collect()))
    assert text(got) == text(read(typed))
    assert {r["shape"] for r in got.select("shape").distinct().collect()} == {shape}


def test_fields_of_other_kinds_are_missing(spark):
    df = spark.createDataFrame([(1, '{"canonicalId":"c","sourceMeta":{"qualityScore":"7","needsReview":"no"},"images":"a.png","tags":["b",3],"priceKzt":{},"halalStatus":true,"name":null}'), (2, None)], "k int, r string")
    r = {x["k"]: x for x in feeds.entities_of(df, "r", ["k"]).collect()}
    assert (r[1]["quality"], r[1]["needs_review"], r[1]["images"], r[1]["tags"], r[1]["price"], r[1]["halal_status"], r[1]["name"]) == (7.0, True, [], ["b", "3"], None, "yes", "")
    assert r[2]["shape"] == "empty" and r[2]["name"] is None and r[2]["allergens"] is None
    assert feeds.entities_of(df.limit(0), "r", ["k"]).count() == 0
    with pytest.raises(ValueError):
        feeds.entities_of(df.withColumn("name", F.lit("x")), "r", ["name"])


KNOWLEDGE = """# Title

### E120 — Кармин (Кошениль)

- **Происхождение:** животное
- **Халал:** НЕТ
- **Аллерген:** да (может быть)
- **Веган:** НЕТ

## More

### Without a code

- **Халал:** да

### E471 — Моно

- **Халал:** СОМНИТЕЛЬНО (без указания)
### E472b — B
- **Халал:** как E471
### E503 — C
- **Халал:** как E999
### E300 — D
- **Халал:** да (синтетический), НЕТ (иной)
- **Халал:** да
### E120 — again
### E330 — F
- **Халал:** да
- **Веган:** да
"""


def test_sections(spark):
    pages = spark.createDataFrame([("b", "### E330 — later\n- **Халал:** НЕТ"), ("a", KNOWLEDGE), (None, None), ("c", "")], "source_file string, content string")
    got = {r["code"]: r for r in additives.sections(pages).collect()}
    assert {c: r["verdict"] for c, r in got.items()} == {"E120": "forbidden", "E471": "doubtful", "E472b": "doubtful", "E503": "doubtful", "E300": "doubtful", "E330": "allowed"}
    assert (got["E120"]["name"], got["E120"]["origin"], got["E120"]["note"], got["E330"]["name"]) == ("Кармин (Кошениль)", "животное", None, "F")


DECISIONS = [
    ("сахар, E120", "yes", "halal", "certificate"), ("сахар", "no", "not_halal", "status"), ("сахар, е-120", None, "not_halal", "E120"), ("E 471, lard", "unknown", "not_halal", "lard"),
    ("collard greens", None, "probable", "ingredients"), ("E471 (растительный)", None, "probable", "ingredients"), ("E471, растительный белок", None, "doubtful", "E471"), ("желатин халяль", None, "probable", "ingredients"),
    ("gelatin", None, "doubtful", "gelatin"), ("E631 синтетический; E330", None, "probable", "ingredients"), ("E631", None, "doubtful", "E631"), ("E482\nE904", "", "not_halal", "E904"),
    ("E300", None, "doubtful", "E300"), ("E777", None, "probable", "ingredients"), (None, None, "probable", "ingredients"), ("", None, "probable", "ingredients"), ("E1203 E12 ME120", None, "probable", "ingredients"),
]


def test_decisions(spark):
    dim = additives.sections(spark.createDataFrame([("a", KNOWLEDGE)], "source_file string, content string"))
    rows = spark.createDataFrame([(i or None, text, status, "x") for i, (text, status, _, _) in enumerate(DECISIONS)], "at int, t string, s string, found string")
    got = {r["at"] or 0: (r["decision"], r["basis"]) for r in additives.halal_decisions(rows, "at", "t", "s", dim).collect()}
    assert [got[i] for i in range(len(DECISIONS))] == [(decision, basis) for _, _, decision, basis in DECISIONS]


def test_rows_of_a_key_and_what_codes_tell(spark):
    dim = additives.sections(spark.createDataFrame([("a", KNOWLEDGE)], "source_file string, content string"))
    rows = spark.createDataFrame([(1, "E330, E120, E888, E888", None), (1, "E330", "no"), (2, "x " * 50000 + ", E330", None)], "id int, t string, s string")
    got = {r["id"]: r for r in additives.halal_decisions(rows, "id", "t", "s", dim).collect()}
    assert (got[1]["decision"], got[1]["basis"], got[1]["n_codes"], got[1]["unknown_codes"], got[1]["not_vegan"], got[1]["allergens"]) == ("not_halal", "status", 3, "E888", "E120", "E120")
    assert (got[2]["decision"], got[2]["n_codes"]) == ("probable", 1)
    assert additives.halal_decisions(rows.limit(0), "id", "t", "s", dim).count() == 0
