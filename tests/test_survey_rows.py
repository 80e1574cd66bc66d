"""Expected values written out by hand, row by row."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import barcodes, nested, products, text
from shelfwise.operators import analytics, catalog, entities, history, matching, merging, profiles, retrieval
from shelfwise.sources import found_items, read_catalog, spec_map


def values(spark, f, *inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in inputs], f"x {kind}").select(f(F.col("x"))).collect()]


def test_countries(spark):
    wanted = {
        "000": "US/CA", "139": "US/CA", "140": "unknown", "299": "unknown", "300": "FR", "440": "DE", "441": "unknown", "460": "RU", "470": "unknown", "487": "KZ", "509": "UK", "549": "BE/LU",
        "560": "PT", "579": "DK", "590": "PL", "600": "ZA", "640": "FI", "700": "NO", "730": "SE", "760": "CH", "839": "IT", "840": "ES", "859": "unknown", "860": "TR", "879": "NL", "919": "AT", "930": "AU", "999": "unknown",
    }
    assert values(spark, barcodes.country, *[p + "0" * 10 for p in wanted]) == list(wanted.values())


def test_image_sources_in_order(spark):
    urls = ["https://images.openfoodfacts.org/products/1.jpg", "https://x.cdn-kaspi.kz/products/1.png", "https://arbuz.kz/1", "https://ean-db.com/1", "https://cdn.own.shop/products/1", "https://cdn.own.shop/1", "https://x/1", "", None]
    assert values(spark, lambda u: barcodes.image_source(u, "cdn.own.shop"), *urls) == ["openfoodfacts", "kaspi", "arbuz", "ean-db", "local", "r2", "other", None, None]


def test_numbers_of_texts(spark):
    assert values(spark, text.leading_number, "85г", "9,1", "", " ", "NaN", "1e3", "-0.5", ".5", "7.") == [85.0, 9.0, None, None, None, 1000.0, -0.5, 0.5, 7.0]
    assert values(spark, text.decimal_number, "9,1 g") == [9.1]


def test_product_words(spark):
    assert values(spark, products.nutriscore_prefix, "b", "Bad", " a", None) == ["B", "B", None, None]
    halal = lambda x: products.halal_inferred(F.lit(None).cast("array<string>"), x, F.lit(0.0))
    assert values(spark, halal, "gelatin", "gelatine", "Желатин", "свинина", "milk") == ["unknown", "no", "no", "no", "unknown"]
    assert values(spark, products.shelf, "Батончик плитка", "Milk tablet", "Фигурка", "egg", "x", None) == ["chocolate_bars", "chocolate_tablets", "chocolate_figures", "chocolate_eggs", "chocolate", "chocolate"]
    assert values(spark, lambda x: text.tokens(x, matching.STOP_WORDS), "Шоколад Milka и 100 г, a Bar from the x") == [["milka", "100", "bar"]]


def test_compare_score(spark):
    score = lambda q, e, h: matching.compare_score(F.lit(True), F.lit(1), F.lit(2), F.lit(q), F.lit(e), F.lit(h))
    row = spark.range(1).select(score(0, 0, "yes"), score(80, 4, "unknown"), score(80, 5, "no"), score(100, 3, "yes")).first()
    assert list(row) == [35 - 6 + 6 + 12.5 + 20 + 10, 35 + 20 + 9 + 4, 35 + 20 + 4 + 0, 35 + 25 + 9 + 10]


def test_specification_lists(spark):
    page = '<dt><span class="term-text"> Состав </span></dt><dd class="d"> cocoa\n</dd><dt><span>Вес</span></dt><dd>1</dd><dt><span>Вес</span></dt><dd>2</dd><dt>x</dt><dd><b>y</b></dd>'
    assert values(spark, lambda _: spec_map("x"), page) == [{"Состав": "cocoa", "Вес": "2"}]


def chunked(body, limit):
    """Paragraph by paragraph, as plain text."""
    import re

    size = lambda t: -(-len(t) // 4)
    if size(body) <= limit:
        return [body]
    out, held = [], []
    tokens = 0
    for p in (x for x in re.split(r"\n\n+", body) if x):
        if held and tokens + size(p) > limit:
            out.append("\n\n".join(held))
            held = held[-2:]
            tokens = size("\n\n".join(held))
        held.append(p)
        tokens += size(p)
    return [x.strip() for x in [*out, "\n\n".join(held)]]


def test_paragraphs(spark):
    bodies = ["short\ntext", "\n\n".join(f"paragraph {i} " + "x" * (i * 7 % 60) for i in range(40)), "y" * 900, "a\nb\n\n\n" + "c" * 300 + "\n\n" + "d" * 300 + "\n\ne"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = retrieval.paragraph_chunks(df, ["id"], "body", 50).orderBy("id", "chunk").collect()
    assert [(r["id"], r["content"]) for r in got] == [(i, c) for i, b in enumerate(bodies) for c in chunked(b, 50)]


def test_cascade_needs_one_row(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "ean int")
    tier = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "ean int, payload string")
    other = spark.createDataFrame([(1, "d"), (3, "e"), (3, "f")], "ean int, payload string")
    got = catalog.cascade(keys, [("one", tier), ("two", other)], ["ean"], [], single=("one",)).orderBy("ean").collect()
    assert [tuple(r) for r in got] == [(1, "two", "d"), (2, "one", "c"), (3, "two", "e")]


def test_first_filled_and_filters(spark):
    some, none = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), spark.createDataFrame([], "a int, b string")
    assert catalog.first_filled(none, some).count() == 2 and catalog.first_filled(none, none).count() == 0
    assert catalog.one_of(some, {"b": "x", "a": None}).count() == 1 and catalog.one_of(some, {"b": "all"}).count() == 2
    assert some.filter(catalog.blank("b")).count() == 1


def test_updates_that_hit_nothing_raise(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "ean int, price double, updated_at timestamp")
    with pytest.raises(LookupError):
        merging.update_rows(df, F.col("ean") == 2, {"price": F.lit(3.0)})
    row = merging.update_rows(df, F.col("ean") == 1, {"price": F.lit(3.0)}, stamp="2024-01-01 00:00:00").first()
    assert row["price"] == 3.0 and row["updated_at"].year == 2024


def test_history(spark):
    rows = [("guest", 1, "a", "2024-01-02"), ("u", 1, "a", "2024-01-01"), ("u", 2, "b", "x"), (None, 1, "c", None)]
    h = spark.createDataFrame(rows, "owner string, store_id int, ean string, t string").withColumn("scanned_at", history.iso_time(F.col("t"), "2024-03-01"))
    assert [str(r["scanned_at"])[:10] for r in h.collect()] == ["2024-01-02", "2024-01-01", "2024-03-01", "2024-03-01"]
    assert sorted((r["owner"] or "", r["ean"], r["t"] or "") for r in history.claim_guest(h, "u").collect()) == [("", "c", ""), ("u", "a", "2024-01-02"), ("u", "b", "x")]
    new = h.filter("ean = 'c'")
    assert sorted((r["owner"] or "", r["ean"]) for r in history.replace_owner(h, "u", new).collect()) == [("", "c"), ("guest", "a"), ("u", "c")]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"ean": "1", "name": "a"}, {"name": "b"}, {"ean": "", "name": "c"}]')
    assert [r["name"] for r in read_catalog(spark, str(tmp_path / "c.json"), "ean string, name string").collect()] == ["a"]
    assert found_items(spark.createDataFrame([([{"barcode": "1", "title": "t"}],)], "items array<map<string,string>>"), "items").first() == ("1", "t", None)


def test_manufacturers_and_json(spark):
    got = values(spark, lambda x: entities.manufacturer(x, F.lit("KZ")), '{"name":"A","country":"DE"}', "B", "", None, "{bad")
    assert [tuple(r) for r in got] == [("A", "DE"), ("B", "KZ"), (None, "KZ"), (None, "KZ"), ("{bad", "KZ")]
    assert values(spark, entities.json_list, ["a"], None, kind="array<string>") == ['["a"]', "[]"]
    fallback = F.array(F.lit("z"))
    assert values(spark, lambda x: entities.json_or(x, "array<string>", fallback), '["a"]', "[", None) == [["a"], ["z"], ["z"]]


def test_counters_and_presets(spark):
    assert spark.range(1).select(profiles.merge_counter(F.lit(None).cast("int"), F.lit(3)), profiles.merge_counter(F.lit(5), F.lit(3))).first() == (3, 5)


def test_brands_meet_by_alias(spark):
    l = spark.createDataFrame([("KINDER",), ("ab",), (None,)], "brand string")
    r = spark.createDataFrame([("Kinder Inc Ltd",), ("xaby",), ("in",), ("other",)], "brand string")
    got = {tuple(x) for x in matching.brand_pairs(l, r).collect()}
    wanted = {("kinder", "kinder inc ltd"), ("kinder", "in"), ("ab", "xaby")} | {("", b) for b in ("kinder inc ltd", "xaby", "in", "other")}
    assert got == wanted


def test_missed_counts(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "store_id int")
    assert sorted(map(tuple, analytics.missed_counts(rows).collect())) == [(1, 2), (2, 1)]


def test_nested_nulls(spark):
    df = spark.createDataFrame([(None,)], "g array<struct<name:string,items:array<struct<id:string,names:map<string,string>,is_vegan:boolean,is_vegetarian:boolean,contains:array<string>,subs:array<struct<id:string,names:map<string,string>>>>>>>")
    row = df.select(nested.ingredient_text(F.col("g")), nested.record_additives(F.col("g")), nested.record_allergens(F.col("g"), F.lit("молоко")), nested.record_diets(F.col("g"), F.lit(None).cast("string"))).first()
    assert list(row) == [None, [], ["milk"], []]


def test_nearest_to_each_in_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 0.1]), (6, [1.0]), (7, None), (8, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieval.nearest_to_each(v, v.filter("vec_id in (1, 6, 3)"), 3).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(1, 2), (1, 5), (1, 8)]
