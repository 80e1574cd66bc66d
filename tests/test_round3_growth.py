"""Work of imports that grows with their rows only: each value is computed once, files don't grow with keys or pages."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise import catalog_queries, feed_queries
from shelfwise.functions import products as P
from shelfwise.operators import merging
from shelfwise.sources import listing, sheets

FOLDER = "/root/testdata/sf0.001"


def test_maps_of_nutrition_are_read_once(spark):
    df = spark.createDataFrame([('{"calories":"5","kcal":"x","fat":7,"salt":"NaN"}',), ("[",), (None,)], "t string")
    got = df.select(P.nutrition(F.from_json("t", "map<string,string>")).alias("n"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r["n"]["kcal"], r["n"]["fat"], r["n"]["salt"]) for r in got.collect()] == [(5.0, 7.0, None), (None, None, None), (None, None, None)]


def test_parts_of_a_feed_are_dealt_to_tasks(spark):
    plan = feed_queries._feed(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [p_partkey") == 6


def test_snapshots_of_many_stores_are_kept_in_few_folders(spark, tmp_path):
    at, schema = f"file://{tmp_path}/held", "ean long, store long, price double"
    put = lambda rows, n=4: merging.write_snapshot(at, spark.createDataFrame(rows, schema), "store", "ean", n)
    folders = lambda: {p.name: {(f.name, os.stat(f).st_mtime_ns) for f in p.glob("*.parquet")} for p in Path(f"{tmp_path}/held").glob("*=*")}
    first = [(e, s, float(e)) for s in range(200) for e in range(3)]
    put([*first, (None, 1, 9.0), (1, None, 9.0)])
    before = folders()
    assert len(before) == 4
    put([(1, 7, 50.0), (1, 7, 40.0), (9, 7, None)])
    after = folders()
    assert set(after) == set(before) and sum(after[f] != before[f] for f in before) == 1
    put([])
    want = {(s, e): p for e, s, p in first} | {(7, 1): 50.0, (7, 9): None}
    got = merging.read_snapshot(spark, at, spark.createDataFrame([], schema).schema)
    assert got.columns == ["ean", "store", "price"]
    rows = got.collect()
    assert len(rows) == len(want) and {(r["store"], r["ean"]): r["price"] for r in rows} == want
    for other in (None, 5):
        with pytest.raises(ValueError):
            put([(1, 1, 1.0)], other)


def test_names_of_a_price_list_are_looked_up_once_a_row(spark):
    rows = spark.createDataFrame([("p", bytearray(sheets.workbook([["EAN", "Price", "Shelf"], ["1", 2, "A"]])))], "path string, content binary")
    df = sheets.price_list(sheets.sheet_rows(rows))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("map_keys(") == 3
    assert [(r["row"], r["ean"], r["price"], r["shelf"], r["error"]) for r in df.collect()] == [(2, "1", 2.0, "A", None)]


def test_rows_before_a_fault_in_a_sheet_are_kept(spark, tmp_path):
    import zipfile

    ns = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<x:sst {ns}><x:si><x:r><x:t>E</x:t></x:r><x:rPh><x:t>no</x:t></x:rPh><x:r><x:t>AN</x:t></x:r></x:si></x:sst>")
        body = '<x:row><x:c t="s"><x:v>0</x:v></x:c><x:c><x:v>Price</x:v></x:c></x:row><x:row><x:c><x:f>9</x:f><x:v>1</x:v></x:c><x:c><x:v>2</x:v></x:c></x:row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<x:worksheet {ns}><x:sheetData>{body}<x:row><x:c t='s'><x:v>7</x:v></x:c></x:row></x:sheetData></x:worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<x:worksheet {ns}><x:sheetData>{body}</x:row>")
    for fault, drop in (("IndexError", None), ("ParseError", "sheet1")):
        with zipfile.ZipFile(tmp_path / "a.xlsx") as z, zipfile.ZipFile(tmp_path / f"{fault}.zip", "w") as out:
            for n in z.namelist():
                if drop is None or drop not in n:
                    out.writestr(n, z.read(n))
        df = spark.createDataFrame([("p", bytearray((tmp_path / f"{fault}.zip").read_bytes()))], "path string, content binary")
        got = [(r["row"], r["ean"], r["price"], r["error"]) for r in sheets.price_list(sheets.sheet_rows(df)).collect()]
        assert sorted(got, key=str) == sorted([(2, "1", 2.0, None), (None, None, None, f"damaged: {fault}")], key=str)


def test_pages_of_a_listing_are_kept_many_a_file(spark, tmp_path):
    at = f"file://{tmp_path}/pages"
    counts = {"a": 1, "b": 12, "c": 13, "d": 131}
    items = spark.createDataFrame([(c, i, i if i % 7 else None, f"{c}\n{i}") for c, n in counts.items() for i in range(n)], "category string, n int, ean long, title string")
    listing.save_pages(items, at, "category", "n", page_size=4, pages_per_file=5)
    files = [p for p in Path(f"{tmp_path}/pages").rglob("*.txt")]
    assert len(files) == 1 + 1 + 1 + 7
    df = listing.read_listing(spark, listing.saved_pages(at, 5), "ean long, title string", [*counts, "none"], page_size=4, pages_per_task=5)
    got = sorted((r["category"], r["number"], r["page"], r["ean"], r["title"]) for r in df.fillna(-1).collect())
    assert got == [(c, i, i // 4, i if i % 7 else -1, f"{c}\n{i}") for c, n in counts.items() for i in range(n)]
    fetch = listing.saved_pages(at, 5)
    assert [len(fetch("d", p)) for p in (0, 32, 33, 4)] == [4, 3, 0, 4] and not fetch("none", 0)
    # a page that fills up later is read as it is then
    file = next(Path(f"{tmp_path}/pages/category=d/pages=6").glob("*.txt"))
    lines = file.read_text().splitlines()
    file.write_text("".join(x + "\n" for x in [*lines[:-1], lines[-1][:-1] + ',{"ean":9}]']))
    assert len(fetch("d", 32)) == 4


def test_words_of_all_rules_are_looked_for_in_one_pass(spark):
    words = {"a": ["milk", "soy"], "b": ["молок", ""], "c": [], "d": ["k s"]}
    rows = spark.createDataFrame([(1, "milk soy"), (2, "МОЛОКО молоко"), (3, ""), (4, None)], "id int, t string")
    got = {r["id"]: r["n"] for r in rows.select("id", P.lists_named(F.col("t"), words).alias("n")).collect()}
    assert got == {1: ["a", "b", "d"], 2: ["b"], 3: ["b"], 4: []}
    plan = catalog_queries.QUERIES["fit_check_allergens"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(_ingr" not in plan
    # by hand: the phrase's allergen is looked for behind it, in a text that is lowered once
    texts = spark.createDataFrame([("Sugar. May contain MILK",)], "t string")
    warned = texts.select(P.trace_warnings(F.col("t"), {"milk": ["milk"], "soy": ["soy"]}, F.array(F.lit("milk"), F.lit("soy")), ["may contain", "traces of"]).alias("w"))
    assert warned.first()["w"] == ["milk"] and warned._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
