"""Paged listings as table and stream, workbooks, and snapshots kept by store."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import merging
from shelfwise.sources import listing, sheets


def lay(folder, category, items, size):
    for i in range(0, len(items), size):
        page = folder / f"category={category}" / f"page={i // size}"
        page.mkdir(parents=True, exist_ok=True)
        (page / "part-0.json").write_text("".join(json.dumps(x) + "\n" for x in items[i : i + size]))


def goods(n, mark):
    return [{"ean": i, "title": f"{mark}{i}"} if i % 7 else {"ean": i} for i in range(n)]


COUNTS = {"a": 0, "b": 1, "c": 4, "d": 12, "e": 13, "f": 131}


def test_length_of_a_listing_asks_for_few_pages():
    for n in [*range(0, 60), 1000, 1001, 4096]:
        for known in {0, n // 2, n}:
            asked = []
            fetch = lambda c, p: asked.append(p) or [{}] * max(0, min(4, n - 4 * p))
            assert listing.Listing(fetch, ["x"], [], 4, 1).length("x", known) == n
            assert len(asked) <= 24


def test_table_has_every_item_once(spark, tmp_path):
    for c, n in COUNTS.items():
        lay(tmp_path, c, goods(n, c), 4)
    df = listing.read_listing(spark, listing.saved_pages(f"file://{tmp_path}"), "ean long, title string", [*COUNTS, "a", "none"], page_size=4, pages_per_task=3)
    got = df.collect()
    assert sorted((r["category"], r["number"], r["page"], r["ean"], r["title"]) for r in got) == sorted(
        (c, i, i // 4, x["ean"], x.get("title")) for c, n in COUNTS.items() for i, x in enumerate(goods(n, c))
    )
    assert df.rdd.getNumPartitions() == 1 + 1 + 1 + 2 + 11
    empty = listing.read_listing(spark, listing.saved_pages(f"file://{tmp_path}"), "ean long", ["none"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        listing.listing_source("x", None, "Page int", [])


def test_page_that_became_shorter_is_an_error():
    pages = {0: [{"v": 1}, {"v": 2}], 1: [{"v": 3}]}
    one = listing.Listing(lambda c, p: pages.get(p), ["x"], ["v"], 2, 5)
    stretches = one.stretches({"x": 1}, {"x": 3})
    assert [t for s in stretches for t in one.items(s)] == [("x", 0, 1, 2), ("x", 1, 2, 3)]
    pages[1] = []
    with pytest.raises(OSError):
        [t for s in stretches for t in one.items(s)]


def test_stream_restarts_in_the_middle_and_reads_on_in_a_short_page(spark, tmp_path):
    pages, out, log, broken = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "log"), tmp_path / "broken"
    saved = listing.saved_pages(f"file://{pages}")

    def fetch(category, page, flag=str(broken)):
        # the driver's counting gets through, the task that reads items does not
        from pyspark import TaskContext

        if TaskContext.get() is not None and category == "b" and Path(flag).exists():
            raise OSError("no answer")
        return saved(category, page)

    def once():
        df = listing.read_listing(spark, fetch, "ean long", ["a", "b"], stream=True, page_size=4, pages_per_task=2)
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    read = lambda: sorted((r["category"], r["number"], r["ean"]) for r in spark.read.parquet(out).collect())
    want = lambda **n: [(c, i, i) for c in sorted(n) for i in range(n[c])]
    lay(pages, "a", goods(6, "a"), 4)
    once()
    assert read() == want(a=6)
    lay(pages, "a", goods(9, "a"), 4)
    lay(pages, "b", goods(20, "b"), 4)
    broken.touch()
    with pytest.raises(Exception, match="no answer"):
        once()
    broken.unlink()
    lay(pages, "b", goods(23, "b"), 4)
    once()
    once()
    assert read() == want(a=9, b=23)


HEADER = ["Штрихкод (EAN)", "Цена (Price)", "Полка"]


def prices(spark, files):
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None, 1) for p, c in files], "path string, content binary, row int")
    return {(r["path"], r["row"]): (r["ean"], r["price"], r["shelf"], r["error"]) for r in sheets.price_list(sheets.sheet_rows(df)).collect()}


def test_price_list_reports_every_row(spark):
    good = sheets.workbook(
        [[], HEADER, ["04870001", "1 234,50", "A & <1>"], [4870000000017, 99, None], [4.87e12, 10.5, " B "], [None, 5, "C"], ["x1", "нет", None], ["x2", 0, None], ["x3", None, None], [], ["d", 1, None], ["d", 2, None], ["d", "?", None], ["e", "NaN", None], ["f", " 7 "]]
    )
    got = prices(spark, [("g", good)])
    assert {r: v for (_, r), v in got.items()} == {
        3: ("04870001", 1234.5, "A & <1>", None), 4: ("4870000000017", 99.0, None, None), 5: ("4870000000000", 10.5, "B", None), 6: (None, 5.0, "C", "no_ean"), 7: ("x1", None, None, "bad_price"), 8: ("x2", 0.0, None, "bad_price"),
        9: ("x3", None, None, "bad_price"), 11: ("d", 1.0, None, "repeated"), 12: ("d", 2.0, None, "repeated"), 13: ("d", None, None, "bad_price"), 14: ("e", got["g", 14][1], None, "bad_price"), 15: ("f", 7.0, None, None),
    }


def test_damaged_and_foreign_files(spark):
    good = sheets.workbook([HEADER, ["1", 1, None]])
    got = prices(spark, [("cut", good[: len(good) // 2]), ("none", None), ("text", b"ean;price"), ("lacks", sheets.workbook([["EAN", "Total"], ["1", 2]])), ("caps", sheets.workbook([["ШТРИХКОД", "ЦЕНА"], ["1", 2]])), ("only", sheets.workbook([HEADER])), ("void", sheets.workbook([])), ("ok", good)])
    assert {k: v[3] for k, v in got.items()} == {("cut", None): "damaged: BadZipFile", ("none", None): "damaged: BadZipFile", ("text", None): "damaged: BadZipFile", ("lacks", 2): "no_columns", ("caps", 2): None, ("ok", 2): None}


def test_sheets_of_other_writers(spark, tmp_path):
    """Several sheets, cells and rows without references, rich and inline texts, phonetic hints, formulas' texts."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>E</t></r><r><t>AN</t></r><rPh><t>no</t></rPh></si><si><t>Price</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>00</t></is></c><c><v>3</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="5"><c r="AB5" t="s"><v>1</v></c><c r="C5" t="s"><v>0</v></c></row><row r="9"><c r="C9" t="str"><f>A1</f><v>77</v></c><c r="AB9"><v>1E1</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.txt").write_text("not read")
    got = sheets.price_list(sheets.read_sheets(spark, f"file://{tmp_path}")).collect()
    assert sorted((r["sheet"], r["row"], r["ean"], r["price"], r["error"]) for r in got) == [("sheet1", 2, "00", 3.0, None), ("sheet2", 9, "77", 10.0, None)]


def test_workbooks_of_any_width_come_back(spark):
    wide = [[f"h{i}" for i in range(800)], [f"v{i}" for i in range(800)]]
    df = spark.createDataFrame([("w", bytearray(sheets.workbook(wide)))], "path string, content binary")
    assert sheets.sheet_rows(df).first()["cells"] == dict(zip(*wide))
    long = spark.range(5000).select(F.lit("l").alias("file"), F.col("id").alias("ean"), (F.col("id") + 0.5).alias("price"))
    back = sheets.price_list(sheets.sheet_rows(sheets.to_workbooks(long, "file", {"ean": "EAN", "price": "Price"})))
    assert back.filter("error is null and cast(ean as long) = row - 2 and price = row - 1.5").count() == 5000
    assert sheets.to_workbooks(long.limit(0), "file", {"ean": "EAN", "price": "Price"}).count() == 0


def test_snapshot_rewrites_named_stores_only(spark, tmp_path):
    at = f"file://{tmp_path}/held"
    put = lambda rows: merging.write_snapshot(at, spark.createDataFrame(rows, "ean string, store int, price double"), "store", "ean")
    files = lambda s: {(f, os.stat(f).st_mtime_ns) for f in Path(f"{tmp_path}/held/store={s}").glob("*.parquet")}
    put([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), (None, 1, 9.0), ("z", None, 9.0), ("a", 3, 0.0)])
    before = files(1), files(2), files(3)
    put([("a", 1, 5.0), ("c", 1, None), ("a", 1, 4.0), ("n", 4, 7.0)])
    assert files(2) == before[1] and files(3) == before[2] and not files(1) & before[0]
    put([])
    got = sorted((r["store"], r["ean"], r["price"]) for r in spark.read.parquet(at).collect())
    assert got == [(1, "a", 5.0), (1, "b", 2.0), (1, "c", None), (2, "a", 3.0), (3, "a", 0.0), (4, "n", 7.0)]
