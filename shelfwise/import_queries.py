"""Queries of paged listings, price lists in workbooks and snapshots kept by store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise import plans
from shelfwise.catalog_queries import STOCK, query
from shelfwise.entity_queries import _rows
from shelfwise.operators import merging
from shelfwise.sources import listing, read_table, sheets
from shelfwise.sources.work import work_folder


#: Pages of a listing in a file.
PAGES_PER_FILE = 1000


@query(
    """SELECT CAST(p_size AS VARCHAR) AS category, CAST((row_number() OVER w - 1) // 12 AS INTEGER) AS page, row_number() OVER w - 1 AS number, p_partkey AS ean, p_name AS title, p_retailprice AS price
    FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)"""
)
def listing_pages(spark, d):
    """All products, laid out as pages of 12 by category, then read as a service's listing."""
    folder = work_folder(spark, "pages")
    numbered = _rows(spark, d, "part", "CAST(p_size AS VARCHAR) AS category, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n, p_partkey AS ean, p_name AS title, p_retailprice AS price")
    # pages grow with the table: many lie in a file, and a task reads a file
    listing.save_pages(numbered, folder, "category", "n", pages_per_file=PAGES_PER_FILE)
    categories = [str(r[0]) for r in read_table(spark, d, "part").select("p_size").distinct().collect()]
    return listing.read_listing(spark, listing.saved_pages(folder, PAGES_PER_FILE), "ean long, title string, price double", sorted(categories), pages_per_task=PAGES_PER_FILE)


# Price lists of 64 orders each; every other list keeps its numbers as texts.
LISTED = """SELECT 'list-' || CAST(l_orderkey // 64 AS VARCHAR) || '.xlsx' AS path, l_orderkey // 64 % 2 AS kind, CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN NULL ELSE 4870000000000 + l_partkey END AS ean,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 0.0 ELSE l_extendedprice END AS price, l_returnflag || CAST(l_linenumber AS VARCHAR) AS shelf FROM lineitem"""


@query(
    f"""WITH l AS ({LISTED}), f AS (SELECT path, CAST(ean AS VARCHAR) AS ean, price, shelf, CASE WHEN ean IS NULL THEN 'no_ean' WHEN price IS NULL OR price <= 0 THEN 'bad_price' END AS error FROM l)
    SELECT path, ean, price, shelf, CASE WHEN error IS NULL AND count(*) FILTER (error IS NULL) OVER (PARTITION BY path, ean) > 1 THEN 'repeated' ELSE error END AS error FROM f"""
)
def price_sheets(spark, d):
    """All order lines as price lists in workbooks, read back and checked."""
    lines = _rows(spark, d, "lineitem", LISTED.removeprefix("SELECT ").rpartition(" FROM ")[0].replace("l_orderkey // 64", "l_orderkey div 64"))
    header = {"ean": "Штрихкод (EAN)", "price": "Цена (Price)", "shelf": "Полка"}
    as_text = {"ean": F.col("ean").cast("string"), "price": F.coalesce(F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")), F.lit("нет"))}
    written = sheets.to_workbooks(lines.filter("kind = 0"), "path", header).unionByName(sheets.to_workbooks(lines.filter("kind = 1").withColumns(as_text), "path", header))
    return sheets.price_list(sheets.sheet_rows(written)).drop("sheet", "row")


#: Folders of stores of the snapshot.
STORE_GROUPS = 64


@query(
    f"""WITH {STOCK} SELECT store_id, ean, CASE WHEN store_id % 3 = 0 AND ean % 2 = 0 THEN price + 1 ELSE price END AS price FROM stock
    UNION ALL SELECT DISTINCT store_id, -1, 0.5 FROM stock WHERE store_id % 3 = 0 AND ean % 2 = 0"""
)
def snapshots_by_store(spark, d):
    """Every store's products, of which the products of each third store are then put again."""
    held_at = work_folder(spark, "snapshot")
    s = plans.stock(spark, d).select("store_id", "ean", "price")
    # stores grow with the tables, and a folder a store with them: they are kept in groups
    merging.write_snapshot(held_at, s, "store_id", "ean", STORE_GROUPS)
    again = merging.read_snapshot(spark, held_at, s.schema).filter("store_id % 3 = 0 and ean % 2 = 0")
    news = again.select("store_id").distinct().select("store_id", F.lit(-1).cast("long").alias("ean"), F.lit(0.5).alias("price"))
    merging.write_snapshot(held_at, again.withColumn("price", F.col("price") + 1).unionByName(news), "store_id", "ean", STORE_GROUPS)
    return merging.read_snapshot(spark, held_at, s.schema)
