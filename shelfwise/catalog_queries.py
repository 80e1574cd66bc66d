"""Queries over the standard tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise import plans
from shelfwise.functions import barcodes as B
from shelfwise.functions import text as X
from shelfwise.operators import analytics as A
from shelfwise.operators import catalog as C
from shelfwise.operators import fitcheck, matching, merging, profiles, retrieval
from shelfwise.sources import read_table, resume
from shelfwise.streaming import rate_limit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The catalog tables, for the SQL.
SCANS = """scans AS (SELECT event_id, user_id, user_id % 10 AS store_id,
  (user_id * 7 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 13) % 260 AS ean, ts AS scanned_at, event_type AS status, value FROM events)"""
PRODUCTS = """products AS (SELECT p_partkey AS ean, p_name AS name, p_brand AS brand, p_type AS category, p_size * 2 AS quality,
  p_retailprice AS price, p_size > 10 AS is_active FROM part)"""
STOCK = """stock AS (SELECT l_suppkey AS store_id, l_partkey AS ean, min(l_extendedprice / l_quantity) AS price,
  CASE WHEN arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) = 'R' THEN 'out_of_stock' ELSE 'in_stock' END AS stock_status
  FROM lineitem GROUP BY ALL)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Resolution and joins


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    keys = plans.scans(spark, d).select("store_id", "ean").distinct()
    tiers = [
        ("found_store", plans.stock(spark, d).select("store_id", "ean", F.col("stock_status").alias("payload"))),
        ("found_global", plans.products(spark, d).filter("brand not in ('Brand#1', 'Brand#2')").select("ean", F.col("name").alias("payload"))),
        ("found_cache", plans.cached(spark, d).select("ean", F.col("name").alias("payload"))),
    ]
    return C.cascade(keys, tiers, ["store_id", "ean"], ["ean"])


CASCADE = f"""WITH {SCANS}, {PRODUCTS}, {STOCK}, k AS (SELECT DISTINCT store_id, ean FROM scans),
r AS (SELECT k.store_id, k.ean, s.stock_status, p.name, o.o_orderpriority AS cached FROM k
  LEFT JOIN stock s USING (store_id, ean) LEFT JOIN products p ON p.ean = k.ean AND p.brand NOT IN ('Brand#1', 'Brand#2')
  LEFT JOIN orders o ON o.o_orderkey = k.ean AND o.o_orderstatus = 'F')"""


@query(
    f"""{CASCADE} SELECT store_id, ean, CASE WHEN stock_status IS NOT NULL THEN 'found_store' WHEN name IS NOT NULL THEN 'found_global'
    WHEN cached IS NOT NULL THEN 'found_cache' ELSE 'not_found' END AS found_status, coalesce(stock_status, name, cached) AS payload FROM r"""
)
def cascade_resolution(spark, d):
    return _resolved(spark, d)


@query(
    f"""{CASCADE}, e AS (SELECT *, CASE WHEN stock_status IS NOT NULL THEN 'found_store' WHEN name IS NOT NULL THEN 'found_global'
    WHEN cached IS NOT NULL THEN 'found_cache' ELSE 'not_found' END AS found_status FROM r)
    SELECT s.store_id, found_status, count(*) AS scans FROM scans s JOIN e USING (store_id, ean) GROUP BY ALL"""
)
def scan_outcomes(spark, d):
    found = _resolved(spark, d).select("store_id", "ean", "found_status")
    counts = plans.scans(spark, d).groupBy("store_id", "ean").agg(F.count("*").alias("n"))
    return counts.join(found, ["store_id", "ean"]).groupBy("store_id", "found_status").agg(F.sum("n").alias("scans"))


@query(f"WITH {PRODUCTS}, {STOCK} SELECT s.store_id, s.ean, s.price, s.stock_status, p.name, p.brand FROM stock s LEFT JOIN products p USING (ean)")
def catalog_left_join(spark, d):
    p = plans.products(spark, d).select("ean", F.struct("name", "brand").alias("product"))
    return plans.stock(spark, d).join(p, "ean", "left").select("store_id", "ean", "price", "stock_status", "product.name", "product.brand")


@query(f"WITH {PRODUCTS}, {STOCK} SELECT s.store_id, s.ean, s.stock_status, p.category FROM stock s JOIN products p USING (ean) WHERE p.is_active")
def catalog_inner_active(spark, d):
    return plans.stock(spark, d).join(plans.products(spark, d), "ean").filter("is_active").select("store_id", "ean", "stock_status", "category")


@query(
    f"""WITH {PRODUCTS}, {SCANS} SELECT s.ean, p.ean AS product, count(*) AS scans FROM scans s
    JOIN products p ON s.ean IN (p.ean + 1000, p.ean * 2) GROUP BY ALL"""
)
def alternate_code_join(spark, d):
    p = plans.products(spark, d).select(F.col("ean").alias("product"), F.array(F.col("ean") + 1000, F.col("ean") * 2).alias("alternates"))
    s = plans.scans(spark, d).groupBy("ean").agg(F.count("*").alias("scans"))
    return C.alternate_key_join(s, "ean", p, "alternates").select("ean", "product", "scans")


@query(
    f"""WITH {PRODUCTS}, {STOCK} SELECT p.ean, p.name, coalesce(s.price, p.price) AS price, s.stock_status, s.ean IS NOT NULL AS is_overlaid
    FROM products p LEFT JOIN (SELECT * FROM stock WHERE store_id = 1) s USING (ean)"""
)
def store_overlay(spark, d):
    over = plans.stock(spark, d).filter("store_id = 1").select("ean", "price", "stock_status")
    return C.overlay(plans.products(spark, d).select("ean", "name", "price"), over, ["ean"], ["price", "stock_status"])


@query(
    f"""WITH {PRODUCTS}, {STOCK}, {SCANS} SELECT DISTINCT s.ean, coalesce(p.name, 'cached ' || o.o_orderpriority, 'Product ' || s.ean) AS label
    FROM scans s LEFT JOIN products p ON p.ean = s.ean LEFT JOIN orders o ON o.o_orderkey = s.ean AND o.o_orderstatus = 'F'"""
)
def hydrate_with_precedence(spark, d):
    s = plans.scans(spark, d).select("ean").distinct()
    out = s.join(plans.products(spark, d).select("ean", "name"), "ean", "left").join(plans.cached(spark, d).withColumnRenamed("name", "cached"), "ean", "left")
    return out.select("ean", F.coalesce("name", F.concat(F.lit("cached "), "cached"), F.concat(F.lit("Product "), F.col("ean").cast("string"))).alias("label"))


@query(f"WITH {STOCK} SELECT s.* FROM stock s WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = s.store_id AND s_nationkey < 12)")
def owner_visible_rows(spark, d):
    owned = read_table(spark, d, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("store_id"))
    return C.visible_rows(plans.stock(spark, d), owned, "store_id")


@query(
    f"""WITH {SCANS} SELECT e.event_id, c.c_custkey AS subscriber FROM (SELECT * FROM scans WHERE status = 'signup') e
    JOIN customer c ON c.c_nationkey = e.store_id AND c.c_mktsegment = 'BUILDING'"""
)
def notification_fanout(spark, d):
    e = plans.scans(spark, d).filter("status = 'signup'").select("event_id", "store_id")
    c = read_table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").cast("long").alias("store_id"), F.col("c_custkey").alias("subscriber"))
    return A.fan_out(e, c, "store_id").select("event_id", "subscriber")


# Filters and searches


@query(f"WITH {PRODUCTS} SELECT ean, name FROM products WHERE contains(lower(concat_ws(' ', name, brand, category)), 'e b')")
def search_concatenated(spark, d):
    return C.search(plans.products(spark, d), ["name", "brand", "category"], " E B ").select("ean", "name")


@query(f"WITH {PRODUCTS} SELECT ean, name FROM products WHERE contains(lower(name), '1') OR contains(lower(brand), '1') OR contains(CAST(ean AS VARCHAR), '1')")
def search_any_field(spark, d):
    p = plans.products(spark, d).withColumn("code", F.col("ean").cast("string"))
    return C.search_any(p, ["name", "brand"], ["code"], "1").select("ean", "name")


@query(f"WITH {SCANS} SELECT event_id, ean FROM scans WHERE scanned_at >= TIMESTAMP '2024-01-24 00:00:00' AND status IN ('view', 'click') AND value IS NOT NULL")
def recent_scans(spark, d):
    return A.since(plans.scans(spark, d), 7, plans.AS_OF).filter(F.col("status").isin("view", "click") & F.col("value").isNotNull()).select("event_id", "ean")


@query(
    f"""WITH {PRODUCTS} SELECT ean, len(list_filter([CASE WHEN NOT (price >= 0) THEN 'price' END, CASE WHEN NOT (quality BETWEEN 10 AND 90) THEN 'quality' END,
    CASE WHEN NOT (length(name) >= 5) THEN 'name' END], lambda x: x IS NOT NULL)) AS n_failed FROM products"""
)
def checked_constraints(spark, d):
    checks = {"price": F.col("price") >= 0, "quality": F.col("quality").between(10, 90), "name": F.length("name") >= 5}
    good, bad = C.split_checked(plans.products(spark, d), checks)
    return good.select("ean", F.lit(0).cast("long").alias("n_failed")).union(bad.select("ean", F.size("failed").cast("long")))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), l_linestatus) AS flag FROM lineitem WHERE l_quantity >= 30 AND NOT regexp_matches(l_returnflag, '[A]')")
def antifilter(spark, d):
    x = read_table(spark, d, "lineitem").filter((F.col("l_quantity") >= 30) & ~F.col("l_returnflag").rlike("[A]"))
    return x.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), "l_linestatus").alias("flag"))


@query(f"WITH {PRODUCTS} SELECT DISTINCT category FROM products")
def distinct_categories(spark, d):
    return plans.products(spark, d).select("category").distinct()


# Aggregates


@query(f"WITH {SCANS} SELECT store_id, count(*) AS scans, count(DISTINCT ean) AS products, count(*) FILTER (status <> 'error') AS found FROM scans WHERE scanned_at >= TIMESTAMP '2024-01-24' GROUP BY ALL")
def store_metrics(spark, d):
    return A.metrics(A.since(plans.scans(spark, d), 7, plans.AS_OF))


@query(f"WITH {SCANS}, {PRODUCTS} SELECT t.*, p.name FROM (SELECT ean, count(*) AS scan_count FROM scans GROUP BY ean ORDER BY scan_count DESC, ean LIMIT 10) t LEFT JOIN products p USING (ean)")
def top_scanned(spark, d):
    return A.top_scanned(plans.scans(spark, d), plans.products(spark, d), 10)


@query(
    f"""WITH {SCANS}, {STOCK}, c AS (SELECT store_id, ean, count(*) AS scan_count FROM scans GROUP BY ALL)
    SELECT store_id, ean, scan_count, CASE WHEN stock_status IS NULL THEN 'not_in_catalog' ELSE 'out_of_stock' END AS reason
    FROM c LEFT JOIN stock USING (store_id, ean) WHERE stock_status IS NULL OR stock_status = 'out_of_stock'"""
)
def missed_opportunities(spark, d):
    return A.missed(plans.scans(spark, d), plans.stock(spark, d))


@query("SELECT l_orderkey AS event_id, count(*) FILTER (l_returnflag <> 'R') AS sent, count(*) FILTER (l_returnflag = 'R') AS failed, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'sent' WHEN count(*) FILTER (l_returnflag <> 'R') > 0 THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey")
def delivery_rollup(spark, d):
    x = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"))
    x = x.agg(F.count_if(F.col("l_returnflag") != "R").alias("sent"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return x.withColumn("status", A.delivery_status(F.col("sent"), F.col("failed")))


@query(f"WITH {PRODUCTS} SELECT count(*) AS total, count(*) FILTER (quality >= 30) AS good, round(100.0 * count(*) FILTER (quality >= 30) / count(*), 1) AS good_pct, count(*) FILTER (is_active) AS active FROM products")
def run_statistics(spark, d):
    good = F.count_if(F.col("quality") >= 30)
    return plans.products(spark, d).agg(F.count("*").alias("total"), good.alias("good"), F.round(100.0 * good / F.count("*"), 1).alias("good_pct"), F.count_if("is_active").alias("active"))


# Dedup, order, limits


@query(f"WITH {SCANS} SELECT store_id, ean, event_id, scanned_at FROM (SELECT *, row_number() OVER (PARTITION BY store_id, ean ORDER BY scanned_at DESC, event_id % 2, event_id DESC) AS n FROM scans) WHERE n = 1")
def latest_per_key(spark, d):
    s = plans.scans(spark, d)
    both = s.filter("event_id % 2 = 0").withColumn("side", F.lit(0)).unionByName(s.filter("event_id % 2 = 1").withColumn("side", F.lit(1)))
    both = both.select("store_id", "ean", "scanned_at", (-F.col("side")).alias("side"), "event_id")
    return merging.newest_per_key(both, ["store_id", "ean"], ["scanned_at", "side", "event_id"]).select("store_id", "ean", "event_id", "scanned_at")


@query(f"WITH {SCANS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ean ORDER BY scanned_at DESC, event_id DESC) AS n FROM scans) WHERE n = 1) SELECT user_id, ean, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY scanned_at DESC, event_id DESC) AS place FROM l) WHERE place <= 50")
def recent_history(spark, d):
    order = [F.desc("scanned_at"), F.desc("event_id")]
    last = merging.latest_per_key(plans.scans(spark, d), ["user_id", "ean"], order)
    return C.top_per_key(last, ["user_id"], order, 50).select("user_id", "ean", "place")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def keep_first_copy(spark, d):
    return read_table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@query(f"WITH {SCANS} SELECT event_id, store_id FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY scanned_at DESC, event_id DESC) AS n FROM scans) WHERE n <= 100")
def queue_cap(spark, d):
    return C.top_per_key(plans.scans(spark, d), ["store_id"], [F.desc("scanned_at"), F.desc("event_id")], 100).select("event_id", "store_id")


@query(f"WITH {PRODUCTS} SELECT * FROM (SELECT ean, row_number() OVER (ORDER BY coalesce(price, 0), ean) AS place FROM products) WHERE place <= 50")
def sort_cheapest(spark, d):
    top = C.sort_catalog(plans.products(spark, d), "cheap", "ean").limit(50)
    # fifty rows: one window over them
    return top.select("ean", F.row_number().over(Window.orderBy(F.coalesce("price", F.lit(0.0)), "ean")).cast("long").alias("place"))


@query(f"WITH {PRODUCTS} SELECT ean, quality FROM products ORDER BY is_active DESC, quality DESC, ean LIMIT 50")
def sort_default(spark, d):
    return C.sort_catalog(plans.products(spark, d).withColumn("fits", F.col("is_active")), "default", "ean").limit(50).select("ean", "quality")


@query(f"WITH {STOCK} SELECT store_id, ean FROM stock WHERE (store_id, ean) NOT IN (SELECT store_id, ean FROM stock WHERE stock_status = 'out_of_stock')")
def resume_unfinished(spark, d):
    s = plans.stock(spark, d).withColumn("key", F.concat_ws("-", "store_id", "ean"))
    return resume(s, s.filter("stock_status = 'out_of_stock'"), "key").select("store_id", "ean")


@query(f"WITH {SCANS} SELECT coalesce(a.ean, b.ean) AS ean, CASE WHEN a.ean IS NULL THEN 'insert' WHEN b.ean IS NULL THEN 'delete' ELSE 'keep' END AS op FROM (SELECT DISTINCT ean FROM scans WHERE user_id % 3 = 0) a FULL JOIN (SELECT DISTINCT ean FROM scans WHERE user_id % 3 = 1) b ON a.ean = b.ean")
def sync_by_key(spark, d):
    return _synced(plans.scans(spark, d))


@query(ORACLES["sync_by_key"])
def sync_by_key_all(spark, d):
    return _synced(plans.scans(spark, d))


def _synced(s: DataFrame) -> DataFrame:
    return merging.sync_plan(s.filter("user_id % 3 = 0"), s.filter("user_id % 3 = 1"), ["ean"])


# Scalar functions


CODE = "CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(4870000000000 + p_partkey * 7919 AS VARCHAR), 13, '0') WHEN 1 THEN lpad(CAST(p_partkey * 104729 % 100000000 AS VARCHAR), 8, '0') WHEN 2 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0') ELSE CAST(p_partkey AS VARCHAR) END"


def _codes(spark, d):
    return read_table(spark, d, "part").selectExpr("p_partkey", f"{CODE.replace('VARCHAR', 'STRING')} AS code")


def _sql_check(n: int, first: int) -> str:
    return "(10 - (" + " + ".join(f"CAST(substr(code, {i + 1}, 1) AS INT) * {first if i % 2 == 0 else 4 - first}" for i in range(n)) + ") % 10) % 10"


@query(
    f"""SELECT p_partkey, code, CASE WHEN length(code) = 13 THEN {_sql_check(12, 1)} = CAST(substr(code, 13, 1) AS INT) WHEN length(code) = 12 THEN true
    WHEN length(code) = 8 THEN {_sql_check(7, 3)} = CAST(substr(code, 8, 1) AS INT) ELSE false END AS valid,
    CASE WHEN length(code) = 12 THEN code || ({_sql_check(12, 1)}) ELSE code END AS padded FROM (SELECT p_partkey, {CODE} AS code FROM part)"""
)
def barcode_checks(spark, d):
    x = _codes(spark, d)
    return x.select("p_partkey", "code", B.is_valid_ean(F.col("code")).alias("valid"), B.padded_ean13(F.col("code")).alias("padded"))


@query(
    """WITH c AS (SELECT p_partkey, p_partkey * 37 % 1000 AS n FROM part) SELECT p_partkey, CASE WHEN n <= 139 THEN 'US/CA' WHEN n BETWEEN 300 AND 379 THEN 'FR'
    WHEN n BETWEEN 400 AND 440 THEN 'DE' WHEN n BETWEEN 460 AND 469 THEN 'RU' WHEN n = 487 THEN 'KZ' WHEN n BETWEEN 500 AND 509 THEN 'UK' WHEN n BETWEEN 540 AND 549 THEN 'BE/LU'
    WHEN n BETWEEN 560 AND 569 THEN 'PT' WHEN n BETWEEN 570 AND 579 THEN 'DK' WHEN n BETWEEN 590 AND 599 THEN 'PL' WHEN n BETWEEN 600 AND 639 THEN 'ZA'
    WHEN n BETWEEN 640 AND 649 THEN 'FI' WHEN n BETWEEN 700 AND 709 THEN 'NO' WHEN n BETWEEN 730 AND 739 THEN 'SE' WHEN n BETWEEN 760 AND 769 THEN 'CH'
    WHEN n BETWEEN 800 AND 839 THEN 'IT' WHEN n BETWEEN 840 AND 849 THEN 'ES' WHEN n BETWEEN 860 AND 869 THEN 'TR' WHEN n BETWEEN 870 AND 879 THEN 'NL'
    WHEN n BETWEEN 900 AND 919 THEN 'AT' WHEN n BETWEEN 930 AND 939 THEN 'AU' ELSE 'unknown' END AS country FROM c"""
)
def barcode_countries(spark, d):
    x = read_table(spark, d, "part").selectExpr("p_partkey", "lpad(CAST(p_partkey * 37 % 1000 AS STRING), 3, '0') || '0000000000' AS code")
    return x.select("p_partkey", B.country(F.col("code")).alias("country"))


@query(
    r"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p>', ', ', 'g'), '<[^>]+>', '', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&plusmn;', '±'), '&mdash;', '—'), '&deg;', '°'),
    ',(SP*,)+', ',', 'g'), '^SP*,SP*', ''), '^SP+|SP+$', '', 'g'), '') AS visible FROM pages""".replace("SP", r"[\s\x0B\x{A0}\x{FEFF}\pZ]")
)
def strip_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("visible"))


URL = """CASE page_id % 7 WHEN 0 THEN 'https://images.openfoodfacts.org/products/1/front.jpg' WHEN 1 THEN 'https://resources.cdn-kaspi.kz/a.PNG?x=1' WHEN 2 THEN 'https://arbuz.kz/products/2.webp'
  WHEN 3 THEN 'https://ean-db.com/img' WHEN 4 THEN 'https://shop.example/products/1.jpeg' WHEN 5 THEN '' ELSE url END"""


@query(
    f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'openfoodfacts' WHEN 1 THEN 'kaspi' WHEN 2 THEN 'arbuz' WHEN 3 THEN 'ean-db' WHEN 4 THEN 'local' WHEN 6 THEN 'other' END AS source,
    'products/' || page_id || '/main.' || CASE page_id % 7 WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'jpg' END AS object_key FROM pages"""
)
def url_classes(spark, d):
    x = read_table(spark, d, "pages").select("page_id", F.expr(URL).alias("url"))
    return x.select("page_id", B.image_source(F.col("url")).alias("source"), B.object_key(F.col("page_id").cast("string"), "main", F.col("url")).alias("object_key"))


@query("SELECT p_partkey, list_reduce(list_transform(string_split(replace(lower(p_type), ' ', '-'), '-'), lambda w: upper(w[1]) || substr(w, 2)), lambda a, b: a || ' ' || b) AS title FROM part")
def slug_titles(spark, d):
    return read_table(spark, d, "part").select("p_partkey", X.slug_title(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))).alias("title"))


@query("SELECT doc_id, translate(lower(text), 'éèêëáàâäíìîïóòôöúùûü`', 'eeeeaaaaiiiioooouuuu''') AS folded, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def fold_and_estimate(spark, d):
    return read_table(spark, d, "documents").select("doc_id", X.fold_accents(F.col("text")).alias("folded"), X.token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[''`´]', '', 'g'), '[^a-zа-яё0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def normalised_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", X.normalise_text(F.col("text")).alias("plain"))


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || text) AS content_hash, 'en' AS language FROM documents")
def content_hashes(spark, d):
    x = read_table(spark, d, "documents")
    return x.select("doc_id", X.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash"), X.language(F.col("text")).alias("language"))


@query(
    f"""WITH {PRODUCTS} SELECT ean, greatest(0.0, least(5.0, floor(quality / 100.0 * 10 + 0.5) / 2)) AS stars,
    CASE WHEN quality / 4.0 > 22.5 THEN 'high' WHEN quality / 4.0 > 5 THEN 'medium' ELSE 'low' END AS light,
    greatest(0, least(20, CAST(floor(price / 100 + 0.5) AS BIGINT))) AS small FROM products"""
)
def ratings(spark, d):
    p = plans.products(spark, d)
    return p.select("ean", X.half_star(F.col("quality")).alias("stars"), X.traffic_light(F.col("quality") / 4.0, 5, 22.5).alias("light"), X.clamp_small(F.col("price") / 100, 0, 20).cast("long").alias("small"))


@query(f"WITH {SCANS} SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age, s > 7 * 86400 AS stale FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(scanned_at)) AS BIGINT) AS s FROM scans)")
def scan_ages(spark, d):
    as_of = F.lit(plans.AS_OF).cast("timestamp")
    ts = F.col("scanned_at").cast("timestamp")
    return plans.scans(spark, d).select("event_id", X.age_bucket(ts, as_of).alias("age"), ((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) > 7 * 86400).alias("stale"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS DOUBLE) AS number, nullif(CAST(regexp_replace(c_name, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS scraped FROM customer")
def numbers_from_text(spark, d):
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", X.number_or_null(F.regexp_extract("c_name", "([0-9]+)", 1)).alias("number"), X.scraped_number(F.col("c_name")).alias("scraped"))


# Scores and matches


@query(f"WITH {PRODUCTS} SELECT ean, CASE WHEN length(name) > 2 THEN 15 ELSE 0 END + CASE WHEN length(category) > 10 THEN 25 ELSE 0 END + CASE WHEN quality > 40 THEN 15 ELSE 0 END + CASE WHEN brand = 'Brand#3' THEN 5 ELSE 0 END + CASE WHEN is_active THEN 10 ELSE 0 END AS score FROM products")
def quality_scores(spark, d):
    present = {"name": F.length("name") > 2, "ingredients": F.length("category") > 10, "kcal": F.col("quality") > 40, "brand": F.col("brand") == "Brand#3", "image": F.col("is_active")}
    return plans.products(spark, d).select("ean", matching.quality_score(matching.DUMP_POINTS, present).cast("long").alias("score"))


@query(
    f"""WITH {PRODUCTS}, t AS (SELECT ean AS id, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS b, quality AS w,
      list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 1) AS words FROM products),
    p AS (SELECT l.id AS id_l, r.id AS id_r, CASE WHEN len(l.words) = 0 OR len(r.words) = 0 THEN 0.0 ELSE
      len(list_filter(l.words, lambda x: list_contains(r.words, x))) / greatest(len(l.words), len(r.words)) END AS raw, abs(l.w - r.w) < 5 AS near
      FROM t l JOIN t r ON l.b = r.b AND l.id % 2 = 0 AND r.id % 2 = 1),
    s AS (SELECT id_l, id_r, CASE WHEN near THEN least(1.0, raw + 0.15) ELSE raw END AS score FROM p)
    SELECT id_l, id_r, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id_l ORDER BY score DESC, id_r) AS n FROM s WHERE score >= 0.4) WHERE n = 1"""
)
def fuzzy_best_match(spark, d):
    return _matched(plans.products(spark, d))


@query(ORACLES["fuzzy_best_match"])
def fuzzy_best_match_all(spark, d):
    return _matched(plans.products(spark, d))


def _matched(products: DataFrame) -> DataFrame:
    p = products.select(F.col("ean").alias("id"), "name", F.col("quality").alias("weight"), X.normalise_brand(F.col("brand")).alias("block"))
    return matching.best_match(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "block").select("id_l", "id_r", F.round("score", 6).alias("score"))


@query(
    f"""WITH {PRODUCTS}, s AS (SELECT ean, greatest(1.0, least(95.0, CASE WHEN is_active THEN 35 ELSE 15 END - (ean % 3) * 6 + (ean % 4) * 3 + quality / 100.0 * 25
    + CASE WHEN ean % 8 = 0 THEN 20 WHEN ean % 8 <= 2 THEN 15 WHEN ean % 8 <= 4 THEN 9 ELSE 4 END + 4)) AS score FROM products)
    SELECT a.ean, b.ean AS other, CASE WHEN abs(2 * floor(a.score * 100 / (a.score + b.score) + 0.5) - 100) < 5 THEN 'draw'
    WHEN floor(a.score * 100 / (a.score + b.score) + 0.5) > 50 THEN 'a' ELSE 'b' END AS winner FROM s a JOIN s b ON b.ean = a.ean + 1"""
)
def compare_pairs(spark, d):
    e = F.col("ean")
    s = plans.products(spark, d).select("ean", matching.compare_score(F.col("is_active"), e % 3, e % 4, F.col("quality"), e % 8, F.lit("unknown")).alias("score"))
    b = s.select((e - 1).alias("ean"), e.alias("other"), F.col("score").alias("_b"))
    return s.join(b, "ean").select("ean", "other", matching.winner(F.col("score"), F.col("_b")).alias("winner"))


@query(
    f"""WITH {PRODUCTS}, t AS (SELECT ean AS id, category AS near, brand AS wide, price FROM products),
    p AS (SELECT a.id, b.id AS other, b.price, CASE WHEN a.near = b.near THEN 0 ELSE 1 END AS tier FROM t a JOIN t b ON a.id <> b.id AND (a.near = b.near OR a.wide = b.wide))
    SELECT id, place, other, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, price, other) AS place FROM p) WHERE place <= 3"""
)
def alternatives_top3(spark, d):
    return _alternatives(plans.products(spark, d))


@query(ORACLES["alternatives_top3"])
def alternatives_top3_all(spark, d):
    return _alternatives(plans.products(spark, d))


def _alternatives(products: DataFrame) -> DataFrame:
    p = products.select(F.col("ean").alias("id"), F.col("category").alias("near"), F.col("brand").alias("wide"), "price")
    return matching.alternatives(p, "near", "wide", 3)


@query(
    """WITH t AS (SELECT doc_id, lower(text) AS x FROM documents), r AS (SELECT doc_id, contains(x, 'flour') OR contains(x, 'wheat') OR contains(x, 'rye')
    OR contains(x, 'barley') OR contains(x, 'gluten') AS gluten, contains(x, 'lard') OR contains(x, 'pork') OR contains(x, 'gelatin') AS haram,
    contains(x, 'egg') OR contains(x, 'albumin') AS eggs FROM t)
    SELECT doc_id, CASE WHEN eggs OR haram OR gluten THEN 'danger' ELSE 'safe' END AS verdict,
    CAST(eggs AS INT) + CAST(gluten AS INT) + CAST(haram AS INT) AS n_reasons FROM r"""
)
def fit_check_texts(spark, d):
    # the lists of its SQL
    lists = {"synonyms": {"eggs": ["egg", "albumin"], "gluten": ["flour", "wheat", "rye", "barley", "gluten"]}, "haram": ["lard", "pork", "gelatin"], "trace_phrases": []}
    return _fit_of_texts(spark, d, ["eggs"], ["celiac"], fitcheck.FIT_RULES | lists)


def _named(text: str, words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({text}, w))) > 0"


def _fit_sql() -> str:
    r = fitcheck.FIT_RULES
    near = " || chr(10) || ".join(f"CASE WHEN contains(x, '{p}') THEN substr(x, instr(x, '{p}') + {len(p)}, 100) ELSE '' END" for p in r["trace_phrases"])
    count = lambda text: " + ".join(f"CAST({_named(text, words)} AS INT)" for words in r["synonyms"].values())
    return f"""WITH t AS (SELECT doc_id, x, {near} AS near FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)),
    n AS (SELECT doc_id, {count("x")} AS worded, {count("near")} AS traced, CAST({_named("x", r["sweeteners"])} AS INT) + CAST({_named("x", r["haram"])} AS INT) AS other FROM t)
    SELECT doc_id, CASE WHEN worded + other > 0 THEN 'danger' WHEN traced > 0 THEN 'warning' ELSE 'safe' END AS verdict, worded + traced + other AS n_reasons FROM n"""


@query(_fit_sql())
def fit_check_allergens(spark, d):
    return _fit_of_texts(spark, d, list(fitcheck.FIT_RULES["synonyms"]), ["celiac", "pku"], fitcheck.FIT_RULES)


def _fit_of_texts(spark: SparkSession, d: str, allergens: list[str], conditions: list[str], rules: dict) -> DataFrame:
    none = F.array().cast("array<string>")
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = read_table(spark, d, "documents").select(
        "doc_id", F.lit("").alias("name"), F.col("text").alias("ingredients"), none.alias("allergens"), none.alias("traces"), none.alias("diet_tags"),
        F.lit(None).cast("double").alias("sugar"), F.lit(None).cast("double").alias("protein"), F.lit(0.0).alias("alcohol"), F.lit("unknown").alias("halal_status"),
        listed(allergens).alias("user_allergens"), none.alias("custom_allergens"), listed(conditions).alias("conditions"), none.alias("diets"),
        F.lit(True).alias("halal_only"), F.lit(False).alias("halal_strict"),
    )
    # what speaks against a product; confirmations are not counted
    against = F.filter("reasons", lambda r: r["severity"] != "safe")
    return fitcheck.check_fit(rows, rules).select("doc_id", "verdict", F.size(against).alias("n_reasons"))


# Mutations


@query(
    f"""WITH {PRODUCTS}, s AS (SELECT ean + 100 AS ean, CASE WHEN ean % 5 = 0 THEN NULL ELSE upper(name) END AS name, brand, price * 2 AS price FROM products)
    SELECT coalesce(t.ean, s.ean) AS ean, CASE WHEN s.ean IS NOT NULL THEN s.name ELSE t.name END AS name,
    CASE WHEN t.ean IS NOT NULL THEN t.brand ELSE s.brand END AS brand, CASE WHEN s.ean IS NOT NULL THEN s.price ELSE t.price END AS price
    FROM (SELECT ean, name, brand, price FROM products) t FULL JOIN s ON t.ean = s.ean"""
)
def upsert_products(spark, d):
    t = plans.products(spark, d).select("ean", "name", "brand", "price")
    s = t.select((F.col("ean") + 100).alias("ean"), F.when(F.col("ean") % 5 != 0, F.upper("name")).alias("name"), "brand", (F.col("price") * 2).alias("price"))
    return merging.upsert(t, s, ["ean"], ["name", "price"], insert_only=["brand"])


@query(f"WITH {STOCK} SELECT store_id, ean FROM stock WHERE stock_status = 'in_stock' UNION SELECT store_id, ean FROM stock WHERE ean < 50")
def insert_missing(spark, d):
    s = plans.stock(spark, d).select("store_id", "ean", "stock_status")
    return merging.insert_ignore(s.filter("stock_status = 'in_stock'"), s.filter("ean < 50"), ["store_id", "ean"], ["stock_status"]).select("store_id", "ean")


@query(f"WITH {PRODUCTS} SELECT ean, CASE WHEN brand = 'Brand#1' THEN false ELSE is_active END AS is_active, CASE WHEN brand = 'Brand#1' THEN price + 1 ELSE price END AS price, brand = 'Brand#1' AS updated FROM products WHERE ean % 7 <> 0")
def update_and_delete(spark, d):
    t = merging.delete_where(plans.products(spark, d).select("ean", "brand", "is_active", "price"), F.col("ean") % 7 == 0)
    return merging.update_where(t, F.col("brand") == "Brand#1", {"is_active": F.lit(False), "price": F.col("price") + 1}).drop("brand")


@query(f"WITH {PRODUCTS}, {SCANS}, n AS (SELECT ean, count(*) AS n FROM scans GROUP BY ean) SELECT p.ean, coalesce(CASE WHEN p.ean % 3 = 0 THEN NULL ELSE p.name END, p.brand) AS name, p.quality + coalesce(n.n, 0) AS scan_count FROM products p LEFT JOIN n USING (ean)")
def backfill_and_count(spark, d):
    t = plans.products(spark, d).select("ean", F.when(F.col("ean") % 3 != 0, F.col("name")).alias("name"), "brand", F.col("quality").cast("long").alias("scan_count"))
    return merging.add_counts(merging.backfill(t, {"name": "brand"}), plans.scans(spark, d), "ean", "scan_count").drop("brand")


@query(f"WITH {STOCK} SELECT store_id, ean, price FROM stock WHERE store_id = 2 AND ean % 2 = 0 UNION ALL SELECT store_id, ean, -1.0 FROM stock WHERE store_id = 2 AND ean % 2 = 1")
def snapshot_replace(spark, d):
    s = plans.stock(spark, d).select("store_id", "ean", "price")
    held = s.filter("store_id in (1, 2)").withColumn("price", F.lit(-1.0))
    return merging.replace_snapshot(held, s.filter("store_id = 2 and ean % 2 = 0"), "store_id", "ean")


# Profiles


@query(
    f"""WITH {SCANS}, p AS (SELECT user_id AS id, coalesce(list_sort(list(DISTINCT status) FILTER (event_id % 2 = 0 AND event_id % 3 <> 0)), []) AS l,
    coalesce(list_sort(list(DISTINCT status) FILTER (event_id % 2 = 1 AND event_id % 5 <> 0)), []) AS c FROM scans GROUP BY user_id)
    SELECT id, len(list_distinct(l || c)) AS n_merged, len(l) > 0 AND len(c) > 0 AND NOT (list_sort(l) = list_sort(c)) AS conflict,
    CASE WHEN len(c) = 0 THEN 'upload' WHEN len(l) = 0 THEN 'apply_cloud' WHEN list_sort(l) = list_sort(c) THEN 'keep_cloud' ELSE 'ask' END AS action FROM p"""
)
def profile_merge(spark, d):
    return _merged_profiles(plans.scans(spark, d))


@query(ORACLES["profile_merge"])
def profile_merge_all(spark, d):
    return _merged_profiles(plans.scans(spark, d))


def _merged_profiles(s: DataFrame) -> DataFrame:
    side = lambda c: F.array_sort(F.collect_set(F.when(F.expr(c), F.col("status"))))
    p = s.groupBy(F.col("user_id").alias("id")).agg(side("event_id % 2 = 0 and event_id % 3 <> 0").alias("local_tags"), side("event_id % 2 = 1 and event_id % 5 <> 0").alias("cloud_tags"))
    p = p.withColumns({"local_halal": F.lit(False), "cloud_halal": F.lit(False)})
    return profiles.merge_profiles(p, ["tags"]).select("id", F.size("tags").cast("long").alias("n_merged"), "conflict", "action")


# Retrieval


COSINE = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_dot_product(q, q)) AS s FROM embeddings, q)"""


def _query_vector(spark, d) -> list[float]:
    return read_table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {COSINE} SELECT vec_id, round(s, 6) AS similarity FROM v ORDER BY s DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return retrieval.nearest(read_table(spark, d, "embeddings"), _query_vector(spark, d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {COSINE}, t AS (SELECT * FROM v WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS similarity FROM t WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 5")
def cosine_topk_filtered(spark, d):
    v = read_table(spark, d, "embeddings")
    return retrieval.nearest(v, _query_vector(spark, d), 5, F.col("label") == 3, least=0.1, over_fetch=2).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, n, running FROM (SELECT doc_id, row_number() OVER w AS n, sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE n = 1 OR running <= 4000")
def context_budget(spark, d):
    x = read_table(spark, d, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 4).alias("cost"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    return A.within_budget(x, ["source"], "doc_id", "cost", 4000).select("doc_id", "n", "running")


@query()
def markdown_chunks(spark, d):
    sections = retrieval.heading_chunks(read_table(spark, d, "documents"), "doc_id", "text")
    return retrieval.paragraph_chunks(sections, ["doc_id", "section"], "content")


@query(
    """WITH RECURSIVE o AS (SELECT event_id AS request_id, user_id AS key, floor(epoch(ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
    s AS (SELECT request_id, key, n, t AS start, 1 AS used FROM o WHERE n = 1 UNION ALL
      SELECT o.request_id, o.key, o.n, CASE WHEN o.t - s.start > 86400 THEN o.t ELSE s.start END, CASE WHEN o.t - s.start > 86400 THEN 1 ELSE s.used + 1 END FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
    SELECT request_id, used <= 8 AS allowed FROM s"""
)
def rate_limited(spark, d):
    r = plans.scans(spark, d).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.unix_timestamp(F.col("scanned_at").cast("timestamp")).cast("double").alias("at"), F.lit(8).alias("max_requests"))
    return rate_limit(r, 86400.0)
