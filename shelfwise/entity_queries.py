"""Queries of the operators on entities, profiles, histories and nested records, and their SQL.

Their input rows are made of the standard tables by SQL that both engines read; what the operators do with them is
written out once more in each query's SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import plans
from shelfwise.catalog_queries import PRODUCTS, SCANS, STOCK, query
from shelfwise.functions import nested
from shelfwise.functions import products as P
from shelfwise.operators import analytics, catalog, entities, fitcheck, history, matching, merging, profiles, retrieval
from shelfwise.sources import found_items, read_table


def _rows(spark: SparkSession, d: str, table: str, columns: str, deal: str | None = None) -> DataFrame:
    """A table's rows as the columns of a SQL list, in Spark's names of types.

    deal: a key by which the rows are dealt to all tasks, for work that is long for the bytes it reads.
    """
    view = f"raw_{uuid.uuid4().hex}"
    rows = read_table(spark, d, table)
    (rows.repartition(deal) if deal else rows).createOrReplaceTempView(view)
    rows = spark.sql(f"SELECT {columns.replace('VARCHAR', 'STRING')} FROM {view}")
    spark.catalog.dropTempView(view)  # rows are resolved by now
    return rows


K = "CAST(p_partkey AS VARCHAR)"

# Entities

GLOBAL = f"""'g' || {K} AS id, lpad({K}, 8, '0') AS ean, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS category,
  CASE p_partkey % 3 WHEN 0 THEN '["a.png","b.png"]' WHEN 1 THEN 'no json' END AS images, CASE WHEN p_partkey % 4 = 0 THEN 'i' || {K} || '.png' ELSE '' END AS image_url,
  CASE p_partkey % 3 WHEN 0 THEN '["milk"," soy ","milk",""]' WHEN 1 THEN 'fish, eggs' END AS allergens_json,
  '{{"calories":"' || CAST(p_size AS VARCHAR) || '","proteins_100g":' || {K} || ',"fat":"x"}}' AS nutriments_json, p_brand AS manufacturer,
  CASE WHEN p_partkey % 2 = 0 THEN 'KZ' ELSE '' END AS country_of_origin, CASE p_partkey % 3 WHEN 0 THEN '{{"quantity":"5 g","expiry":"1 y"}}' WHEN 1 THEN '{{"weight":"","quantity":"7 g"}}' ELSE '[' END AS specs_json,
  substr('abcdefgh', CAST(p_partkey % 8 + 1 AS INT), 1) AS nutriscore, CASE p_partkey % 4 WHEN 0 THEN 'Halal' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END AS halal_status,
  CASE WHEN p_partkey % 7 = 0 THEN 'ai_enriched' ELSE 'x' END AS source_primary"""
OVERLAY = f"'s' || {K} AS store_product_id, CAST(p_partkey % 3 AS DOUBLE) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS shelf_zone, CASE WHEN p_partkey % 3 = 0 THEN '1' END AS shelf_position"


@query(
    f"""SELECT 'store' AS source, 'g' || {K} AS id, CASE WHEN p_partkey % 5 = 0 THEN 'grocery' ELSE p_type END AS category,
    CASE WHEN p_partkey % 4 = 0 THEN 'i' || {K} || '.png' WHEN p_partkey % 3 = 0 THEN 'a.png' WHEN p_partkey % 3 = 1 THEN 'no json' ELSE '/products/' || lpad({K}, 8, '0') || '.png' END AS image,
    CASE p_partkey % 3 WHEN 0 THEN 'milk|soy' WHEN 1 THEN 'fish|eggs' ELSE '' END AS allergens, CAST(p_size AS DOUBLE) AS kcal, CAST(p_partkey AS DOUBLE) AS protein, CAST(NULL AS DOUBLE) AS fat,
    p_brand AS maker, CASE WHEN p_partkey % 2 = 0 THEN 'KZ' END AS country, CASE p_partkey % 3 WHEN 0 THEN '5 g' WHEN 1 THEN '7 g' END AS weight, CASE WHEN p_partkey % 8 < 5 THEN upper(substr('abcde', CAST(p_partkey % 8 + 1 AS INT), 1)) END AS nutriscore,
    CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS halal_status, p_partkey % 7 = 0 AS is_enriched, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 3 AS DOUBLE) END AS price,
    CASE p_partkey % 6 WHEN 0 THEN 'A / 1' WHEN 2 THEN 'A' WHEN 4 THEN 'A' WHEN 3 THEN '1' END AS shelf FROM part"""
)
def entities_global(spark, d):
    e = entities.from_global(_rows(spark, d, "part", f"{GLOBAL}, {OVERLAY}"))
    return e.select(
        "source", "id", "category", "image", F.array_join("allergens", "|").alias("allergens"), "nutrition.kcal", "nutrition.protein", "nutrition.fat", F.col("manufacturer.name").alias("maker"),
        "manufacturer.country", "specs.weight", "nutriscore", "halal_status", "is_enriched", "price", "shelf",
    )


CACHE = f"""lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS normalized_name, '' AS normalized_brand, CASE WHEN p_partkey % 3 = 0 THEN 'u.png' END AS image_url,
  '["en:milk"]' AS normalized_traces_json, CAST(p_partkey % 6 AS INT) AS nova_group, CASE WHEN p_partkey % 4 = 0 THEN 'fatsecret' END AS source, '{{"salt_100g":"0.5"}}' AS normalized_nutriments_json"""


@query(
    f"""SELECT lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Товар ' || lpad({K}, 8, '0') END AS name, CAST(NULL AS VARCHAR) AS brand,
    CASE WHEN p_partkey % 3 = 0 THEN 'u.png' ELSE '/products/' || lpad({K}, 8, '0') || '.png' END AS image, 'en:milk' AS traces, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN CAST(p_partkey % 6 AS VARCHAR) END AS nova_group,
    CASE WHEN p_partkey % 4 = 0 THEN 'fatsecret' ELSE 'openfoodfacts' END AS external_source, 0.5::DOUBLE AS salt, true AS needs_review FROM part"""
)
def entities_cache(spark, d):
    e = entities.from_cache(_rows(spark, d, "part", CACHE))
    return e.select("ean", "name", "brand", "image", F.array_join("traces", "|").alias("traces"), F.col("nova_group").cast("string").alias("nova_group"), "external_source", "nutrition.salt", "needs_review")


DEMO = f"""'p' || {K} AS id, lpad({K}, 8, '0') AS ean, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '{{"name":"Maker","country":""}}' ELSE 'Plain' END AS manufacturer, p_brand AS brand, 'KZ' AS country,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '9 g' END AS quantity, '{{"weight":"8 g","storage":"cool"}}' AS specs, CASE WHEN p_partkey % 2 = 0 THEN 'true' END AS halal, 'never read' AS ingredients_raw"""


@query(
    f"""SELECT 'p' || {K} AS demo_id, CASE WHEN p_partkey % 2 = 0 THEN 'Maker' ELSE p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'Maker' ELSE 'Plain' END AS maker, 'KZ' AS country,
    CASE WHEN p_partkey % 3 = 0 THEN '8 g' ELSE '9 g' END AS quantity, 'cool' AS storage, CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'unknown' END AS halal_status, 'grocery' AS category, CAST(NULL AS VARCHAR) AS ingredients FROM part"""
)
def entities_demo(spark, d):
    e = entities.from_demo(_rows(spark, d, "part", DEMO))
    return e.select("demo_id", "brand", F.col("manufacturer.name").alias("maker"), "manufacturer.country", "quantity", "specs.storage", "halal_status", "category", "ingredients")


PAYLOAD = f"""lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS product_name, ' ' AS brands, 'from text' AS ingredients_text, '' AS ingredients_text_ru,
  CASE WHEN p_partkey % 2 = 0 THEN 'en:milk,en:lupin,en:wheat,en:gluten,en:crustaceans' END AS tags, CASE p_partkey % 3 WHEN 0 THEN 'en:Vegan,en:no-gluten' WHEN 1 THEN 'Halal certified,Gluten free' ELSE '' END AS labels,
  'en:e330,e100' AS additives, 'c' AS nutriscore_grade"""


@query(
    f"""SELECT lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 3 = 0 THEN 'Товар ' || lpad({K}, 8, '0') ELSE p_name END AS name, CAST(NULL AS VARCHAR) AS brand, 'from text' AS ingredients,
    CASE WHEN p_partkey % 2 = 0 THEN 'milk|gluten|shellfish' ELSE '' END AS allergens, CASE p_partkey % 3 WHEN 0 THEN 'vegan' WHEN 1 THEN 'halal|gluten_free' ELSE '' END AS diet_tags,
    CASE WHEN p_partkey % 3 = 1 THEN 'yes' ELSE 'unknown' END AS halal_status, 'e330|e100' AS additives, 'C' AS nutriscore FROM part"""
)
def entities_payload(spark, d):
    raw = _rows(spark, d, "part", PAYLOAD).withColumns({"allergens_tags": F.split("tags", ","), "labels_tags": F.split("labels", ","), "additives_tags": F.split("additives", ",")})
    join = lambda c, name: F.array_join(c, "|").alias(name)
    return entities.from_payload(raw).select("ean", "name", "brand", "ingredients", join("allergens", "allergens"), join("diet_tags", "diet_tags"), "halal_status", join("additives_tags", "additives"), "nutriscore")


STOCKED = """'g' || CAST(l_partkey AS VARCHAR) AS product_id, l_suppkey AS store_id, CAST(l_partkey AS VARCHAR) AS ean, CASE WHEN l_linenumber % 2 = 0 THEN 'local' ELSE '' END AS local_name,
  CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity END AS price, 'in_stock' AS stock_status, l_returnflag AS shelf_zone, '' AS shelf_position, l_orderkey, l_linenumber"""


def _store_sql(first: str, second: str) -> str:
    return f"""WITH p AS (SELECT 'g' || CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS pname, p_brand FROM part WHERE p_partkey % 3 > 0),
    s AS (SELECT {STOCKED} FROM lineitem)
    SELECT store_id, ean, coalesce(nullif({first}, ''), nullif({second}, ''), ean) AS name, p_brand AS brand, nullif(price, 0.0) AS price, shelf_zone AS shelf, 'unknown' AS halal_status, count(*) AS n
    FROM s LEFT JOIN p USING (product_id) GROUP BY ALL"""


def _store_rows(spark, d, prefer):
    p = _rows(spark, d, "part", f"'g' || {K} AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS name, p_brand AS brand, p_type AS category, '' AS image_url, '' AS halal_status, 'a' AS nutriscore, p_size AS quality, true AS is_verified, p_partkey")
    s = _rows(spark, d, "lineitem", STOCKED)
    out = entities.store_rows(s, p.filter("p_partkey % 3 > 0"), prefer)
    return out.groupBy("store_id", "ean", "name", "brand", "price", "shelf", "halal_status").agg(F.count("*").alias("n"))


@query(_store_sql("pname", "local_name"))
def store_rows_global_name(spark, d):
    return _store_rows(spark, d, "global")


@query(_store_sql("local_name", "pname"))
def store_rows_local_name(spark, d):
    return _store_rows(spark, d, "local")


@query(
    f"""SELECT lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'found' END AS description, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'nuts' ELSE 'milk|soy' END
    WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'nuts' ELSE 'fish|eggs' END ELSE CASE WHEN p_partkey % 2 = 0 THEN 'nuts' ELSE '' END END AS allergens,
    CASE WHEN p_partkey % 2 = 0 THEN 'vegan' ELSE '' END AS diet_tags, p_partkey % 2 = 0 OR p_partkey % 7 = 0 AS is_enriched FROM part"""
)
def entities_enriched(spark, d):
    e = entities.from_global(_rows(spark, d, "part", GLOBAL))
    f = _rows(spark, d, "part", f"lpad({K}, 8, '0') AS ean, CASE WHEN p_partkey % 3 > 0 THEN 'found' ELSE '' END AS description, '' AS ingredients, array('nuts') AS allergens, array('vegan', 'vegan') AS diet_tags, p_partkey")
    out = entities.enrich(e, f.filter("p_partkey % 2 = 0").drop("p_partkey"))
    return out.select("ean", "description", F.array_join("allergens", "|").alias("allergens"), F.array_join(F.array_distinct("diet_tags"), "|").alias("diet_tags"), "is_enriched")


# Resolution: some products share a code, in all stores and in each, so that a tier can be without a single answer.

_P = f"""p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 5 % 2 AS ean, [p_partkey + 60, p_partkey + 60] AS alt, p_size > 10 AS is_active, 'p' || {K} AS payload FROM part),
  stock AS (SELECT DISTINCT l_suppkey % 10 AS store_id, l_partkey - l_partkey % 3 % 2 AS ean, l_partkey AS product_id FROM lineitem)"""


@query(
    f"""WITH {SCANS}, {_P}, k AS (SELECT DISTINCT store_id, ean FROM scans), a AS (SELECT * FROM p WHERE is_active),
    s AS (SELECT store_id, stock.ean, alt, payload FROM stock JOIN a ON product_id = a.id),
    t AS (SELECT store_id, ean, 2 AS r, min(payload) AS payload FROM s GROUP BY ALL HAVING count(*) = 1
      UNION ALL SELECT store_id, c, 3, min(payload) FROM (SELECT store_id, payload, unnest(list_distinct(alt)) AS c FROM s) GROUP BY ALL HAVING count(*) = 1),
    g AS (SELECT ean, 4 AS r, min(payload) AS payload FROM a GROUP BY ALL HAVING count(*) = 1
      UNION ALL SELECT c, 5, min(payload) FROM (SELECT payload, unnest(list_distinct(alt)) AS c FROM a) GROUP BY ALL HAVING count(*) = 1
      UNION ALL SELECT p_partkey, 6, 'demo' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT o_orderkey, 7, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
    h AS (SELECT k.store_id, k.ean, r, payload FROM k JOIN t ON k.store_id = t.store_id AND k.ean = t.ean UNION ALL SELECT k.store_id, k.ean, r, payload FROM k JOIN g ON k.ean = g.ean)
    SELECT k.store_id, k.ean, coalesce(list_extract(['found_store', 'found_store_alternate', 'found_global', 'found_global_alternate', 'found_demo', 'found_cache'], CAST(min(r) - 1 AS INT)), 'not_found') AS found_status,
    arg_min(payload, r) AS payload FROM k LEFT JOIN h ON k.store_id = h.store_id AND k.ean = h.ean GROUP BY ALL"""
)
def cascade_all_tiers(spark, d):
    part = read_table(spark, d, "part")
    other = F.array(F.col("p_partkey") + 60, F.col("p_partkey") + 60)
    p = part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey - p_partkey % 5 % 2").alias("ean"), other.alias("alternate_eans"), (F.col("p_size") > 10).alias("is_active"), F.concat(F.lit("p"), "p_partkey").alias("payload"))
    lines = read_table(spark, d, "lineitem")
    stock = lines.select((F.col("l_suppkey") % 10).alias("store_id"), F.expr("l_partkey - l_partkey % 3 % 2").alias("ean"), F.col("l_partkey").alias("product_id")).distinct().withColumn("is_active", F.lit(True))
    demo = part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("ean"), F.lit("demo").alias("payload"))
    cache = plans.cached(spark, d).select("ean", F.col("name").alias("payload"))
    keys = plans.scans(spark, d).select("store_id", "ean").distinct()
    return catalog.resolve_codes(keys, p, stock, demo=demo, cache=cache)


UUID = f"'00000000-0000-4000-8000-' || lpad({K}, 12, '0')"
REFS = f"CASE p_partkey % 6 WHEN 0 THEN 'gp:' || {UUID} WHEN 1 THEN {UUID} WHEN 2 THEN 'ean:' || {K} WHEN 3 THEN lpad({K}, 8, '0') WHEN 4 THEN 'demo:p' || {K} ELSE 'other' || {K} END AS ref, p_partkey"


@query(
    f"""SELECT ref, CASE WHEN n < 2 THEN 'id' WHEN n < 4 THEN 'ean' WHEN n = 4 THEN 'demo' ELSE 'other' END AS kind, CASE WHEN n < 2 THEN 'by id ' || {K} WHEN n = 2 THEN NULL WHEN n = 3 THEN 'by code ' || {K} WHEN n = 4 THEN 'by demo ' || {K} END AS payload
    FROM (SELECT {REFS}, p_partkey % 6 AS n FROM part)"""
)
def references_resolved(spark, d):
    r = _rows(spark, d, "part", f"{REFS}, {UUID} AS id, lpad({K}, 8, '0') AS ean, 'p' || {K} AS demo_id, {K} AS n")
    named = lambda key, what: r.select(key, F.concat(F.lit(what), "n").alias("payload"))
    return catalog.resolve_references(r.select("ref"), named("id", "by id "), named("ean", "by code "), named("demo_id", "by demo "))


@query(
    f"SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'kaspi_1' WHEN 3 THEN '96385074' ELSE '96385075' END AS ean, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x' END AS i FROM part) WHERE p_partkey % 5 <> 3 OR p_partkey % 4 = 0"
)
def enrichment_needed(spark, d):
    x = _rows(spark, d, "part", "p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'kaspi_1' WHEN 3 THEN '96385074' ELSE '96385075' END AS ean, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x' END AS ingredients")
    return catalog.needs_enrichment(x, ["ingredients"], "ean").select("p_partkey")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def metadata_contains(spark, d):
    x = read_table(spark, d, "documents").withColumn("m", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return x.filter(catalog.contains_all("m", {"lang": "en", "source": "src1"})).filter(catalog.contains_all("m", {})).select("doc_id", "lang", "source")


# Profiles

PROFILE = """c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN true END AS halal, c_custkey % 5 = 0 AS halal_only, CAST(NULL AS BOOLEAN) AS halal_strict, c_custkey % 7 = 0 AS sugar_free, c_custkey % 4 AS kind"""


@query(
    """SELECT c_custkey AS id, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS halal, false AS halal_strict, c_custkey % 7 = 0 OR c_custkey % 4 = 1 AS sugar_free,
    CASE c_custkey % 4 WHEN 0 THEN 'tree_nuts|milk' WHEN 1 THEN 'crustaceans' ELSE '' END AS allergens, CASE c_custkey % 4 WHEN 0 THEN 'Мёд' WHEN 1 THEN 'dill|Мёд' ELSE '' END AS custom,
    CASE WHEN c_custkey % 4 = 1 THEN 'sugar_free|vegan' ELSE '' END AS goals, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 0 END + CAST(c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS INT) AS n FROM customer"""
)
def profiles_normalised(spark, d):
    x = _rows(spark, d, "customer", PROFILE)
    pick = lambda zero, one: F.when(F.col("kind") == 0, zero).when(F.col("kind") == 1, one)
    words = lambda *w: F.array(*[F.lit(v) for v in w])
    x = x.withColumns({
        "allergens": pick(words("nuts", "milk", "honey", "tree_nuts"), words("shellfish", "honey", "crustaceans")), "custom_allergens": pick(F.lit(None).cast("array<string>"), words("dill", "dill")),
        "diet_goals": pick(F.lit(None).cast("array<string>"), words("sugar_free", "vegan", "vegan")), "conditions": F.lit(None).cast("array<string>"),
    })
    n = profiles.normalise_profiles(x)
    join = lambda c, name: F.array_join(c, "|").alias(name)
    return n.select("id", "halal", "halal_strict", "sugar_free", join("allergens", "allergens"), join("custom_allergens", "custom"), join("diet_goals", "goals"), profiles.preference_count(n).alias("n"))


@query(
    """SELECT c_custkey AS id, c_custkey % 4 = 0 AS halal, c_custkey % 4 = 1 AS sugar_free, CASE WHEN c_custkey % 4 = 2 THEN 'milk' ELSE '' END AS allergens,
    CASE c_custkey % 4 WHEN 1 THEN 'sugar_free' WHEN 2 THEN 'dairy_free' ELSE '' END AS goals FROM customer"""
)
def profiles_preset(spark, d):
    x = _rows(spark, d, "customer", "c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'halal' WHEN 1 THEN 'sugar_free' WHEN 2 THEN 'dairy_free' ELSE 'none' END AS preset")
    return profiles.preset_profiles(x).select("id", "halal", "sugar_free", F.array_join("allergens", "|").alias("allergens"), F.array_join("diet_goals", "|").alias("goals"))


# Histories


@query(
    f"""WITH {SCANS}, h AS (SELECT event_id, store_id, ean, scanned_at, CASE WHEN user_id % 3 = 0 THEN 'guest' ELSE 'u' || CAST(user_id % 3 AS VARCHAR) END AS owner FROM scans),
    m AS (SELECT 'u1' AS owner, store_id, ean, max((scanned_at, event_id)) AS l FROM h WHERE owner IN ('guest', 'u1') GROUP BY ALL)
    SELECT owner, store_id, ean, l[1] AS scanned_at, l[2] AS event_id FROM m UNION ALL SELECT owner, store_id, ean, scanned_at, event_id FROM h WHERE owner = 'u2'"""
)
def guest_claimed(spark, d):
    s = plans.scans(spark, d)
    owner = F.when(F.col("user_id") % 3 == 0, "guest").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    return history.claim_guest(s.select(owner.alias("owner"), "store_id", "ean", "scanned_at", "event_id"), "u1")


@query(f"WITH {SCANS} SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(ean AS VARCHAR) END AS ean FROM scans WHERE event_id % 10 = 0 OR ean IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def favorites_kept(spark, d):
    s = plans.scans(spark, d).select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("ean")).alias("ean"))
    return history.still_favorite(s, read_table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ean"))).select("event_id", F.col("ean").cast("string").alias("ean"))


# Merges


def _fill_sql(mode: str) -> str:
    name = "CASE WHEN p_partkey % 4 > 0 THEN p_name WHEN p_partkey % 3 > 0 THEN 'new' ELSE '' END" if mode == "documented" else "CASE WHEN p_partkey % 3 > 0 THEN 'new' WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END"
    name = name.replace("ELSE '' END", "END") if mode == "documented" else name
    old = "CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END"
    return f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {name} ELSE {old} END AS name, CASE WHEN p_partkey % 2 = 0 THEN greatest(p_size, 25) ELSE p_size END AS quality FROM part"


def _filled(spark, d, mode):
    t = _rows(spark, d, "part", "p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS name, p_size AS quality")
    s = _rows(spark, d, "part", "p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'new' ELSE '' END AS name, 25 AS quality").filter("p_partkey % 2 = 0")
    return merging.fill_products(t, s, "p_partkey", ["name"], "quality", mode)


@query(_fill_sql("documented"))
def products_filled(spark, d):
    return _filled(spark, d, "documented")


@query(_fill_sql("as_written"))
def products_overwritten(spark, d):
    return _filled(spark, d, "as_written")


# Alternatives and matching

_TAGGED = f"""{PRODUCTS}, t AS (SELECT ean AS id, CASE WHEN ean % 9 > 0 THEN category || CAST(ean % 4 AS VARCHAR) END AS grp, category, list_distinct(['t' || CAST(ean % 3 AS VARCHAR), 't' || CAST(quality % 5 AS VARCHAR)]) AS tags,
  CASE WHEN ean % 11 > 0 THEN price ELSE 0 END AS price, quality FROM products)"""


def _tagged_sql(rank: str) -> str:
    return f"""WITH {_TAGGED}, r AS (SELECT *, {rank} AS rank FROM t),
    p AS (SELECT a.id, b.id AS other, b.rank, CASE WHEN a.grp = b.grp THEN 0 ELSE 1 END AS tier FROM r a JOIN r b ON a.category = b.category AND a.id <> b.id
      AND (a.grp = b.grp OR (a.grp IS DISTINCT FROM b.grp AND list_has_any(a.tags, b.tags))))
    SELECT id, place, other, tier FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, rank, other) AS place FROM p) WHERE place <= 3"""


def _tagged(spark, d, priority):
    p = plans.products(spark, d)
    text = lambda c: c.cast("string")
    t = p.select(
        F.col("ean").alias("id"), F.when(F.col("ean") % 9 > 0, F.concat("category", text(F.col("ean") % 4))).alias("group"), "category",
        F.array(F.concat(F.lit("t"), text(F.col("ean") % 3)), F.concat(F.lit("t"), text(F.col("quality") % 5))).alias("tags"), F.when(F.col("ean") % 11 > 0, F.col("price")).otherwise(0.0).alias("price"), "quality",
    )
    return matching.tagged_alternatives(t, 3, priority)


@query(_tagged_sql("-quality"))
def alternatives_by_quality(spark, d):
    return _tagged(spark, d, "balanced")


@query(_tagged_sql("coalesce(nullif(price, 0), 'inf'::DOUBLE)"))
def alternatives_by_price(spark, d):
    return _tagged(spark, d, "price")


@query(
    f"""WITH {PRODUCTS}, p AS (SELECT a.ean, b.ean AS other, b.is_active AS fits, abs(coalesce(a.price, 0) - coalesce(b.price, 0)) AS gap FROM products a JOIN products b ON a.category = b.category AND a.ean <> b.ean)
    SELECT ean, place, other FROM (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY fits DESC, gap, other) AS place FROM p) WHERE place <= 6"""
)
def alternatives_by_nearest_price(spark, d):
    p = plans.products(spark, d)
    return matching.nearest_prices(p, p.select("ean", "category", F.col("is_active").alias("fits"), "price"))


@query(
    f"""WITH {PRODUCTS} SELECT ean, CASE WHEN ean % 2 = 0 AND ean % 3 = 0 THEN 'halal' WHEN ean % 5 = 0 THEN 'sugar_free' WHEN price < 1000 THEN 'cheaper:' || CAST(CAST(trunc(1000 - price) AS BIGINT) AS VARCHAR) ELSE 'rating:' || CAST(quality AS VARCHAR) END AS why FROM products"""
)
def alternatives_explained(spark, d):
    p, e = plans.products(spark, d), F.col("ean")
    words = lambda w: F.array(F.lit(w))
    tags = F.when(e % 5 == 0, words("sugar_free")).otherwise(words("vegan"))
    why = matching.why_fits(e % 2 == 0, F.when(e % 3 == 0, "yes").otherwise("no"), words("sugar_free"), tags, F.col("price"), F.lit(1000.0), F.col("quality"))
    return p.select("ean", why.alias("why"))


_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 1)"


@query(
    f"""WITH {PRODUCTS}, l AS (SELECT ean AS id, CASE ean % 3 WHEN 0 THEN 'kinder' WHEN 1 THEN 'ritter sport' ELSE 'acme' END AS b, {_WORDS.format("name")} AS w, quality AS q FROM products WHERE ean % 2 = 0),
    r AS (SELECT ean AS id, CASE ean % 5 WHEN 0 THEN 'kinder inc' WHEN 1 THEN 'ritter' WHEN 2 THEN 'acme foods' WHEN 3 THEN 'kinder' ELSE 'other' END AS b, {_WORDS.format("name")} AS w, {_WORDS.format("category")} AS z, quality AS q FROM products WHERE ean % 2 = 1),
    s AS (SELECT l.id AS id_l, r.id AS id_r, greatest(len(list_filter(l.w, lambda x: list_contains(r.w, x))) / greatest(len(l.w), len(r.w)), len(list_filter(l.w, lambda x: list_contains(r.z, x))) / greatest(len(l.w), len(r.z))) AS raw, abs(l.q - r.q) < 5 AS near
      FROM l JOIN r ON (l.b = 'kinder' AND r.b LIKE 'kinder%') OR (l.b = 'ritter sport' AND r.b = 'ritter') OR (l.b = 'acme' AND r.b = 'acme foods')),
    t AS (SELECT id_l, id_r, CASE WHEN near THEN least(1.0, raw + 0.15) ELSE raw END AS score FROM s)
    SELECT id_l, id_r, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id_l ORDER BY score DESC, id_r) AS n FROM t WHERE score >= 0.4) WHERE n = 1"""
)
def catalog_matched(spark, d):
    p, e = plans.products(spark, d), F.col("ean")
    l = p.filter("ean % 2 = 0").select(e.alias("id"), F.when(e % 3 == 0, "KINDER").when(e % 3 == 1, "Ritter Sport").otherwise("Acme").alias("brand"), "name", F.col("quality").alias("weight"))
    brand = F.when(e % 5 == 0, "Kinder Inc").when(e % 5 == 1, "Ritter").when(e % 5 == 2, "Acme Foods").when(e % 5 == 3, "kinder").otherwise("other")
    r = p.filter("ean % 2 = 1").select(e.alias("id"), brand.alias("brand"), "name", F.col("category").alias("name_kz"), F.col("quality").alias("weight"))
    return matching.match_catalog(l, r).select("id_l", "id_r", F.round("score", 6).alias("score"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '111' ELSE '222' END AS ean FROM part WHERE (p_partkey % 4 = 0 AND (p_size = 0 OR abs(p_size - 10) < 5)) OR p_partkey % 4 = 1"""
)
def codes_known(spark, d):
    x = _rows(spark, d, "part", "p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Acme!' WHEN 1 THEN 'Bolt Foods' ELSE 'zzz' END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'Acme Milk Bar big' WHEN 1 THEN 'Bolt Nut' ELSE 'x y' END AS name, CAST(p_size AS DOUBLE) AS weight")
    return matching.known_codes(x, [{"brand": "acme", "name": "Milk Bar", "weight": 10, "ean": "111"}, {"brand": "Bolt", "name": "Nut Mix", "ean": "222"}])


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Клубничный' WHEN 1 THEN 'Ваниль' WHEN 2 THEN 'Кокосовая' END AS flavor, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS additives,
    CASE p_partkey % 4 WHEN 0 THEN 'chocolate_bars' WHEN 1 THEN 'chocolate_eggs' ELSE 'chocolate' END AS shelf FROM part"""
)
def flavors(spark, d):
    x = _rows(spark, d, "part", "p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Батончик клубничный шоколад' WHEN 1 THEN 'яйцо' WHEN 2 THEN 'кокосовая стружка' END AS name, CASE WHEN p_partkey % 4 = 1 THEN 'ваниль' END AS description, CASE WHEN p_partkey % 3 = 0 THEN 'мука, Е330, е1422, мЕ100' ELSE 'E330' END AS i")
    tags = F.lit(None).cast("array<string>")
    return x.select("p_partkey", matching.flavor(F.col("name"), tags, F.col("description")).alias("flavor"), matching.count_additives(F.col("i")).cast("int").alias("additives"), P.shelf(F.col("name")).alias("shelf"))


# Nested records

_ITEM = "named_struct('id', {id}, 'names', map('ru', {ru}, 'en', {en}), 'is_vegan', {vegan}, 'is_vegetarian', true, 'contains', {contains}, 'subs', {subs})"


def _groups(x: DataFrame) -> DataFrame:
    """Groups of ingredients: milk and e330 with two parts, and a group without a name."""
    sub = "array(named_struct('id', 'e1422', 'names', map('ru', '', 'en', 'starch')), named_struct('id', 'x1', 'names', map('ru', '', 'en', '')))"
    none = "CAST(NULL AS array<struct<id:string,names:map<string,string>>>)"
    milk = _ITEM.format(id="'milk'", ru="'молоко'", en="'milk'", vegan="p_partkey % 2 = 0", contains="array('lactose', 'zzz')", subs=none)
    acid = _ITEM.format(id="'e330'", ru="''", en="'acid'", vegan="true", contains="CAST(NULL AS array<string>)", subs=sub)
    blank = _ITEM.format(id="'q'", ru="''", en="''", vegan="true", contains="CAST(NULL AS array<string>)", subs=none)
    named = f"array(named_struct('name', 'base', 'items', array({milk}, {acid})), named_struct('name', '', 'items', array({blank}, {acid})))"
    return x.withColumn("groups", F.expr(f"CASE WHEN p_partkey % 5 > 0 THEN {named} END"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'base: молоко, acid (starch, x1); acid (starch, x1)' END AS ingredients, CASE WHEN p_partkey % 5 > 0 THEN 'E330|E1422' ELSE '' END AS additives,
    CASE WHEN p_partkey % 5 > 0 THEN 'milk' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 5 > 0 THEN '|' ELSE '' END || 'peanuts|soy' ELSE '' END AS allergens,
    CASE WHEN p_partkey % 3 > 0 THEN '' WHEN p_partkey % 5 > 0 AND p_partkey % 2 > 0 THEN 'vegetarian|halal' ELSE 'vegan|halal' END AS diets FROM part"""
)
def records_extracted(spark, d):
    x = _groups(_rows(spark, d, "part", "p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Арахис, соевый лецитин, Halal' END AS text"))
    g, t = F.col("groups"), F.col("text")
    join = lambda c, name: F.array_join(c, "|").alias(name)
    return x.select("p_partkey", nested.ingredient_text(g).alias("ingredients"), join(nested.record_additives(g), "additives"), join(nested.record_allergens(g, t), "allergens"), join(nested.record_diets(g, t), "diets"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 0 THEN floor(p_size * 1.5 + 0.5) END AS kcal, CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 2.0 END AS salt, CASE WHEN p_partkey % 3 = 0 THEN 'Snacks' WHEN p_partkey % 3 = 1 THEN 'Снеки' END AS category,
    CASE WHEN p_partkey % 2 = 0 THEN 3.5 END AS sugars_100g, CASE WHEN p_partkey % 4 > 0 THEN '3' END AS n_food FROM part"""
)
def records_measured(spark, d):
    x = _rows(spark, d, "part", """p_partkey, map('energy', p_size * CAST(1.5 AS DOUBLE), 'sodium', CAST(100 AS DOUBLE), 'salt', CASE WHEN p_partkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END) AS v,
      map('sugars', CASE WHEN p_partkey % 2 = 0 THEN CAST(3.5 AS DOUBLE) END, 'x', CAST(1 AS DOUBLE)) AS aliases,
      array(named_struct('id', '1399', 'titles', map('en', 'Tools')), named_struct('id', CASE WHEN p_partkey % 3 < 2 THEN '1400' ELSE 'x' END, 'titles', map('en', CASE WHEN p_partkey % 3 = 0 THEN 'Snacks' ELSE '' END, 'ru', 'Снеки'))) AS categories,
      array(named_struct('name', 'Energy', 'value', CAST(1 AS DOUBLE)), named_struct('name', 'Protein', 'value', CAST(2 AS DOUBLE)), named_struct('name', 'Energy', 'value', CAST(4 AS DOUBLE)), named_struct('name', 'Water', 'value', CAST(9 AS DOUBLE)),
        named_struct('name', 'Sodium, Na', 'value', CASE WHEN p_partkey % 4 > 0 THEN CAST(3 AS DOUBLE) END)) AS food""")
    n = nested.record_nutrition(F.col("v"))
    return x.select("p_partkey", n["kcal"].alias("kcal"), n["salt"].alias("salt"), nested.record_category(F.col("categories")).alias("category"),
        F.try_element_at(nested.nutrition_aliases(F.col("aliases")), F.lit("sugars_100g")).alias("sugars_100g"), F.when(nested.food_nutrients(F.col("food")).isNotNull(), F.size(nested.food_nutrients(F.col("food"))).cast("string")).alias("n_food"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cocoa' ELSE 'from page' END AS composition, '100' AS weight, CASE WHEN p_partkey % 3 = 0 THEN 'cool' END AS storage, 'last' AS taste FROM part"""
)
def features_filled(spark, d):
    one = "named_struct('name', {n}, 'code', 'c', 'unit', '', 'values', array(named_struct('value', {v}, 'number', CAST({x} AS DOUBLE))))"
    f = ", ".join([one.format(n="'Состав'", v="CASE WHEN p_partkey % 2 = 0 THEN 'cocoa' ELSE '' END", x="0"), one.format(n="'Вес'", v="''", x="100"), one.format(n="'Вкус'", v="'first'", x="1"), one.format(n="'Вкус'", v="'last'", x="1"), one.format(n="''", v="'z'", x="1")])
    none = "array<struct<name:string,code:string,unit:string,values:array<struct<value:string,number:double>>>>"
    x = _rows(spark, d, "part", f"p_partkey, array(named_struct('features', array({f})), named_struct('features', CAST(NULL AS {none}))) AS groups, map('Состав', 'from page', 'Условия', CASE WHEN p_partkey % 3 = 0 THEN 'cool' ELSE '' END) AS page")
    held = x.select("p_partkey", "page", nested.spec_features(F.col("groups")).alias("f"))
    full = held.select("p_partkey", nested.fill_features(F.col("f"), F.col("page"), ["Состав", "Вес", "Условия", "Вкус"]).alias("m"))
    at = lambda k: F.element_at("m", F.lit(k))
    return full.select("p_partkey", at("Состав").alias("composition"), F.regexp_replace(at("Вес"), r"\.0$", "").alias("weight"), at("Условия").alias("storage"), at("Вкус").alias("taste"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'b' END AS ean, p_name AS name, count(*) AS n FROM part GROUP BY ALL")
def search_results(spark, d):
    x = _rows(spark, d, "part", f"array(map('ean', '', 'EAN', CASE WHEN p_partkey % 2 = 0 THEN {K} ELSE '' END, 'barcode', 'b', 'title', p_name)) AS items")
    return found_items(x, "items").groupBy("ean", "name").agg(F.count("*").alias("n"))


# Analytics


@query(
    f"""WITH {SCANS}, {PRODUCTS}, {STOCK}, c AS (SELECT ean, count(*) AS scan_count FROM scans WHERE store_id = 3 AND scanned_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY ean)
    SELECT c.ean, scan_count, CASE WHEN stock_status IS NULL THEN 'not_in_catalog' ELSE 'out_of_stock' END AS reason, name FROM c LEFT JOIN (SELECT * FROM stock WHERE store_id = 3) s USING (ean) LEFT JOIN products USING (ean)
    WHERE stock_status IS NULL OR stock_status = 'out_of_stock'"""
)
def missed_of_store(spark, d):
    return analytics.missed_products(plans.scans(spark, d), plans.stock(spark, d), plans.products(spark, d), 3, 14, plans.AS_OF)


@query(
    f"""WITH {SCANS}, {PRODUCTS}, c AS (SELECT ean, count(*) AS scan_count FROM scans WHERE store_id = 3 AND scanned_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY ean ORDER BY scan_count DESC, ean LIMIT 5)
    SELECT c.ean, scan_count, name FROM c LEFT JOIN products USING (ean)"""
)
def top_scanned_of_store(spark, d):
    return analytics.top_scanned(plans.scans(spark, d), plans.products(spark, d), 5, 3, 7, plans.AS_OF)


@query(f"WITH {PRODUCTS} SELECT ean, CASE WHEN quality % 10 = 0 THEN 100 ELSE quality END AS score FROM products")
def fit_scores(spark, d):
    q = F.col("quality")
    return plans.products(spark, d).select("ean", fitcheck.fit_score(F.when(q % 10 == 0, 0).otherwise(q)).alias("score"))


# Fields of products, and scores


@query(
    f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'A' END AS nutriscore, CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'B' ELSE CASE WHEN p_partkey % 4 = 3 THEN 'A' END END AS prefix,
    CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS halal, CASE WHEN p_partkey % 5 = 0 THEN 'yes' WHEN p_partkey % 3 = 0 THEN 'no' WHEN p_partkey % 7 = 0 THEN 'no' ELSE 'unknown' END AS inferred,
    CASE WHEN p_partkey % 5 = 0 THEN 'vegan|halal' ELSE '' END AS diets, 'milk|gluten' AS allergens, 'E330|E100' AS additives, 'a b' AS clean, CASE WHEN p_partkey % 2 = 0 THEN 'http://x/' || {K} END AS url,
    CASE WHEN p_partkey % 2 = 0 THEN '12345678' END AS code, '4870000000001|4870000000002' AS codes, 'Acme' AS brand, CASE p_partkey % 3 WHEN 0 THEN 'A / 1' WHEN 1 THEN 'A' END AS shelf,
    CASE WHEN p_partkey % 2 = 0 THEN 'ean:' || {K} ELSE 'demo:p' || {K} END AS canonical, 'i.png' AS image, 'B / 2' AS dictionary FROM part"""
)
def product_fields(spark, d):
    x = _rows(spark, d, "part", f"""p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' c ' WHEN 1 THEN 'Bad' WHEN 2 THEN 'x' ELSE 'a' END AS n, CASE p_partkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'Bad' WHEN 2 THEN 'x' ELSE 'a' END AS m,
      CASE p_partkey % 3 WHEN 0 THEN ' Halal' WHEN 1 THEN 'FALSE' END AS h, CASE WHEN p_partkey % 3 = 0 THEN 'Pork fat' END AS i, CASE WHEN p_partkey % 7 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS alcohol,
      CASE WHEN p_partkey % 5 = 0 THEN array('en:Vegan', 'x-halal-x') END AS labels, array('en:milk', 'EN:GLUTEN', 'en:wheat', 'en:zzz') AS tags, array('en:e330', 'e100') AS adds, ' <b>a</b>  b<br>' AS dirty,
      CASE WHEN p_partkey % 2 = 0 THEN ' http://x/' || {K} ELSE 'ftp://x' END AS u, CASE WHEN p_partkey % 2 = 0 THEN ' 12345678 ' ELSE '1234567' END AS c, '4870000000001 x4870000000003 4870000000002, 4870000000001' AS cs,
      'Acme , Other' AS b, CASE WHEN p_partkey % 3 < 2 THEN 'A' ELSE '' END AS z, CASE WHEN p_partkey % 3 = 0 THEN '1' END AS pos, CASE WHEN p_partkey % 2 = 0 THEN {K} ELSE '' END AS ean, 'p' || {K} AS demo""")
    c, join = F.col, lambda v, name: F.array_join(v, "|").alias(name)
    return x.select(
        "p_partkey", P.nutriscore(c("n")).alias("nutriscore"), P.nutriscore_prefix(c("m")).alias("prefix"), P.halal_status(c("h")).alias("halal"), P.halal_inferred(c("labels"), c("i"), c("alcohol")).alias("inferred"),
        join(P.diet_tags(c("labels")), "diets"), join(P.allergens(c("tags")), "allergens"), join(P.additives(c("adds")), "additives"), P.clean_text(c("dirty"), 100).alias("clean"), P.clean_url(c("u")).alias("url"),
        P.clean_code(c("c")).alias("code"), join(P.codes_in(c("cs")), "codes"), P.first_brand(c("b")).alias("brand"), P.shelf_text(c("z"), c("pos")).alias("shelf"),
        P.canonical_id(F.lit(None).cast("string"), c("ean"), c("demo")).alias("canonical"), P.image(F.lit(""), F.array(F.lit("i.png")), c("ean")).alias("image"),
        P.first_entry(c("b"), [("zzz", "A / 1"), ("Acme", "B / 2"), ("Other", "C / 3")], "D / 1-2").alias("dictionary"),
    )


@query(
    """SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS admitted, p_partkey % 5 > 2 AS grocery FROM part"""
)
def records_admitted(spark, d):
    x = _rows(spark, d, "part", """p_partkey, '12345678' AS code, 'name' AS name, CASE WHEN p_partkey % 2 = 0 THEN array('en:kazakhstan') END AS countries, CASE WHEN p_partkey % 3 = 0 THEN ' имя ' ELSE ' и ' END AS ru,
      CASE p_partkey % 5 WHEN 0 THEN 'GiftCo' ELSE 'Acme' END AS brand, CASE p_partkey % 5 WHEN 1 THEN 'Box 30 х 40' WHEN 2 THEN 'Toy 15 СМ' ELSE 'Bar 100 g' END AS title""")
    none = F.lit(None).cast("string")
    return x.select("p_partkey", P.admitted(F.col("code"), F.col("name"), F.col("countries"), F.col("ru"), none, F.col("brand"), ["other"], F.lit(True)).alias("admitted"),
        P.is_grocery(F.col("brand"), F.col("title"), ["giftco"], ["подар"]).alias("grocery"))


@query(
    f"""WITH {PRODUCTS} SELECT ean, CASE ean % 5 WHEN 0 THEN 80 WHEN 1 THEN 50 WHEN 2 THEN 40 WHEN 3 THEN 20 ELSE 0 END + 10 + 2 AS query_points, CASE WHEN ean % 5 = 4 THEN 5 + 3 ELSE 0 END
    + CASE WHEN ean % 5 IN (0, 1, 3, 4) THEN 10 ELSE 0 END + CASE WHEN ean % 5 < 3 THEN 15 ELSE 0 END + 3 + 5 AS registry_points, CASE WHEN ean % 5 = 3 THEN 0 WHEN ean % 5 = 4 THEN 6 ELSE 21 END AS food_points FROM products"""
)
def candidate_scores(spark, d):
    e = F.col("ean")
    wanted = F.when(e % 5 == 4, "").otherwise("acme")
    brand = F.when(e % 5 == 0, "Acme").when(e % 5 == 1, "Acme Foods").when(e % 5 == 2, "acm").otherwise("zzz")
    name = F.when(e % 5 == 2, "Milk bar").when(e % 5 == 4, "Milk bar").otherwise("Milk Acme")
    words, food = F.array(F.lit("milk"), F.lit("of")), F.lit(True)
    own = F.lit("milk of")
    maker = F.when(e % 5 < 3, brand)
    x = plans.products(spark, d)
    return x.select(
        "ean", matching.query_score(words, name, brand, wanted, F.lit(2)).alias("query_points"),
        (matching.registry_score(words, name, wanted, maker, F.lit("1"), e % 5 == 4, own)).alias("registry_points"), matching.food_score(words, name, brand, wanted, F.lit("1"), F.lit(False)).alias("food_points"),
    )


@query(
    """SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 5 = 0 THEN 'id' WHEN o_orderkey % 5 = 1 THEN 'code' WHEN o_orderkey % 5 = 2 THEN 'local' WHEN o_orderkey % 5 = 3 THEN 'demo' WHEN o_orderkey % 2 = 0 THEN 'cache' ELSE 'unknown' END AS source,
    CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 2 > 0 THEN 'Товар ' || o_orderkey ELSE 'held' END AS payload FROM orders"""
)
def references_hydrated(spark, d):
    x = _rows(spark, d, "orders", "o_orderkey AS ref_id, CASE WHEN o_orderkey % 5 = 0 THEN 'g' || CAST(o_orderkey AS VARCHAR) END AS product_id, CAST(o_orderkey AS VARCHAR) AS ean, 'held' AS payload")
    at = lambda n: x.filter(F.col("ref_id") % 5 == n)
    products = at(0).select(F.col("product_id").alias("id"), F.concat(F.lit("x"), "ean").alias("ean"), "payload").unionByName(at(1).select(F.concat(F.lit("g"), "ean").alias("id"), "ean", "payload"))
    out = catalog.hydrate(x, products, at(2).select("ean", "payload"), at(3).select("ean", "payload"), at(4).filter("ref_id % 2 = 0").select("ean", "payload"))
    return out.select("ref_id", "source", "payload")


@query(
    f"""WITH {PRODUCTS} SELECT ean, 15 + CASE WHEN quality > 40 THEN 15 ELSE 0 END + CASE WHEN is_active THEN 15 ELSE 0 END AS from_records, 15 + 15 + CASE WHEN quality > 40 THEN 15 ELSE 0 END + CASE WHEN is_active THEN 20 ELSE 0 END AS from_market,
    20 + 20 + CASE WHEN quality > 40 THEN 15 ELSE 0 END + CASE WHEN is_active THEN 20 ELSE 0 END AS from_seed FROM products"""
)
def quality_scorings(spark, d):
    yes, q, a = F.lit(True), F.col("quality") > 40, F.col("is_active")
    return plans.products(spark, d).select(
        "ean", matching.quality_score(matching.BARCODE_DB_POINTS, {"name": yes, "kcal": q, "allergens": a}).alias("from_records"),
        matching.quality_score(matching.MARKET_POINTS, {"name": yes, "brand": yes, "nutrition": q, "composition": a}).alias("from_market"), matching.quality_score(matching.SEED_POINTS, {"name": yes, "brand": yes, "nutrition": q, "ingredients": a}).alias("from_seed"),
    )


@query(
    f"""WITH {PRODUCTS} SELECT ean AS id, CASE WHEN ean % 5 = 0 THEN 'own' WHEN ean % 5 = 1 THEN 'a1' WHEN ean % 5 = 2 THEN 'b1' WHEN ean % 5 = 3 THEN 'a2' END AS ean,
    CASE WHEN ean % 5 = 0 THEN 'known' WHEN ean % 5 = 1 THEN 'a' WHEN ean % 5 = 2 THEN 'b' WHEN ean % 5 = 3 THEN 'unverified' ELSE 'none' END AS origin FROM products"""
)
def codes_acquired(spark, d):
    p = plans.products(spark, d).select(F.col("ean").alias("id"), F.when(F.col("ean") % 5 == 0, "own").otherwise("").alias("ean"))
    found = lambda n, source, place, code, ok: p.filter(F.col("id") % 5 == n).select("id", F.lit(source).alias("source"), F.lit(place).alias("place"), F.lit(code).alias("ean"), F.lit(ok).alias("verified"))
    rows = found(1, "a", 2, "a1", True).unionByName(found(1, "b", 1, "b9", True)).unionByName(found(2, "a", 6, "a9", True)).unionByName(found(2, "b", 1, "b1", True)).unionByName(found(3, "a", 1, "a2", False)).unionByName(found(4, "b", 4, "b4", True))
    return matching.acquire_codes(p, rows, {"a": 5, "b": 3})


@query(
    f"""WITH {PRODUCTS} SELECT ean AS pair_id, label, a, b, direction FROM (SELECT ean, 'quality' AS label, CAST(quality AS VARCHAR) AS a, CASE WHEN is_active THEN '1' END AS b, 'higher' AS direction FROM products
    UNION ALL SELECT ean, 'sugar', CASE WHEN ean % 2 = 0 THEN '5' END, NULL, 'lower' FROM products) WHERE a IS NOT NULL OR b IS NOT NULL"""
)
def pairs_compared(spark, d):
    x = plans.products(spark, d).select(F.col("ean").alias("pair_id"), "quality", F.when(F.col("is_active"), 1).alias("q2"), F.when(F.col("ean") % 2 == 0, 5).alias("s1"), F.lit(None).cast("int").alias("s2"))
    return matching.comparison(x, {"quality": ("quality", "q2", "higher"), "sugar": ("s1", "s2", "lower")})


@query(
    """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'danger' WHEN 1 THEN 'danger' WHEN 2 THEN 'danger' WHEN 3 THEN 'warning' WHEN 4 THEN 'danger' WHEN 5 THEN 'warning' WHEN 6 THEN 'safe' WHEN 7 THEN 'danger' WHEN 8 THEN 'danger' WHEN 9 THEN 'caution' WHEN 10 THEN 'caution' ELSE 'safe' END AS verdict,
    CASE p_partkey % 12 WHEN 0 THEN 'milk' WHEN 1 THEN 'milk' WHEN 2 THEN 'Dill' WHEN 3 THEN 'milk' WHEN 4 THEN '22.51' WHEN 5 THEN '22.5|none' WHEN 6 THEN '5.0|none' WHEN 7 THEN 'aspartame' WHEN 8 THEN 'milk|milk' WHEN 9 THEN 'no|none' WHEN 10 THEN 'vegan|none' ELSE 'none' END AS subjects FROM part"""
)
def fit_rules(spark, d):
    x = _rows(spark, d, "part", """p_partkey, 'Bar' AS name, CASE p_partkey % 12 WHEN 1 THEN 'cocoa, whole MILK' WHEN 2 THEN 'with dill' WHEN 7 THEN 'Aspartame' WHEN 8 THEN 'sugar. may contain traces of milk' ELSE 'water' END AS ingredients,
      CASE WHEN p_partkey % 12 = 0 THEN array('en:milk') END AS allergens, CASE WHEN p_partkey % 12 = 3 THEN array('milk') END AS traces, CASE WHEN p_partkey % 12 = 10 THEN array('contains_dairy') END AS diet_tags,
      CASE p_partkey % 12 WHEN 4 THEN CAST(22.51 AS DOUBLE) WHEN 5 THEN CAST(22.5 AS DOUBLE) WHEN 6 THEN CAST(5 AS DOUBLE) END AS sugar, CAST(NULL AS DOUBLE) AS protein, CAST(NULL AS DOUBLE) AS alcohol, CASE WHEN p_partkey % 12 = 9 THEN 'no' END AS halal_status,
      array('milk') AS user_allergens, CASE WHEN p_partkey % 12 = 2 THEN array('Dill') END AS custom_allergens, CASE WHEN p_partkey % 12 IN (4, 5, 6) THEN array('diabetes') WHEN p_partkey % 12 = 7 THEN array('pku') END AS conditions,
      CASE WHEN p_partkey % 12 = 10 THEN array('vegan') END AS diets, p_partkey % 12 = 9 AS halal_only, false AS halal_strict""")
    out = fitcheck.check_fit(x)
    return out.select("p_partkey", "verdict", F.array_join(F.transform("reasons", lambda r: r["subject"]), "|").alias("subjects"))


# Search


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS s
    FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, place, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM p) WHERE place <= 10"""
)
def nearest_to_each(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest_to_each(v, v.filter("vec_id % 50 = 0"), 10).withColumn("similarity", F.round("similarity", 6))
