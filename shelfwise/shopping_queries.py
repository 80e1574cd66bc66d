"""Queries of allergen maps and of the check of outside products, and their SQL; fixed values are typed out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog_queries import query
from shelfwise.functions import products as P
from shelfwise.operators import fitcheck
from shelfwise.sources import read_table

# Both sides read the same derived columns: tags, words and shoppers that follow from a product's key.
TAGS = (
    "en:milk en:gluten en:nuts en:peanuts en:soybeans en:soy en:eggs en:fish en:crustaceans en:shellfish en:wheat en:sesame en:sesame-seeds en:celery en:mustard en:lupin en:molluscs "
    "en:sulphur-dioxide-and-sulphites en:unknown"
)
TAGGED = f"(SELECT p_partkey, string_split('{TAGS}', ' ') AS t, p_partkey * 7 % 19 AS a, p_partkey * 11 // 3 % 19 AS b, p_size % 19 AS c FROM part)"


def _mapped(pairs: str) -> str:
    table = "MAP {" + ", ".join("'{}': '{}'".format(*x.split("=")) for x in pairs.split()) + "}"
    return f"array_to_string(list_filter([m1, CASE WHEN m2 IS DISTINCT FROM m1 THEN m2 END, CASE WHEN m3 IS DISTINCT FROM m1 AND m3 IS DISTINCT FROM m2 THEN m3 END], lambda x: x IS NOT NULL), ',')".replace("m1", f"({table})[t1]").replace("m2", f"({table})[t2]").replace("m3", f"({table})[t3]")


SCREEN_MAP = (
    "en:milk=milk en:gluten=gluten en:nuts=tree_nuts en:peanuts=peanuts en:soybeans=soy en:eggs=eggs en:fish=fish en:crustaceans=crustaceans en:molluscs=mollusks en:wheat=gluten "
    "en:sesame-seeds=sesame en:celery=celery en:mustard=mustard en:lupin=lupin en:sulphur-dioxide-and-sulphites=sulfites"
)
IMPORT_MAP = (
    "en:milk=milk en:gluten=gluten en:nuts=nuts en:peanuts=peanuts en:soybeans=soy en:soy=soy en:eggs=eggs en:fish=fish en:crustaceans=shellfish en:shellfish=shellfish en:wheat=gluten "
    "en:sesame=sesame en:celery=celery en:mustard=mustard en:lupin=lupin en:molluscs=molluscs en:sulphur-dioxide-and-sulphites=sulphites"
)
SEED_MAP = (
    "en:milk=milk en:gluten=gluten en:nuts=nuts en:peanuts=peanuts en:soybeans=soy en:eggs=eggs en:fish=fish en:crustaceans=shellfish en:wheat=gluten en:sesame=sesame en:celery=celery "
    "en:mustard=mustard"
)


@query(
    f"""SELECT p_partkey, {_mapped(SCREEN_MAP)} AS on_screen, {_mapped(IMPORT_MAP)} AS imported, {_mapped(SEED_MAP)} AS seeded
    FROM (SELECT p_partkey, t[a + 1] AS t1, t[b + 1] AS t2, t[c + 1] AS t3 FROM {TAGGED})"""
)
def allergens_mapped(spark, d):
    x = read_table(spark, d, "part").select("p_partkey", F.split(F.lit(TAGS), " ").alias("t"), F.expr("array(p_partkey * 7 % 19, p_partkey * 11 div 3 % 19, p_size % 19)").alias("at"))
    tags = F.transform("at", lambda i: F.get("t", i.cast("int")))
    joined = lambda known: F.array_join(P.allergens(tags, known), ",")
    return x.select("p_partkey", joined(P.ALLERGEN_TAGS).alias("on_screen"), joined(P.IMPORT_ALLERGEN_TAGS).alias("imported"), joined(P.SEED_ALLERGEN_TAGS).alias("seeded"))


WORDS = "Вода Сахар Sugar sucre zucker Глюкоза фруктоза сироп Молоко сливки сметана сыр milk cream butter cheese whey casein лактоза пшеница wheat gluten ячмень рожь говядина свинина курица мясо beef pork chicken meat gelatin syrup barley salt"
SHOPPERS = """SELECT p_partkey, p_name || ', ' || w[p_partkey % 36 + 1] || ', ' || w[p_size % 36 + 1] AS ingredients,
  CASE p_partkey % 5 WHEN 0 THEN ['milk', 'soy'] WHEN 1 THEN ['wheat'] WHEN 2 THEN ['eggs', 'gluten'] WHEN 3 THEN CAST([] AS VARCHAR[]) END AS allergens,
  CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS halal, p_size % 2 = 0 AS halal_only,
  CASE p_size % 3 WHEN 0 THEN ['soy', 'eggs'] WHEN 1 THEN ['wheat'] END AS user_allergens, CASE p_partkey % 7 WHEN 0 THEN ['SALT', p_name[1:3]] END AS custom_allergens,
  CASE p_partkey % 6 WHEN 0 THEN ['sugar_free'] WHEN 1 THEN ['dairy_free', 'vegan'] WHEN 2 THEN ['gluten_free'] WHEN 3 THEN ['vegan', 'sugar_free', 'dairy_free', 'gluten_free'] WHEN 4 THEN ['dairy_free'] END AS diets
  FROM part, (SELECT string_split('""" + WORDS + """', ' ') AS w)"""


@query(
    f"""WITH s AS ({SHOPPERS}), v AS (SELECT p_partkey, halal_only, halal, lower(ingredients) AS i, coalesce(allergens, CAST([] AS VARCHAR[])) AS a, coalesce(user_allergens, CAST([] AS VARCHAR[])) AS u, coalesce(custom_allergens, CAST([] AS VARCHAR[])) AS c,
      coalesce(diets, CAST([] AS VARCHAR[])) AS g FROM s),
    f AS (SELECT *, list_concat(CASE WHEN halal_only AND NOT coalesce(halal, true) THEN ['halal'] ELSE [] END, list_filter(a, lambda x: list_contains(u, x)), list_filter(c, lambda x: contains(i, lower(x))),
      CASE WHEN list_contains(g, 'sugar_free') AND regexp_matches(i, 'сахар|sugar|sucre|zucker|глюкоз|фруктоз|сироп') THEN ['sugar_free'] ELSE [] END,
      CASE WHEN list_contains(g, 'dairy_free') AND (list_contains(a, 'milk') OR regexp_matches(i, 'молок|сливк|масло слив|сметан|сыр|milk|cream|butter|cheese|whey|casein|лактоз')) THEN ['dairy_free'] ELSE [] END,
      CASE WHEN list_contains(g, 'gluten_free') AND (list_contains(a, 'gluten') OR list_contains(a, 'wheat') OR regexp_matches(i, 'пшениц|wheat|gluten|ячмен|рожь')) THEN ['gluten_free'] ELSE [] END,
      CASE WHEN list_contains(g, 'vegan') AND (list_contains(a, 'milk') OR list_contains(a, 'eggs') OR regexp_matches(i, 'говядин|свинин|курин|мясо|beef|pork|chicken|meat')) THEN ['vegan'] ELSE [] END) AS f FROM v),
    p AS (SELECT *, list_concat(CASE WHEN halal_only AND halal THEN ['halal_confirmed'] ELSE [] END, CASE WHEN len(u) > 0 AND len(a) = 0 THEN ['no_allergens'] ELSE [] END) AS good FROM f)
    SELECT p_partkey, array_to_string(f[1:3], ',') AS fails, len(f) = 0 AS fits,
      array_to_string(list_concat(CASE WHEN halal_only AND halal IS NULL THEN ['halal_unknown'] ELSE [] END, CASE WHEN len(f) > 0 THEN f WHEN len(good) > 0 THEN good ELSE ['matches_preferences'] END)[1:3], ',') AS shown FROM p"""
)
def external_checked(spark, d):
    x = read_table(spark, d, "part").withColumn("w", F.split(F.lit(WORDS), " "))
    x = x.selectExpr(
        "p_partkey", "concat(p_name, ', ', w[cast(p_partkey % 36 as int)], ', ', w[p_size % 36]) AS ingredients",
        "CASE p_partkey % 5 WHEN 0 THEN array('milk', 'soy') WHEN 1 THEN array('wheat') WHEN 2 THEN array('eggs', 'gluten') WHEN 3 THEN cast(array() AS array<string>) END AS allergens",
        "CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS halal", "p_size % 2 = 0 AS halal_only",
        "CASE p_size % 3 WHEN 0 THEN array('soy', 'eggs') WHEN 1 THEN array('wheat') END AS user_allergens", "CASE p_partkey % 7 WHEN 0 THEN array('SALT', substr(p_name, 1, 3)) END AS custom_allergens",
        "CASE p_partkey % 6 WHEN 0 THEN array('sugar_free') WHEN 1 THEN array('dairy_free', 'vegan') WHEN 2 THEN array('gluten_free') WHEN 3 THEN array('vegan', 'sugar_free', 'dairy_free', 'gluten_free') WHEN 4 THEN array('dairy_free') END AS diets",
    )
    return fitcheck.check_external(x).select("p_partkey", F.array_join("fails", ",").alias("fails"), "fits", F.array_join("shown", ",").alias("shown"))
