"""Queries of text and number readers over whole tables, and their SQL; fixed values are typed out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog_queries import query
from shelfwise.functions import products as P
from shelfwise.functions import text as X
from shelfwise.operators import catalog, fitcheck, matching
from shelfwise.sources import read_table

PRINTED = "concat(CASE WHEN p_size % 3 = 0 THEN 'ca. ' WHEN p_size % 3 = 1 THEN ' -' ELSE '' END, p_size, CASE p_partkey % 5 WHEN 0 THEN ',5 g' WHEN 1 THEN '.25' WHEN 2 THEN ' 000 kcal' WHEN 3 THEN 'e2' ELSE ' g, 1.5' END)"
NUMBER = r"'^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)'"


@query(
    f"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(x, {NUMBER}, 1), '') AS DOUBLE) AS leading_part, TRY_CAST(nullif(regexp_extract(replace(x, ',', '.'), {NUMBER}, 1), '') AS DOUBLE) AS with_comma,
    nullif(TRY_CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS scraped FROM (SELECT p_partkey, {PRINTED} AS x FROM part)"""
)
def numbers_read(spark, d):
    x = F.col("x")
    rows = read_table(spark, d, "part").selectExpr("p_partkey", f"{PRINTED} AS x")
    return rows.select("p_partkey", X.leading_number(x).alias("leading_part"), X.decimal_number(x).alias("with_comma"), X.scraped_number(x).alias("scraped"))


MARKED = "concat(text, CASE doc_id % 6 WHEN 0 THEN ' қ' WHEN 1 THEN ' Ж' WHEN 2 THEN ' Ң ё' WHEN 3 THEN ' Ё' WHEN 4 THEN ' І' ELSE '' END)"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(x, '[әғқңөұүһіӘҒҚҢӨҰҮҺІ]') THEN 'kz' WHEN regexp_matches(x, '[а-яёА-ЯЁ]') THEN 'ru' ELSE 'en' END AS language FROM (SELECT doc_id, {MARKED} AS x FROM documents)")
def languages(spark, d):
    return read_table(spark, d, "documents").selectExpr("doc_id", f"{MARKED} AS x").select("doc_id", X.language(F.col("x")).alias("language"))


# Words of the shops' names between the words of the texts, so that the stop words are met.
MIXED = "concat('Шоколад из The ', text, ' и плитка для Чая в 5 г а батончик OF')"


@query(
    f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[''`´]', '', 'g'),
      '[^a-zа-яё0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'with', 'in', 'of', 'for', 'from', 'на', 'в', 'с', 'из', 'для', 'и', 'г', 'мл', 'шт', 'шоколадная', 'шоколадный',
      'шоколад', 'плитка', 'батончик', 'порционный')) AS t FROM (SELECT doc_id, {MIXED} AS x FROM documents))"""
)
def stop_words_dropped(spark, d):
    rows = read_table(spark, d, "documents").selectExpr("doc_id", f"{MIXED} AS x").withColumn("t", X.tokens(F.col("x"), matching.STOP_WORDS))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    """SELECT l_orderkey AS item, candidate, score FROM (SELECT l_orderkey, l_partkey AS candidate, CAST(l_quantity * 2 + l_linenumber % 2 AS DOUBLE) AS score FROM lineitem) WHERE score >= 60
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, candidate) = 1"""
)
def best_candidates(spark, d):
    scored = read_table(spark, d, "lineitem").selectExpr("l_orderkey AS item", "l_partkey AS candidate", "CAST(l_quantity * 2 + l_linenumber % 2 AS DOUBLE) AS score")
    return matching.best_candidate(scored, "item", "candidate", 60.0)


@query("SELECT doc_id, substr(concat_ws(' ', substr(text, 1, 200), source || ' ' || lang, 'milk ' || lang), 1, 500) AS asked FROM documents")
def retrieval_texts(spark, d):
    return read_table(spark, d, "documents").select("doc_id", P.query_text(F.col("text"), F.array("source", "lang"), F.array(F.lit("milk"), F.col("lang"))).alias("asked"))


LABELS = "CASE p_partkey % 5 WHEN 0 THEN 'en:HALAL,bio' WHEN 1 THEN 'Contains Pork' WHEN 2 THEN 'bio,Alcohol 5%' WHEN 3 THEN 'halal,pork' ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN contains(lower(x), 'halal') THEN true WHEN contains(lower(x), 'pork') OR contains(lower(x), 'alcohol') THEN false END AS halal FROM (SELECT p_partkey, {LABELS} AS x FROM part)")
def labels_halal(spark, d):
    return read_table(spark, d, "part").selectExpr("p_partkey", f"split({LABELS}, ',') AS x").select("p_partkey", fitcheck.halal_from_labels(F.col("x")).alias("halal"))


NAME = "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 17 <> 0 THEN p_name END AS name"
ERROR = "CASE WHEN p_partkey % 11 = 0 THEN 'no_data' WHEN p_partkey % 13 = 0 THEN '' END AS error"


@query(f"SELECT p_partkey, name FROM (SELECT p_partkey, {NAME}, {ERROR} FROM part) WHERE name <> '' AND coalesce(error, '') = ''")
def rows_without_errors(spark, d):
    return catalog.without_errors(read_table(spark, d, "part").selectExpr("p_partkey", NAME, ERROR)).select("p_partkey", "name")
