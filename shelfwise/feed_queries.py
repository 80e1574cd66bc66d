"""Queries of mixed feeds and of the additive knowledge base over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shelfwise.catalog_queries import query
from shelfwise.entity_queries import CACHE, DEMO, GLOBAL, PAYLOAD, K, _rows
from shelfwise.operators import additives, feeds
from shelfwise.sources import read_table

CANONICAL = f"""'c' || {K} AS canonicalId, named_struct('externalSource', p_brand, 'qualityScore', p_size, 'isVerified', p_partkey % 2 = 0) AS sourceMeta, lpad({K}, 8, '0') AS ean, p_name AS name,
  p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'YES' ELSE 'x' END AS halalStatus, split(p_type, ' ') AS tags, p_retailprice AS priceKzt"""


def _feed(spark, d):
    """Each product in each of the shapes, as JSON, beside records of no shape, without content and cut off."""
    # a file of parts is small for the work its records are, so its parts are dealt first
    rows = lambda columns: _rows(spark, d, "part", columns, "p_partkey")
    payload = rows(PAYLOAD).withColumns({"allergens_tags": F.split("tags", ","), "labels_tags": F.split("labels", ","), "additives_tags": F.split("additives", ",")})
    shaped = [rows(c) for c in (GLOBAL, CACHE, DEMO, CANONICAL)] + [payload.drop("tags", "labels", "additives")]
    lines = [df.select(F.to_json(F.struct("*")).alias("record")) for df in shaped]
    lines.append(rows(f"""CASE p_partkey % 4 WHEN 0 THEN '{{"ean":"' || {K} WHEN 1 THEN '{{"price":' || {K} || '}}' WHEN 2 THEN 'null' END AS record"""))
    return reduce(lambda a, b: a.unionByName(b), lines)


EAN = f"lpad({K}, 8, '0')"
IMAGE = f"'/products/' || {EAN} || '.png'"


@query(
    f"""SELECT 'global' AS shape, 'global' AS source, {EAN} AS ean, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'grocery' ELSE p_type END AS category, CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS halal_status,
      CASE WHEN p_partkey % 8 < 5 THEN upper(substr('abcde', CAST(p_partkey % 8 + 1 AS INT), 1)) END AS nutriscore, CASE WHEN p_partkey % 4 = 0 THEN 'i' || {K} || '.png' WHEN p_partkey % 3 = 0 THEN 'a.png' WHEN p_partkey % 3 = 1 THEN 'no json' ELSE {IMAGE} END AS image,
      CAST(p_size AS DOUBLE) AS kcal, CASE p_partkey % 3 WHEN 0 THEN 'milk|soy' WHEN 1 THEN 'fish|eggs' ELSE '' END AS allergens, NULL AS tags, NULL AS price, CASE WHEN p_partkey % 7 = 0 THEN 'ai_enriched' ELSE 'x' END AS external_source, false AS is_verified FROM part
    UNION ALL SELECT 'cache', 'cache', {EAN}, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Товар ' || {EAN} END, NULL, 'unknown', NULL, CASE WHEN p_partkey % 3 = 0 THEN 'u.png' ELSE {IMAGE} END, NULL, '', NULL, NULL,
      CASE WHEN p_partkey % 4 = 0 THEN 'fatsecret' ELSE 'openfoodfacts' END, false FROM part
    UNION ALL SELECT 'demo', 'demo', {EAN}, p_name, 'grocery', CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'unknown' END, NULL, {IMAGE}, NULL, '', NULL, NULL, NULL, false FROM part
    UNION ALL SELECT 'entity', 'unknown', {EAN}, p_name, 'grocery', CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'unknown' END, NULL, {IMAGE}, NULL, '', replace(p_type, ' ', '|'), p_retailprice, p_brand, p_partkey % 2 = 0 FROM part
    UNION ALL SELECT 'payload', 'off', {EAN}, CASE WHEN p_partkey % 3 = 0 THEN 'Товар ' || {EAN} ELSE p_name END, NULL, CASE WHEN p_partkey % 3 = 1 THEN 'yes' ELSE 'unknown' END, 'C', {IMAGE}, NULL, CASE WHEN p_partkey % 2 = 0 THEN 'milk|gluten|shellfish' ELSE '' END, NULL, NULL, 'openfoodfacts', false FROM part
    UNION ALL SELECT CASE p_partkey % 4 WHEN 0 THEN 'damaged' ELSE 'empty' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 4 <> 1
    UNION ALL SELECT 'other', 'unknown', NULL, '', 'grocery', 'unknown', NULL, NULL, NULL, '', NULL, NULL, NULL, false FROM part WHERE p_partkey % 4 = 1"""
)
def feed_entities(spark, d):
    columns = ["source", "ean", "name", "category", "halal_status", "nutriscore", "image", "nutrition", "allergens", "tags", "price", "external_source", "is_verified"]
    e = feeds.entities_of(_feed(spark, d), "record", columns=columns)
    plain = [c for c in columns if c not in ("nutrition", "allergens", "tags")]
    return e.select("shape", *plain, "nutrition.kcal", F.array_join("allergens", "|").alias("allergens"), F.nullif(F.array_join("tags", "|"), F.lit("")).alias("tags"))


HALAL = "CASE p_size % 5 WHEN 0 THEN 'НЕТ' WHEN 1 THEN 'сомнительно (' || p_type || ')' WHEN 2 THEN 'да' WHEN 3 THEN 'да (' || p_type || '), НЕТ (' || p_brand || ')' ELSE 'как E' || CAST(100 + p_partkey * 7 % 900 AS VARCHAR) END"
VEGAN = "CASE WHEN p_size % 3 = 0 THEN 'НЕТ' ELSE 'да' END"
ALLERGEN = "CASE WHEN p_size % 7 = 0 THEN 'да (' || p_type || ')' ELSE 'нет' END"
PAGE = f"""lpad({K}, 10, '0') AS source_file, '# ' || p_brand || chr(10) || chr(10) || '### E' || CAST(100 + p_partkey % 900 AS VARCHAR) || ' — ' || p_name || chr(10) || chr(10) || '- **Происхождение:** ' || p_type || chr(10) || '- **Халал:** ' || {HALAL}
  || chr(10) || '- **Аллерген:** ' || {ALLERGEN} || chr(10) || '- **Веган:** ' || {VEGAN} || chr(10) || chr(10) || '### ' || p_brand || chr(10) AS content"""
DIM = f"""own AS (SELECT 'E' || CAST(100 + p_partkey % 900 AS VARCHAR) AS code, p_name AS name, p_type AS origin, {HALAL} AS halal, {ALLERGEN} AS allergen, {VEGAN} AS vegan, p_size % 5 AS h FROM part
      QUALIFY row_number() OVER (PARTITION BY p_partkey % 900 ORDER BY p_partkey) = 1),
    dim AS (SELECT a.*, CASE WHEN a.h = 4 THEN CASE b.h WHEN 0 THEN 'forbidden' WHEN 2 THEN 'allowed' ELSE 'doubtful' END WHEN a.h = 0 THEN 'forbidden' WHEN a.h = 2 THEN 'allowed' ELSE 'doubtful' END AS verdict
      FROM own a LEFT JOIN own b ON a.h = 4 AND b.code = substr(a.halal, 5))"""


@query(f"WITH {DIM} SELECT code, name, origin, halal, allergen, vegan, verdict FROM dim")
def additive_sections(spark, d):
    return additives.sections(_rows(spark, d, "part", PAGE)).drop("note")


INGREDIENTS = """text || ', E' || CAST(100 + doc_id * 13 % 950 AS VARCHAR) || '; е-' || CAST(100 + doc_id * 31 % 950 AS VARCHAR) || CASE doc_id % 9 WHEN 0 THEN ' растительный, E471 растительный' WHEN 1 THEN ', Pork fat 3 %' WHEN 2 THEN ', E 471' WHEN 3 THEN ', желатин, E631' WHEN 4 THEN ', E1999, E631 (синтетический)' ELSE '' END AS ingredients"""
STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'yes' WHEN doc_id % 13 = 0 THEN 'no' WHEN doc_id % 2 = 0 THEN 'unknown' END AS status"



@query(
    rf"""WITH {DIM}, items AS (SELECT doc_id, unnest(t) AS item, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_split_to_array(lower(ingredients), '[,;\r\n]') AS t FROM (SELECT doc_id, {INGREDIENTS} FROM documents))),
    words AS (SELECT doc_id, pos, regexp_replace(' ' || trim(regexp_replace(item, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ', ' [eе] ?([0-9]{{3,4}}[a-i]?) ', ' e\1 ', 'g') AS w FROM items),
    terms AS (SELECT unnest(['свиной жир', 'lard', 'pork fat', 'свинина', 'алкоголь', 'ethanol', 'ethyl alcohol', 'спирт этиловый', 'кармин', 'cochineal', 'шеллак', 'shellac']) AS term, 'forbidden' AS kind UNION ALL SELECT unnest(['желатин', 'gelatin']), 'doubtful'),
    codes AS (SELECT DISTINCT doc_id, pos, w, upper(substr(c, 1, 1)) || substr(c, 2) AS code FROM (SELECT doc_id, pos, w, unnest(string_split(w, ' ')) AS c FROM words) WHERE regexp_matches(c, '^e[0-9]{{3,4}}[a-i]?$')),
    finds AS (SELECT doc_id, pos, term AS found, kind, NULL AS allergen, NULL AS vegan, NULL AS code FROM words JOIN terms ON contains(w, ' ' || term || ' ') WHERE NOT (kind = 'doubtful' AND (contains(w, 'растительн') OR contains(w, 'халял')))
      UNION ALL SELECT doc_id, pos, codes.code, CASE WHEN codes.code IN ('E120', 'E904') THEN 'forbidden' WHEN codes.code IN ('E481', 'E482', 'E483') THEN 'doubtful'
        WHEN codes.code IN ('E471', 'E472a', 'E472b', 'E472c', 'E472d', 'E472e', 'E470a', 'E422', 'E322') THEN CASE WHEN contains(w, 'растительн') OR contains(w, 'халял') THEN 'allowed' ELSE 'doubtful' END
        WHEN codes.code = 'E631' THEN CASE WHEN contains(w, 'синтетич') THEN 'allowed' ELSE 'doubtful' END ELSE coalesce(verdict, 'unknown') END, allergen, vegan, codes.code FROM codes LEFT JOIN dim USING (code)),
    g AS (SELECT doc_id, arg_min(found, (kind <> 'forbidden', pos, found)) FILTER (kind IN ('forbidden', 'doubtful')) AS worst, bool_or(kind = 'forbidden') AS bad, count(DISTINCT code) AS n_codes,
      array_to_string(list_sort(list(DISTINCT code) FILTER (kind = 'unknown')), ',') AS unknown_codes, array_to_string(list_sort(list(DISTINCT code) FILTER (starts_with(lower(vegan), 'нет'))), ',') AS not_vegan,
      array_to_string(list_sort(list(DISTINCT code) FILTER (starts_with(lower(allergen), 'да'))), ',') AS allergens FROM finds GROUP BY doc_id)
    SELECT doc_id, CASE WHEN status = 'yes' THEN 'halal' WHEN status = 'no' OR bad THEN 'not_halal' WHEN worst IS NOT NULL THEN 'doubtful' ELSE 'probable' END AS decision,
      CASE status WHEN 'yes' THEN 'certificate' WHEN 'no' THEN 'status' ELSE coalesce(worst, 'ingredients') END AS basis, coalesce(n_codes, 0) AS n_codes, coalesce(unknown_codes, '') AS unknown_codes, coalesce(not_vegan, '') AS not_vegan, coalesce(allergens, '') AS allergens
    FROM (SELECT doc_id, {STATUS} FROM documents) LEFT JOIN g USING (doc_id)"""
)
def additive_decisions(spark, d):
    rows = _rows(spark, d, "documents", f"doc_id, {INGREDIENTS}, {STATUS}")
    return additives.halal_decisions(rows, "doc_id", "ingredients", "status", additives.sections(_rows(spark, d, "part", PAGE)))
