"""Feeds that mix records of several shapes in one column of JSON or VARIANT, read as entities in one pass.

The shape of each record is told by its fields, the first that matches wins; its values are then read with
try_variant_get, so that a field of an unexpected kind is missing instead of an error.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.products import nutrition
from shelfwise.functions.text import truthy_or
from shelfwise.operators.entities import DEFAULT_CATEGORY, ENTITY, cache_values, completed, demo_values, global_values, manufacturer, payload_values, specs

# Fields by which shapes are told.
CANONICAL_FIELDS = ["halalStatus", "nutritionPer100", "sourceMeta", "qualityScore"]
CACHE_FIELDS = ["normalized_name", "normalized_nutriments_json"]
PAYLOAD_FIELDS = ["product_name", "nutriments", "allergens_tags"]
GLOBAL_FIELDS = ["ingredients_raw", "halal_status", "nutriments_json"]

#: All that a row of a feed can be. Only rows of the first six shapes are entities.
SHAPES = ["entity", "demo", "cache", "payload", "global", "other", "empty", "damaged"]


def field(record: Column, path: str, kind: str = "variant") -> Column:
    """A field of a variant, null where it is missing or can't be that kind. Objects and lists as a string are JSON."""
    return F.try_variant_get(record, f"$.{path}", kind)


def is_truthy(x: Column) -> Column:
    """Whether a variant is there and neither null, false, zero nor an empty string; lists and objects always are."""
    text = F.try_variant_get(x, "$", "string")
    falsy = lambda kind: F.when(kind == "VOID", True).when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").otherwise(F.try_variant_get(x, "$", "double") == 0)
    # the kind of a record names all its fields, so it is looked up once
    told = F.get(F.transform(F.array(F.schema_of_variant(x)), falsy), F.lit(0))
    return F.when(x.isNull(), False).otherwise(~F.coalesce(told, F.lit(False)))


def shape(record: Column) -> Column:
    """The shape of a variant that was read: all of SHAPES but damaged."""
    has = lambda *names: reduce(or_, [is_truthy(field(record, n)) for n in names])
    known = lambda *names: reduce(or_, [field(record, n).isNotNull() for n in names])
    return (
        F.when(~is_truthy(record), "empty")
        .when(has("canonicalId") & has("sourceMeta"), "entity")
        .when(has("ean") & known(*CANONICAL_FIELDS), "entity")
        .when(has("id") & F.startswith(field(record, "id", "string"), F.lit("p")), "demo")
        .when(has(*CACHE_FIELDS), "cache")
        .when(has(*PAYLOAD_FIELDS), "payload")
        .when(has(*GLOBAL_FIELDS), "global")
        .otherwise("other")
    )


def _first_number(c, *names: str) -> Column:
    """The first number that is there."""
    return F.coalesce(*[c(n, "double") for n in names])


def canonical_values(c) -> dict[str, Column]:
    """Values of the entity columns of records that are entities already, in camel case; older names come second."""
    blank = lambda *names: F.coalesce(*[F.nullif(c(n), F.lit("")) for n in names])
    tags = lambda *names: F.coalesce(*[c(n, "array<string>") for n in names])
    flag = lambda n: is_truthy(c(f"sourceMeta.{n}", "variant"))
    per_100 = F.coalesce(*[F.when(is_truthy(c(n, "variant")), c(n, "map<string,string>")) for n in ("nutritionPer100", "nutrition")])
    return {
        "source": truthy_or(c("source"), F.lit("unknown")), "id": blank("id"), "demo_id": blank("demoId"), "ean": blank("ean"), "alternate_eans": tags("alternateEans", "alternate_eans"),
        "name": F.coalesce(c("name"), F.lit("")), "name_kz": blank("nameKz", "name_kz"), "category": truthy_or(c("category"), F.lit(DEFAULT_CATEGORY)),
        **{n: blank(n) for n in ("brand", "subcategory", "quantity", "group", "image", "description", "ingredients", "shelf")}, "images": F.filter(tags("images"), lambda x: x != ""),
        "ingredients_kz": blank("ingredientsKz", "ingredients_kz"), "allergens": tags("allergens"), "diet_tags": tags("dietTags"), "tags": tags("tags"), "traces": tags("traces"),
        "additives_tags": tags("additivesTags", "additives_tags"), "categories_tags": tags("categoriesTags", "categories_tags"),
        "halal_status": F.coalesce(c("halalStatus"), c("halal")), "nutrition": nutrition(per_100), "nova_group": _first_number(c, "novaGroup", "nova_group").cast("int"),
        "manufacturer": manufacturer(c("manufacturer"), c("country")), "specs": specs(c("specs")), "price": c("priceKzt", "double"), "stock_status": blank("stockStatus"),
        "nutriscore": c("nutriscore"), "quality": _first_number(c, "qualityScore", "sourceMeta.qualityScore"), "external_source": blank("sourceMeta.externalSource"),
        "is_verified": flag("isVerified"), "needs_review": flag("needsReview"), "is_enriched": flag("aiEnriched"), "updated_at": blank("sourceMeta.lastUpdatedAt"),
    }


READERS = {"entity": canonical_values, "demo": demo_values, "cache": cache_values, "payload": payload_values, "global": global_values, "other": canonical_values}


def with_shape(feed: DataFrame, record: str, shape_as: str = "shape", variant_as: str = "variant") -> DataFrame:
    """feed with its records as variants and the shape of each.

    record: a column of JSON texts or of variants. A text that is no JSON is damaged, its variant null; a null text,
    and JSON null, false, 0 or "", are empty. Columns of the given names are replaced.
    """
    if feed.schema[record].dataType.typeName() == "variant":
        out = feed.withColumn(variant_as, F.col(record))
        return out.withColumn(shape_as, F.when(F.col(variant_as).isNull(), "empty").otherwise(shape(F.col(variant_as))))
    out = feed.withColumn(variant_as, F.try_parse_json(record))
    broken = F.col(record).isNotNull() & F.col(variant_as).isNull()
    return out.withColumn(shape_as, F.when(F.col(record).isNull(), "empty").when(broken, "damaged").otherwise(shape(F.col(variant_as))))


def entities_of(feed: DataFrame, record: str, keep: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """Entities of a mixed feed, each row once and in one pass: keep, shape, and the entity's columns (or some of them).

    Rows that are empty or damaged stay, with their shape and nulls for all else, so that they can be counted and
    looked into; no kind of record raises. Nothing is shuffled.
    """
    if {"shape", *ENTITY} & set(keep):
        raise ValueError("columns kept may not be named as those of an entity, or shape")
    variant = "_" * (1 + max(map(len, feed.columns))) + "v"
    rows = with_shape(feed, record, "shape", variant)
    read = lambda name, kind="string": field(F.col(variant), name, kind)
    full = {s: completed(values(read)) for s, values in READERS.items()}
    out = []
    for c in columns or list(ENTITY):
        one = F.lit(None)
        for s in reversed(READERS):
            if s != "other":
                one = F.when(F.col("shape").isin("entity", "other") if s == "entity" else F.col("shape") == s, full[s][c]).otherwise(one)
        out.append(one.cast(ENTITY[c]).alias(c))
    return rows.select(*keep, "shape", *out)
