"""Product records of differing sources as one kind of row, the entity that other operators read.

A source may lack any of its columns: what is missing counts as null. Blank texts count as missing where a column
says "or"; zero counts as a value there unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.products import halal_status, image, nova_group, nutriscore, nutrition, shelf_text
from shelfwise.functions.text import string_array, truthy_or

# Allergen tags of the open product database, its diet labels, defaults, and the placeholder of a name.
PAYLOAD_ALLERGENS = {
    "en:milk": "milk", "en:gluten": "gluten", "en:nuts": "nuts", "en:peanuts": "peanuts", "en:soybeans": "soy", "en:soy": "soy", "en:eggs": "eggs",
    "en:fish": "fish", "en:crustaceans": "shellfish", "en:shellfish": "shellfish", "en:wheat": "gluten",
}
PAYLOAD_DIETS = {"vegan": "vegan", "vegetarian": "vegetarian", "halal": "halal", "gluten.free": "gluten_free"}
DEFAULT_CATEGORY = "grocery"
PLACEHOLDER = "Товар "

#: Columns of an entity and their types.
ENTITY = {
    "source": "string", "id": "string", "demo_id": "string", "ean": "string", "alternate_eans": "array<string>", "name": "string", "name_kz": "string", "brand": "string",
    "category": "string", "subcategory": "string", "quantity": "string", "group": "string", "image": "string", "images": "array<string>", "description": "string",
    "ingredients": "string", "ingredients_kz": "string", "allergens": "array<string>", "diet_tags": "array<string>", "tags": "array<string>",
    "additives_tags": "array<string>", "traces": "array<string>", "categories_tags": "array<string>", "halal_status": "string",
    "nutrition": "struct<kcal:double,protein:double,fat:double,carbs:double,sugar:double,fiber:double,salt:double,saturated_fat:double,alcohol:double>",
    "nova_group": "int", "manufacturer": "struct<name:string,country:string>", "specs": "struct<weight:string,storage:string,best_before:string,calories_per_unit:string>",
    "price": "double", "shelf": "string", "stock_status": "string", "nutriscore": "string", "quality": "double", "external_source": "string",
    "is_verified": "boolean", "needs_review": "boolean", "is_enriched": "boolean", "updated_at": "string",
}
LISTS = [c for c, kind in ENTITY.items() if kind == "array<string>"]


def _reader(df: DataFrame):
    """Column of a name, or null of a kind where df lacks it."""
    return lambda name, kind="string": F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def _map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _list(text: Column) -> Column:
    return string_array(text)


def json_list(x: Column) -> Column:
    """An array as JSON, [] if it is null."""
    return F.coalesce(F.to_json(x), F.lit("[]"))


def json_or(x: Column, schema: str, fallback: Column) -> Column:
    """JSON read by a schema, or the fallback where it is null or malformed."""
    return F.coalesce(F.from_json(x, schema), fallback)


def manufacturer(name: Column, country: Column) -> Column:
    """Name and country; a name that is a JSON object brings its own, its country first."""
    held = F.when(F.trim(name).startswith("{"), _map(name))
    plain = F.when(held.isNull(), name)
    part = lambda k: F.try_element_at(held, F.lit(k))
    return F.struct(
        F.coalesce(F.nullif(part("name"), F.lit("")), F.nullif(plain, F.lit(""))).alias("name"),
        F.coalesce(F.nullif(part("country"), F.lit("")), F.nullif(country, F.lit(""))).alias("country"),
    )


def specs(text: Column) -> Column:
    """Weight, storage, date and calories of a JSON object, each from the first of its keys that is not blank."""
    held = _map(text)
    get = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(held, F.lit(k)), F.lit("")) for k in keys])
    return F.struct(
        get("weight", "quantity").alias("weight"), get("storage").alias("storage"), get("bestBefore", "expiry").alias("best_before"), get("caloriesPerUnit", "calories").alias("calories_per_unit")
    )


def completed(values: dict[str, Column]) -> dict[str, Column]:
    """All columns of an entity: lists are never null, a score is a letter, an image is always there."""
    none = F.array().cast("array<string>")
    full = {c: values.get(c, F.lit(None)).cast(kind) for c, kind in ENTITY.items()}
    full |= {c: F.coalesce(full[c], none) for c in LISTS}
    full["nutriscore"] = nutriscore(full["nutriscore"])
    full["nova_group"] = nova_group(full["nova_group"])
    full["halal_status"] = halal_status(full["halal_status"])
    full["image"] = image(full["image"], full["images"], full["ean"])
    for c in ("is_verified", "needs_review", "is_enriched"):
        full[c] = F.coalesce(full[c], F.lit(False))
    return full


def _entity(df: DataFrame, values: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """df's rows as entities."""
    return df.select(*keep, *[v.alias(c) for c, v in completed(values).items()])


def global_values(c, overlaid: bool = False) -> dict[str, Column]:
    """Values of the entity columns that these rows have; c reads a name as a kind."""
    return {
        "source": F.lit("store" if overlaid else "global"), "id": c("id"), "ean": c("ean"), "alternate_eans": _list(c("alternate_eans")), "name": c("name"),
        "name_kz": F.nullif(c("name_kz"), F.lit("")), "brand": c("brand"), "category": truthy_or(c("category"), F.lit(DEFAULT_CATEGORY)),
        **{x: F.nullif(c(x), F.lit("")) for x in ("subcategory", "quantity", "group", "description", "ingredients_kz")}, "images": _list(c("images")),
        "image": F.nullif(c("image_url"), F.lit("")), "ingredients": F.nullif(c("ingredients_raw"), F.lit("")),
        **{x: _list(c(f"{x}_json")) for x in ("allergens", "diet_tags", "tags", "additives_tags", "traces", "categories_tags")},
        "halal_status": c("halal_status"), "nutrition": nutrition(_map(c("nutriments_json"))), "nova_group": c("nova_group", "int"),
        "manufacturer": manufacturer(c("manufacturer"), c("country_of_origin")), "specs": specs(c("specs_json")),
        "price": F.nullif(c("price", "double"), F.lit(0.0)), "shelf": shelf_text(c("shelf_zone"), c("shelf_position")), "stock_status": F.nullif(c("stock_status"), F.lit("")),
        "nutriscore": c("nutriscore"), "quality": c("data_quality_score", "double"), "external_source": F.nullif(c("source_primary"), F.lit("")),
        "is_verified": c("is_verified", "boolean"), "needs_review": c("needs_review", "boolean"), "is_enriched": c("source_primary") == "ai_enriched",
        "updated_at": truthy_or(c("updated_at"), c("created_at")),
    }


def from_global(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows of the product table, with lists and maps as JSON. With a store's columns (store_product_id, price, shelf_zone,
    shelf_position, stock_status) they are that store's products; a price of 0 is none."""
    return _entity(df, global_values(_reader(df), "store_product_id" in df.columns), keep)


def cache_values(c) -> dict[str, Column]:
    """Values of the entity columns that these rows have; c reads a name as a kind."""
    n = lambda x: F.nullif(c(f"normalized_{x}"), F.lit(""))
    url = F.nullif(c("image_url"), F.lit(""))
    return {
        "source": F.lit("cache"), "ean": c("ean"), "name": F.coalesce(n("name"), F.concat(F.lit(PLACEHOLDER), c("ean"))), "brand": n("brand"), "category": n("category"),
        "quantity": n("quantity"), "images": F.array_compact(F.array(url)), "description": n("description"), "ingredients": n("ingredients"),
        **{x: _list(c(f"normalized_{x}_json")) for x in ("allergens", "diet_tags", "additives_tags", "traces")}, "nutrition": nutrition(_map(c("normalized_nutriments_json"))),
        "nova_group": c("nova_group", "int"), "nutriscore": c("nutriscore"), "external_source": truthy_or(c("source"), F.lit("openfoodfacts")),
        "needs_review": F.lit(True), "updated_at": truthy_or(c("updated_at"), c("cached_at")),
    }


def from_cache(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows of the cache of looked-up products (normalized_* columns); always to be reviewed."""
    return _entity(df, cache_values(_reader(df)), keep)


def demo_values(c) -> dict[str, Column]:
    """Values of the entity columns that these rows have; c reads a name as a kind."""
    blank = lambda x: F.nullif(c(x), F.lit(""))
    maker = manufacturer(c("manufacturer"), c("country"))
    brand = F.coalesce(F.when(F.trim(c("manufacturer")).startswith("{"), maker["name"]), blank("brand"))
    held = specs(c("specs"))
    return {
        "source": F.lit("demo"), "demo_id": c("id"), "ean": c("ean"), "name": c("name"), "brand": brand, "category": truthy_or(c("category"), F.lit(DEFAULT_CATEGORY)),
        "subcategory": blank("subcategory"), "quantity": F.coalesce(blank("quantity"), F.try_element_at(_map(c("specs")), F.lit("weight"))), "group": blank("group"),
        "images": c("images", "array<string>"), "description": blank("description"), "ingredients": blank("ingredients"),
        "allergens": c("allergens", "array<string>"), "diet_tags": c("diet_tags", "array<string>"), "tags": c("tags", "array<string>"),
        "halal_status": F.coalesce(c("halal_status"), c("halal").cast("string")), "nutrition": nutrition(_map(truthy_or(c("nutrition_per_100"), c("nutrition")))),
        "manufacturer": maker, "specs": held, "price": c("price", "double"), "shelf": blank("shelf"), "stock_status": blank("stock_status"), "nutriscore": c("nutriscore"), "quality": c("quality", "double"),
    }


def from_demo(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows of a demo catalog. ingredients_raw and nutriments are not read, as entities of it never had them."""
    return _entity(df, demo_values(_reader(df)), keep)


def payload_values(c) -> dict[str, Column]:
    """Values of the entity columns that these rows have; c reads a name as a kind."""
    none = F.array().cast("array<string>")
    tags = lambda x: c(x, "array<string>")
    table = F.create_map(*[F.lit(x) for pair in PAYLOAD_ALLERGENS.items() for x in pair])
    mapped = lambda x: F.array_distinct(F.array_compact(F.transform(x, lambda t: F.try_element_at(table, t))))
    labels = F.coalesce(tags("labels_tags"), none)
    has = lambda p: F.exists(labels, lambda t: t.rlike(f"(?i){p}"))
    # an empty list is a list: only a missing one is looked for elsewhere
    allergens = F.coalesce(tags("allergens_tags"), tags("allergens_hierarchy"), none)
    url = F.nullif(c("image_front_url"), F.lit(""))
    return {
        "source": F.lit("off"), "ean": c("ean"), "name": F.coalesce(F.nullif(F.trim(c("product_name")), F.lit("")), F.concat(F.lit(PLACEHOLDER), c("ean"))),
        "brand": F.nullif(F.trim(c("brands")), F.lit("")), "quantity": F.nullif(c("quantity"), F.lit("")), "images": F.array_compact(F.array(url)),
        "ingredients": F.coalesce(F.nullif(c("ingredients_text_ru"), F.lit("")), F.nullif(c("ingredients_text"), F.lit(""))),
        "allergens": mapped(allergens), "traces": mapped(F.coalesce(tags("traces_tags"), none)), "categories_tags": tags("categories_tags"),
        "additives_tags": F.transform(tags("additives_tags"), lambda t: F.regexp_replace(t, "^en:", "")),
        "diet_tags": F.array_compact(F.array(*[F.when(has(p), tag) for p, tag in PAYLOAD_DIETS.items()])), "halal_status": F.when(has("halal"), "yes").otherwise("unknown"),
        "nutrition": nutrition(c("nutriments", "map<string,string>")), "nova_group": c("nova_group", "int"), "nutriscore": c("nutriscore_grade"),
        "external_source": F.lit("openfoodfacts"), "needs_review": F.lit(True),
    }


def from_payload(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Records of the open product database: ean and the payload's own columns."""
    return _entity(df, payload_values(_reader(df)), keep)


def enrich(entities: DataFrame, found: DataFrame, key: str = "ean") -> DataFrame:
    """entities with what found(key, description, ingredients, allergens, diet_tags) tells of them, one row a key.

    Texts replace unless blank, allergens unless empty, diet tags are added behind the known ones; rows that found
    has are marked is_enriched.
    """
    f = found.groupBy(key).agg(F.min(F.struct("description", "ingredients", "allergens", "diet_tags")).alias("_f"))
    out = entities.join(f, key, "left")
    size = lambda c: F.coalesce(F.size(f"_f.{c}"), F.lit(0))
    values = {
        "description": truthy_or(F.col("_f.description"), F.col("description")), "ingredients": truthy_or(F.col("_f.ingredients"), F.col("ingredients")),
        "allergens": F.when(size("allergens") > 0, F.col("_f.allergens")).otherwise(F.col("allergens")),
        "diet_tags": F.when(size("diet_tags") > 0, F.array_union("diet_tags", "_f.diet_tags")).otherwise(F.col("diet_tags")),
        "is_enriched": F.col("is_enriched") | F.col("_f").isNotNull(),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in entities.columns])


def store_rows(stock: DataFrame, products: DataFrame, prefer: str = "global") -> DataFrame:
    """A store's stock with the columns of its products, by product_id; a product may be missing.

    prefer: whose name counts first, global or local; without either the code stands for it. A price of 0 is none,
    halal is unknown and quality 0 where the product does not say.
    """
    p = products.select(F.col("id").alias("product_id"), *[F.col(c).alias(f"p_{c}") for c in ("name", "brand", "category", "image_url", "halal_status", "nutriscore", "quality", "is_verified")])
    first, second = ("p_name", "local_name") if prefer == "global" else ("local_name", "p_name")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return stock.join(p, "product_id", "left").select(
        "store_id", "ean", F.coalesce(blank(first), blank(second), F.col("ean")).alias("name"), blank("p_brand").alias("brand"), blank("p_category").alias("category"),
        F.nullif("price", F.lit(0.0)).alias("price"), "stock_status", shelf_text(F.col("shelf_zone"), F.col("shelf_position")).alias("shelf"),
        F.coalesce(blank("p_halal_status"), F.lit("unknown")).alias("halal_status"), blank("p_nutriscore").alias("nutriscore"),
        F.coalesce("p_quality", F.lit(0)).alias("quality"), F.coalesce("p_is_verified", F.lit(False)).alias("is_verified"), F.lit(True).alias("is_store_product"),
    )
