"""Column functions that flatten the nested records of product services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nutrient names of the food table, allergen ids and word stems of the barcode database, and its range of food categories.
FOOD_NUTRIENTS = {
    "Energy": "kcal", "Protein": "proteins_100g", "Total lipid (fat)": "fats_100g", "Carbohydrate, by difference": "carbs_100g",
    "Fiber, total dietary": "fiber_100g", "Total Sugars": "sugars_100g", "Sodium, Na": "salt_100g",
}
RECORD_ALLERGENS = {
    "milk": "milk", "wheat": "gluten", "gluten": "gluten", "eggs": "eggs", "fish": "fish", "shellfish": "shellfish", "peanuts": "peanuts", "nuts": "nuts", "soy": "soy",
    "sesame": "sesame", "celery": "celery", "mustard": "mustard", "lactose": "milk", "tree-nuts": "nuts", "coconut": "nuts",
}
RECORD_STEMS = {"milk": ["молок", "молочн", "сливк"], "gluten": ["глютен", "пшенич", "мука пшен"], "peanuts": ["арахис"], "soy": ["соя", "соев"]}
FOOD_CATEGORIES = (1400, 5500)
SALT_OF_SODIUM = 400
NUTRITION_ALIASES = {"sugars": "sugars_100g", "protein": "proteins_100g", "salt": "salt_100g"}


def _none() -> Column:
    return F.array().cast("array<string>")


def last_wins(pairs: Column) -> Column:
    """A map of an array of (key, value), the last value of a key; null and blank keys go."""
    held = F.filter(pairs, lambda p: F.coalesce(p["key"] != "", F.lit(False)))
    last = F.filter(held, lambda p, i: ~F.exists(F.slice(held, i + 2, F.size(held)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def spec_features(groups: Column) -> Column:
    """name to (value, code, unit) of groups(features(name, code, unit, values(value, number))): the first value of each feature."""
    features = F.flatten(F.transform(groups, lambda g: F.coalesce(g["features"], F.slice(F.array(g["features"][0]), 1, 0))))
    value = lambda f: F.coalesce(F.nullif(F.get(f["values"], F.lit(0))["value"], F.lit("")), F.nullif(F.get(f["values"], F.lit(0))["number"], F.lit(0.0)).cast("string"))
    pairs = F.transform(features, lambda f: F.struct(f["name"].alias("key"), F.struct(value(f).alias("value"), F.nullif(f["code"], F.lit("")).alias("code"), F.nullif(f["unit"], F.lit("")).alias("unit")).alias("value")))
    return last_wins(F.filter(pairs, lambda p: p["value"]["value"].isNotNull()))


def fill_features(features: Column, other: Column, keys: list[str]) -> Column:
    """Values of the keys, each from the features unless blank there, else from another map of texts."""
    own = lambda k: F.nullif(F.try_element_at(features, F.lit(k))["value"], F.lit(""))
    return F.create_map(*[x for k in keys for x in (F.lit(k), F.coalesce(own(k), F.nullif(F.try_element_at(other, F.lit(k)), F.lit(""))))])


def food_nutrients(items: Column) -> Column:
    """Known nutrients of an array of (name, value) as a map, null if there are under three."""
    table = F.create_map(*[F.lit(x) for pair in FOOD_NUTRIENTS.items() for x in pair])
    pairs = F.transform(items, lambda n: F.struct(F.try_element_at(table, n["name"]).alias("key"), n["value"].alias("value")))
    out = last_wins(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return F.when(F.size(out) >= 3, out)


def _ingredients(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: g["items"]))


def ingredient_text(groups: Column) -> Column:
    """Groups(name, items(names, subs)) as text: 'group: a, b (c, d); e'. names, and those of subs, are maps by language.

    The Russian name comes first, then the English, then for items the German; items without a name go.
    """
    named = lambda m, langs: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(x)), F.lit("")) for x in langs])

    def item(i: Column) -> Column:
        subs = F.array_compact(F.transform(F.coalesce(i["subs"], F.slice(F.array(i["subs"][0]), 1, 0)), lambda s: F.coalesce(named(s["names"], ["ru", "en"]), F.nullif(s["id"], F.lit("")))))
        return F.concat(F.coalesce(named(i["names"], ["ru", "en", "de"]), F.lit("")), F.when(F.size(subs) > 0, F.concat(F.lit(" ("), F.array_join(subs, ", "), F.lit(")"))).otherwise(""))

    def group(g: Column) -> Column:
        text = F.array_join(F.filter(F.transform(g["items"], item), lambda x: x != ""), ", ")
        name = F.nullif(g["name"], F.lit(""))
        return F.when(text != "", F.when(name.isNotNull(), F.concat(name, F.lit(": "), text)).otherwise(text))

    return F.nullif(F.array_join(F.array_compact(F.transform(groups, group)), "; "), F.lit(""))


def record_additives(groups: Column) -> Column:
    """Upper-cased ids of ingredients, and of what they hold, that are E numbers; each once."""
    ids = F.flatten(F.transform(_ingredients(groups), lambda i: F.concat(F.array(i["id"]), F.coalesce(F.transform(i["subs"], lambda s: s["id"]), _none()))))
    return F.coalesce(F.array_distinct(F.transform(F.filter(ids, lambda x: F.coalesce(x.rlike("(?i)^e[0-9]{3,4}"), F.lit(False))), lambda x: F.upper(x))), _none())


def record_allergens(groups: Column, text: Column) -> Column:
    """Allergens that ingredients are marked with, then those that the text names by a stem; each once."""
    table = F.create_map(*[F.lit(x) for pair in RECORD_ALLERGENS.items() for x in pair])
    milk = lambda i: F.when((i["is_vegan"] == F.lit(False)) & (i["id"] == "milk"), F.array(F.lit("milk"))).otherwise(_none())
    marked = F.flatten(F.transform(_ingredients(groups), lambda i: F.concat(F.transform(F.coalesce(i["contains"], _none()), lambda c: F.try_element_at(table, c)), milk(i))))
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)), a) for a, words in RECORD_STEMS.items()])
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(marked, _none()), named)))


def record_diets(groups: Column, text: Column) -> Column:
    """vegan or vegetarian where no ingredient speaks against it and there is a text, and halal where the text says so."""
    low = F.lower(F.coalesce(text, F.lit("")))
    all_ = F.coalesce(_ingredients(groups), F.slice(F.array(groups[0]["items"][0]), 1, 0))
    against = lambda flag: F.exists(all_, lambda i: F.coalesce(i[flag] == F.lit(False), F.lit(False)))
    kind = F.when((low == "") | against("is_vegetarian"), None).when(against("is_vegan"), "vegetarian").otherwise("vegan")
    return F.array_compact(F.array(kind, F.when(low.contains("халал") | low.contains("halal"), "halal")))


def record_nutrition(values: Column) -> Column:
    """Nine values of a map of numbers; salt may come from sodium, energy is rounded, and 0 is none."""
    get = lambda k: F.nullif(F.try_element_at(values, F.lit(k)), F.lit(0.0))
    return F.struct(
        F.floor(get("energy") + 0.5).cast("double").alias("kcal"), get("proteins").alias("protein"), get("fat").alias("fat"), get("carbohydrates").alias("carbs"),
        F.coalesce(get("sugars"), get("sugar")).alias("sugar"), get("fiber").alias("fiber"), F.coalesce(get("salt"), get("sodium") / SALT_OF_SODIUM).alias("salt"),
        get("saturatedFat").alias("saturated_fat"), get("alcohol").alias("alcohol"),
    )


def record_category(categories: Column) -> Column:
    """The English, else the Russian, title of the first category(id, titles) in the range of foods."""
    food = F.filter(categories, lambda c: F.coalesce(c["id"].cast("string").try_cast("double").between(*FOOD_CATEGORIES), F.lit(False)))
    title = lambda x: F.nullif(F.try_element_at(F.get(food, F.lit(0))["titles"], F.lit(x)), F.lit(""))
    return F.coalesce(title("en"), title("ru"))


def nutrition_aliases(values: Column) -> Column:
    """A map with the values of short names put under their long names as well; these replace what is there."""
    added = F.map_filter(F.create_map(*[x for a, b in NUTRITION_ALIASES.items() for x in (F.lit(b), F.try_element_at(values, F.lit(a)))]), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(values, lambda k, v: ~F.map_contains_key(added, k)), added)
