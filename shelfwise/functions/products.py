"""Column functions that normalise product fields of differing sources to one form."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import number_or_null, truthy_or

# Tags of allergens and their ids, words of the halal and diet rules, shelves, tastes and nutrition keys.
ALLERGEN_TAGS = {
    "en:milk": "milk", "en:gluten": "gluten", "en:nuts": "tree_nuts", "en:peanuts": "peanuts", "en:soybeans": "soy", "en:eggs": "eggs", "en:fish": "fish",
    "en:crustaceans": "crustaceans", "en:molluscs": "mollusks", "en:wheat": "gluten", "en:sesame-seeds": "sesame", "en:celery": "celery", "en:mustard": "mustard",
    "en:lupin": "lupin", "en:sulphur-dioxide-and-sulphites": "sulfites",
}
#: The map of the bulk import, and that of the first seeds, which name some allergens otherwise.
IMPORT_ALLERGEN_TAGS = {
    "en:milk": "milk", "en:gluten": "gluten", "en:nuts": "nuts", "en:peanuts": "peanuts", "en:soybeans": "soy", "en:soy": "soy", "en:eggs": "eggs", "en:fish": "fish",
    "en:crustaceans": "shellfish", "en:shellfish": "shellfish", "en:wheat": "gluten", "en:sesame": "sesame", "en:celery": "celery", "en:mustard": "mustard",
    "en:lupin": "lupin", "en:molluscs": "molluscs", "en:sulphur-dioxide-and-sulphites": "sulphites",
}
SEED_ALLERGEN_TAGS = {
    "en:milk": "milk", "en:gluten": "gluten", "en:nuts": "nuts", "en:peanuts": "peanuts", "en:soybeans": "soy", "en:eggs": "eggs", "en:fish": "fish",
    "en:crustaceans": "shellfish", "en:wheat": "gluten", "en:sesame": "sesame", "en:celery": "celery", "en:mustard": "mustard",
}
HARAM_WORDS = ["свинин", "pork", "gelatine", "желатин"]
DIETS = {"vegan": "vegan", "vegetarian": "vegetarian", "halal": "halal", "gluten.free": "gluten_free", "sugar.free": "sugar_free"}
SHELVES = [
    (["батончик", "bar"], "chocolate_bars"), (["плитка", "tablet"], "chocolate_tablets"), (["порцион", "portion"], "chocolate_portion"),
    (["фигур", "figure"], "chocolate_figures"), (["яйцо", "egg"], "chocolate_eggs"),
]
SHELF_DEFAULT = "chocolate"
NUTRITION = {
    "kcal": ["kcal", "calories", "energy-kcal_100g"], "protein": ["protein", "proteins_100g"], "fat": ["fat", "fat_100g"],
    "carbs": ["carbs", "carbohydrates", "carbohydrates_100g"], "sugar": ["sugar", "sugars", "sugars_100g"], "fiber": ["fiber", "fibre", "fiber_100g"],
    "salt": ["salt", "salt_100g"], "saturated_fat": ["saturatedFat", "saturated-fat_100g"], "alcohol": ["alcohol", "alcohol_100g"],
}

#: Lists of the suitability rules: synonyms of 14 allergens, trace phrases, sweeteners, words of alcohol and sugar.
FIT_RULES = json.loads((Path(__file__).parents[1] / "dictionaries" / "fit_rules.json").read_text("utf-8"))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def nutriscore(x: Column) -> Column:
    """A to E, else null."""
    u = F.upper(F.trim(x))
    return F.when(u.rlike("^[A-E]$"), u)


def nutriscore_prefix(x: Column) -> Column:
    """The first letter, if it is A to E."""
    u = F.upper(F.substring(x, 1, 1))
    return F.when(u.isin("A", "B", "C", "D", "E"), u)


def nova_group(x: Column) -> Column:
    return F.when(x.isin(1, 2, 3, 4), x)


def halal_status(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("true", "yes", "halal"), "yes").when(v.isin("false", "no"), "no").otherwise("unknown")


def halal_inferred(labels: Column, ingredients: Column, alcohol: Column) -> Column:
    """By label, then forbidden ingredients, then alcohol over half a percent."""
    marked = F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda t: F.lower(t).contains("halal"))
    return F.when(marked, "yes").when(_any(F.lower(ingredients), HARAM_WORDS), "no").when(alcohol > 0.5, "no").otherwise("unknown")


def diet_tags(labels: Column) -> Column:
    has = lambda p: F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda t: t.rlike(f"(?i){p}"))
    return F.array_compact(F.array(*[F.when(has(p), tag) for p, tag in DIETS.items()]))


def allergens(tags: Column, known: dict[str, str] = ALLERGEN_TAGS) -> Column:
    """Ids of known allergen tags, each once, in first-seen order."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(table, F.lower(t))), lambda a: a.isNotNull()))


def additives(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.upper(F.regexp_replace(t, "^en:", "")))


def nutrition(values: Column) -> Column:
    """A struct of the nine values of a map, each from the first of its keys that is there. The map is computed once."""
    get = lambda m, keys: F.coalesce(*[number_or_null(F.try_element_at(m, F.lit(k)).cast("string")) for k in keys])
    return F.get(F.transform(F.array(values), lambda m: F.struct(*[get(m, keys).alias(name) for name, keys in NUTRITION.items()])), F.lit(0))


def clean_text(x: Column, limit: int) -> Column:
    """Tags gone, white space collapsed, cut to a limit; blank is null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    return F.nullif(F.substring(plain, 1, limit), F.lit(""))


def clean_url(x: Column) -> Column:
    return F.when(F.trim(x).startswith("http"), F.substring(F.trim(x), 1, 500))


def clean_code(x: Column) -> Column:
    return F.when(F.trim(x).rlike("^[0-9]{8,30}$"), F.trim(x))


def codes_in(x: Column) -> Column:
    """All 13-digit codes of a text that stand alone, each once."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b([0-9]{13})\b"), 1))


def shelf(x: Column) -> Column:
    """The shelf of the first rule that a name fits; null counts as blank."""
    low, out = F.lower(F.coalesce(x, F.lit(""))), F.lit(SHELF_DEFAULT)
    for words, name in reversed(SHELVES):
        out = F.when(_any(low, words), name).otherwise(out)
    return out


def first_entry(text: Column, entries: list[tuple[str, str]], default: str) -> Column:
    """The value of the first key, in the order given, that a text holds."""
    out = F.lit(default)
    for key, value in reversed(entries):
        out = F.when(text.contains(key), value).otherwise(out)
    return out


def shelf_text(zone: Column, position: Column) -> Column:
    return F.nullif(F.concat_ws(" / ", F.nullif(zone, F.lit("")), F.nullif(position, F.lit(""))), F.lit(""))


def canonical_id(uuid: Column, ean: Column, demo: Column) -> Column:
    hashed = F.concat(F.lit("tmp:"), F.sha2(F.concat_ws("|", uuid, ean, demo), 256))
    return (
        F.when(is_uuid(uuid), F.concat(F.lit("gp:"), uuid)).when(F.nullif(ean, F.lit("")).isNotNull(), F.concat(F.lit("ean:"), ean))
        .when(demo.isNotNull(), F.concat(F.lit("demo:"), demo)).otherwise(hashed)
    )


def is_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def reference_kind(x: Column) -> Column:
    """What a route's product reference is."""
    return (
        F.when(x.startswith("gp:") | is_uuid(x), "id").when(x.startswith("ean:") | x.rlike("^[0-9]{8,14}$"), "ean").when(x.startswith("demo:"), "demo").otherwise("other")
    )


def image(x: Column, images: Column, ean: Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.get(images, F.lit(0)), F.concat(F.lit("/products/"), ean, F.lit(".png")))


def first_brand(x: Column) -> Column:
    return F.trim(F.split_part(x, F.lit(","), F.lit(1)))


def localised(preferred: Column, other: Column, default: Column) -> Column:
    return truthy_or(preferred, truthy_or(other, default))


def admitted(code: Column, name: Column, countries: Column, name_ru: Column, ingredients_ru: Column, brand: Column, brands: list[str], has_data: Column) -> Column:
    """Whether a dump record is imported: a code and a name, and one of the reasons of interest."""
    known = F.exists(F.array(*[F.lit(b) for b in brands]), lambda b: F.lower(brand).contains(b)) if brands else F.lit(False)
    local = F.exists(F.coalesce(countries, F.array().cast("array<string>")), lambda c: c.contains("kazakhstan"))
    long = lambda x, n: F.coalesce(F.length(F.trim(x)) > n, F.lit(False))
    wanted = local | long(name_ru, 2) | long(ingredients_ru, 10) | (F.coalesce(known, F.lit(False)) & has_data)
    return (F.length(F.trim(code)) >= 8) & (F.length(F.trim(name)) >= 2) & F.coalesce(wanted, F.lit(False))


def is_grocery(brand: Column, title: Column, bad_brands: list[str], bad_words: list[str]) -> Column:
    """Not a listing of other goods: by brand, by keywords, or by measures in the title."""
    t = F.lower(title)
    other = F.lower(brand).isin(bad_brands) | _any(t, bad_words) | t.rlike(r"[0-9]+\s*[хx×]\s*[0-9]+") | t.rlike(r"[0-9]+\s*см")
    return ~F.coalesce(other, F.lit(False))


def front_matter(x: Column) -> Column:
    """Keys and values between the leading and the next ---; one pair of outer quotes goes."""
    block = F.regexp_extract(x, r"(?s)^---\n(.*?)---", 1)
    lines = F.filter(F.split(block, "\n"), lambda v: v.rlike(r"^[^:]+:\s*\S"))
    key = lambda v: F.trim(F.regexp_extract(v, "^([^:]+):", 1))
    value = lambda v: F.regexp_replace(F.trim(F.regexp_extract(v, "^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "")
    return F.map_from_entries(F.transform(lines, lambda v: F.struct(key(v), value(v))))


def path_domain(x: Column) -> Column:
    parts = F.split(x, "/")
    return F.struct(F.get(parts, F.lit(0)).alias("domain"), F.get(parts, F.lit(1)).alias("subdomain"))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def named_allergens(text: Column, synonyms: dict[str, list[str]], wanted: Column) -> Column:
    """Those of the wanted allergens that a lower-cased text names, in the dictionary's order."""
    known = F.array(*[F.struct(F.lit(a).alias("allergen"), _strings(words).alias("words")) for a, words in synonyms.items()])
    found = F.filter(known, lambda d: F.array_contains(wanted, d["allergen"]) & F.exists(d["words"], lambda w: text.contains(w)))
    return F.transform(found, lambda d: d["allergen"])


def lists_named(text: Column, lists: dict[str, list[str]]) -> Column:
    """Names of the lists of which a text holds a word, in their order; a null text holds none.

    Python's search skips ahead, which counts where hundreds of words are looked for in long texts.
    """

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [name for name, words in lists.items() if any(w in t for w in words)] for t in texts], dtype="object")

    return named(text)


def trace_warnings(ingredients: Column, synonyms: dict[str, list[str]], wanted: Column, phrases: list[str] | None = None, said: Column | None = None) -> Column:
    """Allergens of the profile named within 100 characters after the first mention of a trace phrase, by phrase.

    said: the phrases that the text is known to hold, in their order, else they are looked for.
    """
    known = _strings(FIT_RULES["trace_phrases"] if phrases is None else phrases)
    held = lambda low: F.filter(known, lambda p: low.contains(p)) if said is None else said
    near = lambda low: F.transform(held(low), lambda p: F.substr(low, F.instr(low, p) + F.length(p), F.lit(100)))
    # the text is lowered once, and not for each phrase
    told = F.get(F.transform(F.array(F.lower(F.coalesce(ingredients, F.lit("")))), near), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(told, lambda t: named_allergens(t, synonyms, wanted))))


def query_text(ingredients: Column, allergens_: Column, profile: Column) -> Column:
    """Text of a retrieval query: 200 characters of ingredients, allergens, the profile's allergens; 500 at most."""
    return F.substring(F.concat_ws(" ", F.substring(ingredients, 1, 200), F.array_join(allergens_, " "), F.array_join(profile, " ")), 1, 500)


def better_side(a: Column, b: Column, lower_is_better: bool) -> Column:
    """Which of two printed values is better; what is no number counts 0."""
    x, y = (F.coalesce(number_or_null(F.regexp_extract(c, r"[-+]?[0-9]*\.?[0-9]+", 0)), F.lit(0.0)) for c in (a, b))
    first = x < y if lower_is_better else x > y
    return F.when(x == y, "none").when(first, "a").otherwise("b")
