"""Suitability of products for shopper profiles: ordered rules that give reasons, then a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.products import FIT_RULES, lists_named, trace_warnings
from shelfwise.functions.text import decimal_number

SEVERITIES = ["safe", "caution", "warning", "danger"]
REASON = "struct<severity:string,category:string,subject:string>"


def _reason(severity: str, category: str, subject: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), subject.cast("string").alias("subject"))


def _if(condition: Column, *reason) -> Column:
    """An array of one reason, or none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_reason(*reason))).otherwise(F.array().cast(f"array<{REASON}>"))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def check_fit(rows: DataFrame, rules: dict = FIT_RULES) -> DataFrame:
    """rows with reasons, verdict and fits.

    Product columns: name, ingredients, allergens, traces, diet_tags (arrays), sugar, protein, alcohol, halal_status.
    Profile columns: user_allergens, custom_allergens, conditions, diets (arrays), halal_only, halal_strict. Null
    arrays are empty. Rules run in order; an allergen that one has reported is not reported again, but traces that the
    ingredients tell of are. Confirmations, which are safe, follow the verdict. rules: the lists as in FIT_RULES.
    """
    arrays = ["allergens", "traces", "diet_tags", "user_allergens", "custom_allergens", "conditions", "diets"]
    none = F.array().cast("array<string>")
    df = rows.withColumns({f"_{c}": F.coalesce(c, none) for c in arrays})
    df = df.withColumns({"_ingr": F.lower(F.coalesce("ingredients", F.lit(""))), "_name": F.lower(F.coalesce("name", F.lit("")))})
    bare = lambda a: F.regexp_replace(a, "(?s)^(.*?)en:", "$1")
    mine = lambda c: F.transform(F.filter(c, lambda a: F.array_contains("_user_allergens", bare(a)) | F.array_contains("_user_allergens", a)), bare)
    df = df.withColumn("_listed", mine("_allergens"))
    seek = F.when(F.array_contains("_conditions", "celiac"), F.array_append("_user_allergens", "gluten")).otherwise(F.col("_user_allergens"))
    df = df.withColumn("_seek", seek)
    # all words are looked for in one pass over the ingredients
    lists = {f"allergen:{a}": words for a, words in rules["synonyms"].items()} | {f"phrase:{p}": [p] for p in rules["trace_phrases"]} | {x: rules[x] for x in ("sugar", "sweeteners", "haram")}
    df = df.withColumn("_held", lists_named(F.col("_ingr"), lists))
    held = lambda kind: F.transform(F.filter("_held", lambda x: x.startswith(f"{kind}:")), lambda x: F.substr(x, F.lit(len(kind) + 2)))
    df = df.withColumn("_words", F.filter(held("allergen"), lambda a: F.array_contains("_seek", a)))
    df = df.withColumn("_worded", F.array_except(F.array_intersect("_user_allergens", "_words"), "_listed"))
    full = F.concat_ws(" ", "_name", "_ingr")
    df = df.withColumn("_custom", F.filter("_custom_allergens", lambda c: full.contains(F.lower(c))))
    df = df.withColumn("_traced", F.array_except(mine("_traces"), F.concat("_listed", "_worded")))
    df = df.withColumn("_warned", trace_warnings(F.col("_ingr"), rules["synonyms"], F.col("_seek"), rules["trace_phrases"], held("phrase")))
    sick = lambda c: F.array_contains("_conditions", c)
    each = lambda col, severity, category="allergen": F.transform(col, lambda a: _reason(severity, category, a))
    sugar, protein, alcohol = F.col("sugar"), F.col("protein"), F.coalesce("alcohol", F.lit(0.0))
    gluten = F.array_contains("_words", "gluten") | F.exists("_allergens", lambda a: a.contains("gluten") | a.contains("wheat"))
    told = F.array_contains(F.concat("_listed", "_worded"), "gluten")
    halal = F.coalesce(F.col("halal_only"), F.lit(False))
    strict = F.coalesce(F.col("halal_strict"), F.lit(False))
    status = F.coalesce(F.col("halal_status"), F.lit("unknown"))
    diet = lambda d: F.array_contains("_diets", d)
    has = lambda t: F.array_contains("_diet_tags", t)
    sugar_text = F.coalesce(sugar.cast("string"), F.lit("unknown"))
    df = df.withColumn(
        "reasons",
        F.concat(
            each("_listed", "danger"), each("_worded", "danger"), each("_custom", "danger"), each("_traced", "warning"),
            _if(sick("diabetes") & (sugar > 22.5), "danger", "health", sugar_text),
            _if(sick("diabetes") & (sugar > 5) & (sugar <= 22.5), "warning", "health", sugar_text),
            _if(sick("diabetes") & (sugar <= 5), "safe", "health", sugar_text),
            _if(sick("diabetes") & sugar.isNull() & F.array_contains("_held", "sugar"), "warning", "health", F.lit("sugar")),
            _if(sick("celiac") & gluten & ~told, "danger", "health", F.lit("gluten")),
            _if(sick("pku") & F.array_contains("_held", "sweeteners"), "danger", "health", F.lit("aspartame")),
            _if(sick("pku") & (protein > 20), "warning", "health", F.lit("protein")),
            each("_warned", "warning", "trace"),
            _if(halal & (status == "no") & strict, "warning", "halal", F.lit("no")),
            _if(halal & (status == "no") & ~strict, "caution", "halal", F.lit("no")),
            _if(halal & (alcohol > 0), "danger", "halal", F.lit("alcohol")),
            _if(halal & (status == "unknown") & (alcohol <= 0) & F.array_contains("_held", "haram"), "danger", "halal", F.lit("ingredient")),
            _if(diet("sugar_free") & has("contains_sugar"), "caution", "diet", F.lit("sugar_free")),
            _if(diet("dairy_free") & has("contains_dairy"), "caution", "diet", F.lit("dairy_free")),
            _if(diet("vegan") & (has("contains_dairy") | F.exists("_allergens", lambda a: a.isin("milk", "en:milk"))), "caution", "diet", F.lit("vegan")),
        ),
    )
    rank = F.aggregate("reasons", F.lit(0), lambda a, r: F.greatest(a, F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), r["severity"]).cast("int") - 1, F.lit(0))))
    df = df.withColumn("verdict", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1))
    told_of = F.exists("reasons", lambda r: r["category"].isin("allergen", "trace"))
    good = F.concat(_if(halal & (status == "yes"), "safe", "halal", F.lit("yes")), _if((F.size("_user_allergens") > 0) & ~told_of, "safe", "allergen", F.lit("none")))
    df = df.withColumn("reasons", F.when(F.col("verdict") != "danger", F.concat("reasons", good)).otherwise(F.col("reasons")))
    return df.withColumn("fits", F.col("verdict") == "safe").select(*rows.columns, "reasons", "verdict", "fits")


def fit_score(quality: Column) -> Column:
    """A product's score: its quality, 100 where that is unknown or 0."""
    return F.coalesce(F.nullif(quality, F.lit(0)), F.lit(100))


def shown(reasons: Column, verdict: Column) -> Column:
    """Reasons to show: all dangers and warnings; warnings and one caution; three cautions; or three safe
    ones, and without any that the preferences are met."""
    of = lambda *s: F.filter(reasons, lambda r: r["severity"].isin(*s))
    return (
        F.when(verdict == "danger", of("danger", "warning"))
        .when(verdict == "warning", F.concat(of("warning"), F.slice(of("caution"), 1, 1)))
        .when(verdict == "caution", F.slice(of("caution"), 1, 3))
        .otherwise(F.when(F.size(of("safe")) > 0, F.slice(of("safe"), 1, 3)).otherwise(F.array(_reason("safe", "diet", F.lit("preferences")))))
    )


def sugar_class(text: Column) -> Column:
    """Sugar as printed ('9,1 g') against the diabetes bounds."""
    v = decimal_number(text)
    return F.when(v > 22.5, "danger").when(v > 5, "warning").when(v.isNotNull(), "safe")


# Word lists of the check of external products, and allergens that fail a diet by themselves.
EXTERNAL_WORDS = {
    "sugar_free": ["сахар", "sugar", "sucre", "zucker", "глюкоз", "фруктоз", "сироп"],
    "dairy_free": ["молок", "сливк", "масло слив", "сметан", "сыр", "milk", "cream", "butter", "cheese", "whey", "casein", "лактоз"],
    "gluten_free": ["пшениц", "wheat", "gluten", "ячмен", "рожь"],
    "vegan": ["говядин", "свинин", "курин", "мясо", "beef", "pork", "chicken", "meat"],
}
EXTERNAL_ALLERGENS = {"sugar_free": [], "dairy_free": ["milk"], "gluten_free": ["gluten", "wheat"], "vegan": ["milk", "eggs"]}


def check_external(rows: DataFrame) -> DataFrame:
    """rows with fails (three at most), fits and shown, for products known from outside only.

    Columns: ingredients, allergens, halal (nullable boolean), user_allergens, custom_allergens, diets, halal_only. shown
    lists what a shopper sees, three at most: an unknown halal status as a warning before the fails, and what speaks for
    a product that fits. This is another, simpler check than check_fit, and its outcomes may differ.
    """
    text = F.lower(F.coalesce("ingredients", F.lit("")))
    none = F.array().cast("array<string>")
    held, sought = F.coalesce("allergens", none), F.coalesce("user_allergens", none)
    listed = F.filter(held, lambda a: F.array_contains(sought, a))
    custom = F.filter(F.coalesce("custom_allergens", none), lambda c: text.contains(F.lower(c)))
    broken = lambda d: _any(text, EXTERNAL_WORDS[d]) | F.arrays_overlap(held, F.array(*[F.lit(a) for a in EXTERNAL_ALLERGENS[d]]).cast("array<string>"))
    diets = [F.when(F.array_contains(F.coalesce("diets", none), d) & F.coalesce(broken(d), F.lit(False)), d) for d in EXTERNAL_WORDS]
    halal = F.coalesce("halal_only", F.lit(False))
    fails = F.concat(F.array_compact(F.array(F.when(halal & (F.col("halal") == F.lit(False)), "halal"))), listed, custom, F.array_compact(F.array(*diets)))
    unknown = F.array_compact(F.array(F.when(halal & F.col("halal").isNull(), "halal_unknown")))
    praise = F.array_compact(F.array(F.when(halal & F.col("halal"), "halal_confirmed"), F.when((F.size(sought) > 0) & (F.size(held) == 0), "no_allergens")))
    praise = F.when(F.size(praise) > 0, praise).otherwise(F.array(F.lit("matches_preferences")))
    shown = F.concat(unknown, F.when(F.size(fails) > 0, fails).otherwise(praise))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.slice(fails, 1, 3).alias("fails"), (F.size(fails) == 0).alias("fits"), F.slice(shown, 1, 3).alias("shown"))


def halal_from_labels(labels: Column) -> Column:
    """True by a halal label, false by one of pork or alcohol, else null."""
    has = lambda w: F.exists(labels, lambda t: F.lower(t).contains(w))
    return F.when(has("halal"), F.lit(True)).when(has("pork") | has("alcohol"), F.lit(False))
