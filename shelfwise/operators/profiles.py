"""Merging of local and stored shopper profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def merge_profiles(df: DataFrame, arrays: list[str]) -> DataFrame:
    """id, merged arrays (local items first), halal, conflict and action of rows with local_* and cloud_* columns."""
    pair = lambda c: (F.coalesce(f"local_{c}", F.array().cast("array<string>")), F.coalesce(f"cloud_{c}", F.array().cast("array<string>")))
    clash = [(F.size(a) > 0) & (F.size(b) > 0) & ~same_set(a, b) for a, b in map(pair, arrays)]
    conflict = F.coalesce(F.col("local_halal") != F.col("cloud_halal"), F.lit(False))
    for c in clash:
        conflict = conflict | c
    blank = lambda s: ~F.coalesce(F.col(f"{s}_halal"), F.lit(False)) & (sum((F.size(pair(c)[s == "cloud"]) for c in arrays), F.lit(0)) == 0)
    action = F.when(blank("cloud"), "upload").when(blank("local"), "apply_cloud").when(~conflict, "keep_cloud").otherwise("ask")
    merged = [F.array_union(*pair(c)).alias(c) for c in arrays]
    halal = F.coalesce(F.col("local_halal"), F.lit(False)) | F.coalesce(F.col("cloud_halal"), F.lit(False))
    return df.select("id", *merged, halal.alias("halal"), conflict.alias("conflict"), action.alias("action"))


# Allergen ids that were renamed, one that became a custom entry under its own name, and the presets.
RENAMED_ALLERGENS = {"nuts": "tree_nuts", "shellfish": "crustaceans"}
CUSTOM_ALLERGENS = {"honey": "Мёд"}
PRESETS = {
    "halal": {"halal": True},
    "sugar_free": {"diet_goals": ["sugar_free"], "sugar_free": True},
    "dairy_free": {"diet_goals": ["dairy_free"], "allergens": ["milk"]},
}


def migrate_allergens(allergens: Column, custom: Column) -> tuple[Column, Column]:
    """Allergens under their present ids, and custom entries with those that have none any more; each once."""
    none = F.array().cast("array<string>")
    a = F.coalesce(allergens, none)
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    moved = F.array_compact(F.transform(a, lambda x: F.try_element_at(table(CUSTOM_ALLERGENS), x)))
    kept = F.filter(a, lambda x: ~x.isin(*CUSTOM_ALLERGENS))
    renamed = F.array_distinct(F.transform(kept, lambda x: F.coalesce(F.try_element_at(table(RENAMED_ALLERGENS), x), x)))
    return renamed, F.array_union(F.coalesce(custom, none), moved)


def normalise_profiles(df: DataFrame) -> DataFrame:
    """id and the columns of a profile, with allergens migrated, lists without repeats, and nulls as nothing.

    Columns: halal, halal_only, halal_strict, sugar_free (booleans), allergens, custom_allergens, diet_goals,
    conditions (arrays). halal and halal_only are one: either sets both.
    """
    none = F.array().cast("array<string>")
    flag = lambda c: F.coalesce(c, F.lit(False))
    allergens, custom = migrate_allergens(F.col("allergens"), F.col("custom_allergens"))
    goals = F.array_distinct(F.coalesce("diet_goals", none))
    halal = flag("halal") | flag("halal_only")
    return df.select(
        "id", halal.alias("halal"), halal.alias("halal_only"), flag("halal_strict").alias("halal_strict"), (flag("sugar_free") | F.array_contains(goals, "sugar_free")).alias("sugar_free"),
        allergens.alias("allergens"), custom.alias("custom_allergens"), goals.alias("diet_goals"), F.array_distinct(F.coalesce("conditions", none)).alias("conditions"),
    )


def preset_profiles(ids: DataFrame) -> DataFrame:
    """Profiles of ids(id, preset); an unknown preset gives the empty profile."""
    def value(field: str, default: Column) -> Column:
        out = default
        for name, values in PRESETS.items():
            if field in values:
                v = values[field]
                out = F.when(F.col("preset") == name, F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).otherwise(out)
        return out.alias(field)

    none = F.array().cast("array<string>")
    return normalise_profiles(
        ids.select(
            "id", value("halal", F.lit(False)), F.lit(False).alias("halal_only"), F.lit(False).alias("halal_strict"), value("sugar_free", F.lit(False)),
            value("allergens", none), none.alias("custom_allergens"), value("diet_goals", none), none.alias("conditions"),
        )
    )


def preference_count(df: DataFrame) -> Column:
    """How many preferences a profile sets: its allergens, goals and conditions, and halal."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return size("allergens") + size("custom_allergens") + size("diet_goals") + size("conditions") + F.coalesce(F.col("halal"), F.lit(False)).cast("int")


def merge_counter(local: Column, remote: Column) -> Column:
    """The greater of two counters; a missing one is 0."""
    return F.greatest(F.coalesce(local, F.lit(0)), F.coalesce(remote, F.lit(0)))
