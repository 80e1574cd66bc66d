"""Scan histories of owners: guests and shoppers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_time(x: Column, as_of: str) -> Column:
    """A text as a time; what is none counts as as_of."""
    return F.coalesce(F.try_to_timestamp(x), F.lit(as_of).cast("timestamp"))


def replace_owner(history: DataFrame, owner: str, entries: DataFrame) -> DataFrame:
    """history with an owner's rows replaced by entries; rows without an owner stay."""
    others = history.filter(~F.col("owner").eqNullSafe(F.lit(owner)))
    return others.unionByName(entries.withColumn("owner", F.lit(owner)).select(history.columns))


def latest_entries(history: DataFrame, key: list[str]) -> DataFrame:
    """The latest row of each key; rows alike in time by their other columns. It aggregates map-side."""
    rest = [c for c in history.columns if c not in key and c != "scanned_at"]
    last = history.groupBy(*key).agg(F.max(F.struct("scanned_at", *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in history.columns])


def claim_guest(history: DataFrame, owner: str, guest: str = "guest") -> DataFrame:
    """history with the guest's rows handed to an owner; of a store and product the latest row stays, and the guest has none."""
    mine = history.filter(F.col("owner").isin(owner, guest)).withColumn("owner", F.lit(owner))
    others = history.filter(~F.coalesce(F.col("owner").isin(owner, guest), F.lit(False)))
    return others.unionByName(latest_entries(mine, ["owner", "store_id", "ean"]).select(history.columns))


def still_favorite(entries: DataFrame, favorites: DataFrame) -> DataFrame:
    """Entries whose code is among the favorites; entries without a code stay."""
    held = entries.filter("ean is not null").join(favorites.select("ean").distinct(), "ean", "left_semi")
    return held.select(entries.columns).unionByName(entries.filter("ean is null"))
