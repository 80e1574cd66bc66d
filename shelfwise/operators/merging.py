"""Keyed merges over plain files: each takes frames and returns the new state of the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.sources.work import exists, partition_column


def _last(source: DataFrame, key: list[str], order: list[str] | None) -> DataFrame:
    """One source row a key: the last by order; a source without order must have unique keys."""
    if not order:
        return source
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return source.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, key: list[str], columns: list[str], insert_only: list[str] = (), order: list[str] | None = None) -> DataFrame:
    """Inserts new keys, and replaces the listed columns of known ones; a listed null overwrites.

    insert_only columns are set on insert and kept on update. Columns in neither list stay null on insert.
    """
    s = _last(source, key, order).select(*key, *[F.col(c).alias(f"_s_{c}") for c in [*columns, *insert_only]], F.lit(True).alias("_s"))
    out = target.withColumn("_t", F.lit(True)).join(s, key, "full_outer")
    value = lambda c: (
        F.when(F.col("_s"), F.col(f"_s_{c}")).otherwise(F.col(c)) if c in columns
        else F.when(F.col("_t"), F.col(c)).otherwise(F.col(f"_s_{c}")) if c in insert_only else F.col(c)
    )
    return out.select(*[value(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds source rows with new keys, the first of each key by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = source.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(target, key, "left_anti")
    return target.unionByName(fresh.select(target.columns))


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the condition holds, and marks those rows in `updated`."""
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns], hit.alias("updated"))


def update_rows(target: DataFrame, condition: Column, values: dict[str, Column], stamp: str | None = None) -> DataFrame:
    """update_where that raises where no row is hit; with stamp, updated rows get it as updated_at."""
    out = update_where(target, condition, values)
    if out.filter("updated").isEmpty():
        raise LookupError("no row to update")
    if stamp:
        out = out.withColumn("updated_at", F.when(F.col("updated"), F.lit(stamp).cast("timestamp")).otherwise(F.col("updated_at")))
    return out


def fill_products(target: DataFrame, source: DataFrame, key: str, columns: list[str], quality: str, mode: str = "documented") -> DataFrame:
    """Known keys of target with columns of source(key, columns, quality), one row a key; new keys are not added.

    mode documented: only what target lacks is filled; as_written: what source has replaces. Blank texts are lacking. The
    greater quality counts, null as 0.
    """
    s = source.groupBy(key).agg(F.min(F.struct(*columns, quality)).alias("_s"))
    text = lambda c: dict(target.dtypes)[c] == "string"
    has = lambda x, c: F.nullif(x, F.lit("")) if text(c) else x
    mine, theirs = (lambda c: has(F.col(c), c)), (lambda c: has(F.col(f"_s.{c}"), c))
    value = lambda c: F.coalesce(*((mine(c), theirs(c)) if mode == "documented" else (theirs(c), F.col(c))))
    best = F.greatest(F.coalesce(quality, F.lit(0)), F.coalesce(f"_s.{quality}", F.lit(0)))
    hit = F.col("_s").isNotNull()
    new = {c: F.when(hit, value(c)).otherwise(F.col(c)) for c in columns} | {quality: F.when(hit, best).otherwise(F.col(quality))}
    return target.join(s, key, "left").select(*[new.get(c, F.col(c)).alias(c) for c in target.columns])


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    return target.filter(~F.coalesce(condition, F.lit(False)))


def backfill(target: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Fills null columns from others."""
    return target.select(*[F.coalesce(c, pairs[c]).alias(c) if c in pairs else F.col(c) for c in target.columns])


def add_counts(target: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """Adds each key's number of events to its counter."""
    n = events.groupBy(key).agg(F.count("*").alias("_n"))
    return target.join(n, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).select(target.columns)


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def newest_per_key(df: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """The row of each key with the greatest values of `newest`, in that order, then of its other columns.

    It aggregates before it shuffles, so a key with very many rows costs a row a task.
    """
    rest = [c for c in df.columns if c not in key and c not in newest]
    last = df.groupBy(*key).agg(F.max(F.struct(*newest, *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in df.columns])


def sync_plan(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and op: insert, keep or delete, by one full outer join."""
    o, n = old.select(*key).distinct().withColumn("_o", F.lit(1)), new.select(*key).distinct().withColumn("_n", F.lit(1))
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("keep")
    return o.join(n, key, "full_outer").select(*key, op.alias("op"))


def replace_snapshot(held: DataFrame, fresh: DataFrame, store: str, key: str) -> DataFrame:
    """Another store's snapshot replaces all; the same store's rows are put by key, and others of it stay."""
    stays = held.join(fresh.select(store).distinct(), store, "left_semi").join(fresh, [store, key], "left_anti")
    return fresh.unionByName(stays.select(fresh.columns))


def write_snapshot(held_at: str, fresh: DataFrame, store: str, key: str, groups: int | None = None) -> None:
    """Puts the rows of the stores that fresh names into a table kept by store, and rewrites those stores' files only.

    A named store's held rows stay unless fresh has their key; of rows that repeat a key in fresh, the one with the
    greatest values counts. Rows without store or key are left out. Other stores' files are neither read nor touched. The
    first call makes the table; later ones must have its columns.

    A folder a store is too much for very many stores. groups keeps so many groups of stores instead, by a hash of the
    store, and rewrites those of the named stores; read_snapshot then leaves the group out. All calls must name the same
    number.
    """
    spark = fresh.sparkSession
    part = store if groups is None else f"{store}_of_{groups}"
    named = fresh.filter(F.col(store).isNotNull() & F.col(key).isNotNull())
    if groups is not None:
        named = named.withColumn(part, F.pmod(F.xxhash64(F.col(store).cast("string")), F.lit(groups)).cast("int"))
    new = named.withColumn("_new", F.lit(True))
    if exists(spark, held_at):
        if (kept_by := partition_column(spark, held_at)) not in (None, part):
            raise ValueError(f"{held_at} is kept by {kept_by}, not by {part}")
        held = spark.read.schema(named.schema).parquet(held_at)
        touched = named.select(part).distinct()
        # groups are few: their numbers choose the folders to read
        stays = held.join(touched, part, "left_semi") if groups is None else held.filter(F.col(part).isin([r[0] for r in touched.collect()]))
        new = new.unionByName(stays.withColumn("_new", F.lit(False)))
    new = newest_per_key(new, [store, key], ["_new"]).drop("_new")
    # rebalance cuts what a large store or group has into several files
    new.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(held_at)


def read_snapshot(spark: SparkSession, held_at: str, schema: StructType) -> DataFrame:
    """The columns of a schema of a table that write_snapshot keeps."""
    return spark.read.schema(schema).parquet(held_at).select(schema.names)
