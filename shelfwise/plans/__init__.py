"""Catalog tables read off the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources import read_table

AS_OF = "2024-01-31 00:00:00"


def scans(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read_table(spark, folder, "events").select(
        "event_id", "user_id", (F.col("user_id") % 10).alias("store_id"), ((F.col("user_id") * 7 + k * 13) % 260).alias("ean"),
        F.col("ts").alias("scanned_at"), F.col("event_type").alias("status"), "value",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("ean"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        (F.col("p_size") * 2).alias("quality"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 10).alias("is_active"),
    )


def stock(spark: SparkSession, folder: str) -> DataFrame:
    """Products of each store: lowest unit price, and the state of the latest delivery."""
    latest = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"))["l_returnflag"]
    return (
        read_table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("ean"))
        .agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), latest.alias("_flag"))
        .select("store_id", "ean", "price", F.when(F.col("_flag") == "R", "out_of_stock").otherwise("in_stock").alias("stock_status"))
    )


def cached(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ean"), F.col("o_orderpriority").alias("name"))
