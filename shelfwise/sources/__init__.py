"""Readers and writers of the formats that catalogs come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.functions.text import strip


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters chosen later reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzip or not, without the malformed ones. gzip can't be split: partitions deals its rows out."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.repartition(partitions) if partitions else df


def read_envelope(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Items (a DDL struct) of a JSON document that keeps them in one field."""
    return spark.read.schema(f"{field} array<struct<{item}>>").option("multiLine", True).json(path).select(F.inline(field))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A list of barcodes, one a line; blank lines and # comments go."""
    return spark.read.text(path).select(F.trim("value").alias("ean")).filter("ean <> '' and not startswith(ean, '#')")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source_file and content of all Markdown files below a path."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return df.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A CSV price list with a header: ean, price, shelf."""
    return spark.read.option("header", True).schema("ean string, price int, shelf string").csv(path)


def resume(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key an earlier run has not finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def spec_map(html: str) -> Column:
    """Term to definition of a page's specification list, both trimmed; of repeated terms the last counts.

    A term is the text before </dt>, in a span or not; a definition with markup inside is none.
    """
    pattern = F.lit(r"([^<>]+)(?:</span>)?</dt>\s*<dd[^>]*>([^<>]+)</dd>")
    terms = F.transform(F.regexp_extract_all(html, pattern, 1), strip)
    values = F.transform(F.regexp_extract_all(html, pattern, 2), strip)
    last = F.filter(F.arrays_zip(terms.alias("k"), values.alias("v")), lambda x: x["k"] != "")
    return F.aggregate(last, F.create_map().cast("map<string,string>"), lambda a, x: F.map_concat(F.map_filter(a, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))


def read_catalog(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A catalog kept as one JSON array, without the rows that have no code."""
    return spark.read.schema(schema).option("multiLine", True).json(path).filter("ean is not null and ean <> ''")


# The names under which search services return one field.
FOUND_AS = {"ean": ["ean", "EAN", "barcode", "gtinUpc"], "name": ["name", "title", "description"], "brand": ["brand", "brandName", "brandOwner"]}


def found_items(pages: DataFrame, items: str) -> DataFrame:
    """ean, name, brand of each item in an array of maps; each field by the first name under which it is not blank."""
    one = pages.select(F.explode(items).alias("_item"))
    get = lambda names: F.coalesce(*[F.nullif(F.try_element_at("_item", F.lit(n)), F.lit("")) for n in names])
    return one.select(*[get(names).alias(c) for c, names in FOUND_AS.items()])


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
