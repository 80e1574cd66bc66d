"""Scan counts kept by day, from which figures of any period are added up instead of from all scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.work import exists

ROW = "store_id long, ean long, scans long, found long"


def by_day(scans: DataFrame) -> DataFrame:
    """day, store_id, ean, scans, found of scans(store_id, ean, scanned_at, status)."""
    return scans.groupBy(F.to_date("scanned_at").alias("day"), "store_id", "ean").agg(F.count("*").alias("scans"), F.count_if(F.col("status") != "error").alias("found"))


def in_periods(days: DataFrame, periods: list[tuple[str, int]]) -> DataFrame:
    """Rows of days once for each period (as_of, length in days) that they fall in; a period starts at as_of less its length.

    As with since(), later days count too. Periods are a short list; rows outside all go.
    """
    each = F.array(*[F.struct(F.lit(a).cast("date").alias("as_of"), F.lit(n).alias("days")) for a, n in periods])
    falls = F.filter(each, lambda p: F.col("day") >= F.date_sub(p["as_of"], p["days"]))
    return days.withColumn("_period", F.explode(falls)).select("*", "_period.as_of", "_period.days").drop("_period")


def metrics(days: DataFrame, periods: list[tuple[str, int]]) -> DataFrame:
    """as_of, days, store_id, scans, products, found. Products are counted on keys, so a period's days may share them."""
    of = in_periods(days, periods).groupBy("as_of", "days", "store_id", "ean").agg(F.sum("scans").alias("scans"), F.sum("found").alias("found"))
    return of.groupBy("as_of", "days", "store_id").agg(F.sum("scans").alias("scans"), F.count("*").alias("products"), F.sum("found").alias("found"))


class Dailies:
    """A table of daily counts in a folder, fed by batches.

    A batch's counts are a folder of their own, by day, which the same batch number replaces: a batch that is fed again,
    as a stream does after a failure, counts once. Events that come late add to their day. Reading sums what batches
    have of a key, and reads the asked days only; compact() sums them for good.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, scans: DataFrame, batch: int) -> None:
        by_day(scans.filter("scanned_at is not null")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/fed/batch={batch}")

    def feed(self, scans: DataFrame, checkpoint: str, once: bool = True):
        """Feeds a stream of scans; with once, what is there now."""
        writer = scans.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def days(self, since: str | None = None) -> DataFrame:
        """day, store_id, ean, scans, found; since drops days before it, whose files are not read."""
        rows = self._kept().unionByName(self._fed())
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date")) if since else rows
        return rows.groupBy("day", "store_id", "ean").agg(F.sum("scans").alias("scans"), F.sum("found").alias("found"))

    def _read(self, path: str, partitions: str) -> DataFrame:
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], f"{ROW}, {partitions}")
        return self.spark.read.schema(f"{ROW}, {partitions}").parquet(path)

    def _generations(self) -> list[int]:
        """Batches up to which counts were summed, as far as that was ended."""
        return [r["upto"] for r in self.spark.read.schema("upto int").parquet(f"{self.folder}/summed").collect()] if exists(self.spark, f"{self.folder}/summed") else []

    def _kept(self) -> DataFrame:
        last = max(self._generations(), default=None)
        path = f"{self.folder}/kept/upto-{last}"
        return self._read(path, "day date")

    def _fed(self) -> DataFrame:
        last = max(self._generations(), default=-1)
        return self._read(f"{self.folder}/fed", "batch int, day date").filter(F.col("batch") > last).drop("batch")

    def compact(self, upto: int) -> None:
        """Sums the counts of batches up to this number, which must all be fed; a last entry makes that count."""
        if upto in self._generations():
            return
        last = max(self._generations(), default=-1)
        fed = self._read(f"{self.folder}/fed", "batch int, day date").filter((F.col("batch") > last) & (F.col("batch") <= upto)).drop("batch")
        rows = self._kept().unionByName(fed).groupBy("day", "store_id", "ean").agg(F.sum("scans").alias("scans"), F.sum("found").alias("found"))
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/kept/upto-{upto}")
        self.spark.createDataFrame([(upto,)], "upto int").coalesce(1).write.mode("append").parquet(f"{self.folder}/summed")
