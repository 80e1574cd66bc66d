"""Long enrichment runs that go on where they were broken off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.work import exists

MANIFEST = "batch int, items long, rows long, errors long"


class ResumableRun:
    """A run over items in numbered batches, below one folder.

    The first start writes the items there, dealt into batches by a hash of their key; later starts read those, whatever
    has become of the source. A batch's rows are a folder of their own, and an entry in the manifest, written after it,
    commits it. A start does the batches that the manifest lacks; rows of a batch that was broken off are replaced. What
    the run returns are rows of committed batches only. One start at a time may write to a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, batches: int = 100):
        self.spark, self.folder, self.batches = spark, folder.rstrip("/"), batches

    def _deal(self, items: DataFrame, key: str) -> None:
        done = f"{self.folder}/items/_SUCCESS"
        if not exists(self.spark, done):
            number = F.pmod(F.xxhash64(key), F.lit(self.batches)).cast("int")
            items.withColumn("batch", number).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{self.folder}/items")

    def manifest(self) -> DataFrame:
        """batch, items, rows, errors of each committed batch."""
        entries = [f"{self.folder}/manifest/{b:05d}" for b in self.committed()]
        return self.spark.read.schema(MANIFEST).parquet(*entries) if entries else self.spark.createDataFrame([], MANIFEST)

    def committed(self) -> list[int]:
        return [b for b in range(self.batches) if exists(self.spark, f"{self.folder}/manifest/{b:05d}/_SUCCESS")]

    def start(self, items: DataFrame, key: str, enrich: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
        """Does the batches that are left, `most` of them at most; how many. enrich's rows have an error column or none.

        Each batch is a Spark job over its own items, and a batch without items is committed with no rows.
        """
        self._deal(items, key)
        before = set(self.committed())
        left = [b for b in range(self.batches) if b not in before][:most]
        schema = items.schema
        for b in left:
            place = f"{self.folder}/items/batch={b}"
            batch = self.spark.read.schema(schema).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], schema)
            rows = f"{self.folder}/rows/{b:05d}"
            enrich(batch).write.mode("overwrite").parquet(rows)
            written = self.spark.read.parquet(rows)
            errors = F.count("error") if "error" in written.columns else F.lit(0)
            n = batch.count()
            entry = written.agg(F.count("*").alias("rows"), errors.cast("long").alias("errors")).select(F.lit(b).alias("batch"), F.lit(n).cast("long").alias("items"), "rows", "errors")
            entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{b:05d}")
        return len(left)

    def rows(self) -> DataFrame:
        """Rows of all committed batches."""
        paths = [f"{self.folder}/rows/{b:05d}" for b in self.committed()]
        if not paths:
            raise ValueError("no batch is committed yet")
        return self.spark.read.parquet(*paths)

    def report(self) -> DataFrame:
        """total and committed batches, items, rows, errors."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "rows", "errors")]
        return self.manifest().agg(F.lit(self.batches).alias("batches"), F.count("*").alias("committed"), *sums)
