"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session, as in tests, may leave that unset and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_record: list[str] | None = None


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _record is not None:
        _record.append(path)
    return path


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Adds the folders that steps write meanwhile to paths, so that release can delete them later."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def release(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Deletes folders that were recorded, but for those that keep reads, and takes them off paths."""
    held = keep.inputFiles() if paths else []
    for path in list(paths):
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in held):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            paths.remove(path)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only tasks of the step that runs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of 1,000 rows at most, as texts may be long; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key():
    """A row's key where ids may be null or reused: a hash of doc_id and text, alike for copies of both only."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("doc_id"), F.col("text"))


def ascii_lower(col):
    """Lower-case A-Z only, as the contracts define it."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node reachable.

    Repeated contraction: each node moves to its smallest neighbour's smallest neighbour, edges follow and
    shrink. Every step aggregates with map-side combine and is written to the shared folder.
    """
    e = materialise(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .distinct(),
        "cc-edges",
    )
    labels = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("component", F.col("node"))
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = materialise(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "cc-parent")
        labels = materialise(
            labels.join(parent.withColumnRenamed("u", "component"), "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")
            ),
            "cc-labels",
        )
        pu = parent.select("u", F.col("p").alias("pu"))
        pv = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = materialise(
            e.join(pu, "u", "left")
            .join(pv, "v", "left")
            .select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
            .filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct(),
            "cc-edges",
        )
    return labels
