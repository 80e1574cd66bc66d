"""From raw documents to token records, stage by stage."""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import fresh, materialise, recorded, release, row_key, table
from shelfwise.llm.decontaminate import remove_contaminated
from shelfwise.llm.jaccard_join import jaccard_components
from shelfwise.llm.mixing import mix
from shelfwise.llm.quality import keep_quality
from shelfwise.llm.queries import vocabulary
from shelfwise.llm.token_records import read_records, write_records

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None

#: Folders that stages of one run have left in the shared folder; stages that are called by themselves share a list.
_left: contextvars.ContextVar[list[str]] = contextvars.ContextVar("left", default=[])  # noqa: B039


def stage(f: Callable) -> Callable:
    """A stage that first deletes what stages before it have left: their results are its docs."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.get()
        release(spark, left, keep=docs)
        with recorded(left):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as they have under 20 words; each row is judged by itself, whatever its id.
    """
    return keep_quality(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingles of five words at a similarity of 0.8: that of the smallest id.

    Rows count by id and text, so rows that share an id, or have none, are told apart; copies of both are one row. Of a
    group, rows with an id come before rows without; ties by a hash. Texts without words are linked with nothing and stay.
    """
    columns, key = docs.columns, fresh(docs, "_row")
    docs = docs.withColumn(key, row_key())
    groups = jaccard_components(docs, k=5, num=8, den=10, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = docs.select(key, F.col("doc_id").isNull().alias("none"), "doc_id").distinct()
    first = groups.join(ids.hint("merge"), key).groupBy("component_id").agg(F.min(F.struct("none", "doc_id", key)).alias("first"))
    kept = docs.join(first.select(f"first.{key}").hint("merge"), key, "left_semi")
    # a second hash tells rows apart whose keys collide
    second = fresh(kept, "_second")
    return kept.withColumn(second, F.xxhash64(F.lit(2), "text", "doc_id")).dropDuplicates([key, second]).select(columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words on end of any benchmark item.

    Each row is judged by its own text, with null and reused ids too; null texts hold nothing and stay.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, each at least once.

    A null source is one of its own; null texts weigh nothing and are read once. The columns of documents have no room
    for a document's place in the mixture, so only how often it is read is carried on.
    """
    return mix(docs, target_entropy=0.98, max_epochs=2.0).select(docs.columns)


@stage
def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, read back: doc_id, start, n_tokens, ids_crc32.

    Rows lie in order of their ids, null first, and those that share one next to each other; null texts are empty.
    """
    return read_records(write_records(docs, vocabulary("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("mix_sources", mixture),
    ("token_records", records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = _left.set([])  # no other run's folders are deleted, nor this one's by another
    try:
        for name, step in STAGES[:-1]:
            docs = materialise(step(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _left.reset(before)
