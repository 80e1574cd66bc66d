"""Target-distribution importance resampling of documents.

Each document's word features (runs of one and two words) are counted in hashed buckets. The sparse document-by-bucket
matrix is written once, as blocks of compressed sparse rows. Its column sums are the corpus's distribution; with the
target's they give each bucket a gain, and the matrix times the gains gives each document's weight. Gumbel noise from
a hash of the id turns the weights into scores, of which the highest are a draw without replacement.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import fresh, new_path

#: Words are runs of these bytes, A-Z as a-z: digits, letters, and all of any character beyond ASCII.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)

#: Bytes up to which a word's crc32 is computed for many words at once; longer words are taken one by one.
_LONG = 40
BLOCK = "doc_id array<bigint>, n_words array<int>, ends binary, buckets binary, counts binary"


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_T = _byte_table()


def _shifts() -> np.ndarray:
    """What n zero bytes make of each byte of a crc32, for n up to _LONG: crc32 is linear."""
    out = np.empty((_LONG + 1, 4, 256), np.uint32)
    out[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)]
    for n in range(_LONG):
        out[n + 1] = _T[out[n] & 0xFF] ^ (out[n] >> 8)
    return out


_SHIFT = _shifts()


def crc_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[s:e] for each pair."""
    size = e - s
    order = np.argsort(-size, kind="stable")
    at, left = s[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32)
    for j in range(min(_LONG, int(left[0]) if len(left) else 0)):
        k = int(np.searchsorted(-left, -j, "left"))  # words longer than j
        state[:k] = _T[(state[:k] ^ data[at[:k] + j]) & 0xFF] ^ (state[:k] >> 8)
    out = np.empty(len(s), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[s[i] : e[i]])
    return out


def crc_pairs(data: np.ndarray, s: np.ndarray, e: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each word, a space and the next word, from the words' own."""
    spaced = ~crc[:-1]
    spaced = ~(_T[(spaced ^ np.uint32(0x20)) & 0xFF] ^ (spaced >> 8))
    size = (e - s)[1:]
    n = np.minimum(size, _LONG)
    out = crc[1:].copy()
    for b in range(4):
        out ^= _SHIFT[n, b, (spaced >> np.uint32(8 * b)) & 0xFF]
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[s[i + 1] : e[i + 1]], zlib.crc32(b" ", int(crc[i])))
    return out


def feature_rows(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the sparse rows of its feature counts: row ends, buckets, counts."""
    data, off = tk.flat(texts)
    data = _FOLD[data]
    s, e, first = tk.word_bounds(data, off)
    n_words, rows = np.diff(first), len(texts)
    row = np.repeat(np.arange(rows), n_words)
    crc = crc_words(data, s, e)
    key = row * buckets + (crc % np.uint32(buckets)).astype(np.int64)
    if len(s) > 1:
        pair = crc_pairs(data, s, e, crc)[row[1:] == row[:-1]]
        key = np.concatenate([key, row[1:][row[1:] == row[:-1]] * buckets + (pair % np.uint32(buckets)).astype(np.int64)])
    cell, counts = np.unique(key, return_counts=True)
    ends = np.searchsorted(cell, (np.arange(rows) + 1) * buckets)
    return n_words, ends, cell % buckets, counts


def count_matrix(docs: DataFrame, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document-by-bucket count matrix in blocks of about 1 MB of text, written to the shared folder and reread.

    A block holds its documents' ids and numbers of words, and the rows' ends, buckets and counts as little-endian
    unsigned 32-bit integers. Null and empty texts are empty rows.
    """
    spark = docs.sparkSession

    def run(batches):
        little = lambda x: x.astype("<u4").tobytes()
        one_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for batch in batches:
            for b in tk.chunks(batch, "text"):
                n_words, ends, cols, counts = feature_rows(b.column("text"), buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        one_list(b.column("doc_id").cast(pa.int64())), one_list(pa.array(n_words.astype(np.int32))),
                        *[pa.array([little(x)], pa.binary()) for x in (ends, cols, counts)],
                    ],
                    ["doc_id", "n_words", "ends", "buckets", "counts"],
                )

    path = new_path(spark, "count-matrix")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def column_sums(matrix: DataFrame, buckets: int) -> list[int]:
    """Sum of each bucket's column: summed in each task, then by bucket. The driver gets a number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for cols, counts in zip(b.column("buckets"), b.column("counts")):
                cols, counts = (np.frombuffer(x.as_buffer(), "<u4") for x in (cols, counts))
                total += np.bincount(cols, counts, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of the ratio of each bucket's smoothed share in target to that in source."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(source, target)]


def weights(matrix: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, a floored mean over a document's features."""
    schema = "doc_id long, n_words int, n_features long, weight long"

    def run(batches):
        g = np.array(gain, np.int64)
        for b in batches:
            for ids, n_words, *parts in zip(*(b.column(i) for i in range(5))):
                ends, cols, counts = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in parts)
                bounds = np.concatenate([[0], ends])
                sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (counts, counts * g[cols])]
                n, total = np.diff(sums[0]), np.diff(sums[1])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, schema)


def _ranked(drawn: DataFrame) -> DataFrame:
    """The rows with their ranks by score descending, then doc_id.

    Ranges of the order are sorted apart and numbered on from the rows of the ranges before; only a count a range meets
    in one place.
    """
    spark = drawn.sparkSession
    path = new_path(spark, "score-order")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ = drawn.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # an id's upper bits are the range it was sorted in, its lower 33 the place there
    sorted_.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    start, before = {}, 0
    for r in sorted(placed.groupBy("_range").count().collect()):
        start[r["_range"]], before = before, before + r["count"]
    offsets = spark.createDataFrame(list(start.items()) or [(0, 0)], "_range long, _start long")
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "_range").withColumn("rank", rank).drop("_at", "_range", "_start")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10000, percent: int = 25, min_words: int = 20, seed: str = "7", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs; target's texts are the aim.

    A percent of the rows of at least min_words words are drawn, those of the highest scores; ties go to the smaller
    id, null ids last, and rows of equal score and id in either order. Null and empty texts have no features and weigh
    0. Rows that share an id are each weighed by their own text. Empty docs give no rows; an empty target weighs all
    buckets by docs alone. Other columns are not read. A very long text is the work of one task.
    """
    matrix = count_matrix(docs, buckets, id_col, text_col)
    wanted = target.withColumn(fresh(target, "_none"), F.lit(None).cast("long"))
    aim = count_matrix(wanted, buckets, fresh(target, "_none"), target_col)
    weighed = weights(matrix, gains(column_sums(matrix, buckets), column_sums(aim, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    spark = docs.sparkSession
    path = new_path(spark, "scores")
    weighed.withColumn("score", F.col("weight") + noise).write.parquet(path)
    scored = spark.read.parquet(path)
    eligible = scored.filter(F.col("n_words") >= min_words)
    most = percent * eligible.count() // 100
    ranked = _ranked(eligible).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).union(short.select(out))
