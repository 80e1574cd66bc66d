"""An inverted-file index for approximate vector search by cosine similarity.

Coarse centroids are fitted on a bounded sample; every vector lies in the list of its nearest centroid, and a query looks
into the lists of its nearest few. Lists are cut into slices of bounded size, so a list may hold any share of the rows.
Similarities of what is found are exact; what may be missed are neighbours in lists that a query did not look into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.retrieval import nearest_to_each

#: Vectors of a slice and queries of a block that one task holds at a time.
SLICE, BLOCK = 20_000, 2_000
#: Rows of the sample that centroids are fitted on, lists at most, queries by which the number of probes is chosen.
SAMPLE, MOST_LISTS, TUNING = 20_000, 4_096, 200
#: The list of what no query can find: null and zero vectors, and those of another dimension.
NOWHERE = -1


def _unit(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given width as unit vectors, and which rows are such vectors."""
    ok = np.array([v is not None and len(v) == width and None not in v for v in rows], bool)
    m = np.zeros((len(rows), width))
    if ok.any():
        m[ok] = [v for v, good in zip(rows, ok) if good]
    norm = np.linalg.norm(m, axis=1)
    ok &= np.isfinite(norm) & (norm > 0)
    m[ok] /= norm[ok, None]
    return m, ok


def fit_centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on the `sample` rows of the smallest hash of vec_id; fewer centroids where rows are few.

    The width is that of most of the sample.
    """
    rows = [r[0] for r in vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()]
    widths = [len(r) for r in rows]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    m, ok = _unit(rows, width)
    m = np.unique(m[ok], axis=0)
    centroids = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)] if len(m) else np.zeros((0, width))
    for _ in range(rounds if len(centroids) else 0):
        at = np.argmax(m @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def _near_lists(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """vec_id, embedding, list, nth of the nearest `probes` lists of each vector; NOWHERE for what has none."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        c = held.value
        for b in batches:
            rows = b.column("embedding").to_pylist()
            m, ok = _unit(rows, c.shape[1])
            order = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :probes] if len(c) else np.zeros((len(rows), 0), int)
            lists = [order[i].tolist() if ok[i] and len(c) else [NOWHERE] for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "embedding", "lists"])

    element = vectors.schema["embedding"].dataType.simpleString()
    found = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, embedding {element}, lists array<int>")
    return found.select("vec_id", "embedding", F.posexplode("lists").alias("nth", "list"))


@dataclass
class VectorIndex:
    """Centroids, and a table of list, vec_id, embedding that holds every row."""

    centroids: np.ndarray
    entries: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Of vectors(vec_id, embedding); by default with as many lists as the root of the rows, MOST_LISTS at most."""
        lists = lists or max(1, min(MOST_LISTS, round(vectors.count() ** 0.5)))
        return cls(fit_centroids(vectors, lists, sample), vectors).reassigned(vectors)

    def reassigned(self, vectors: DataFrame) -> VectorIndex:
        return VectorIndex(self.centroids, _near_lists(vectors, self.centroids, 1).select("list", "vec_id", "embedding"))

    def write(self, path: str) -> None:
        """The index below a path, a folder a list, so that a search reads only the lists it looks into."""
        spark = self.entries.sparkSession
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        self.entries.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/entries")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # MOST_LISTS at most
        width = len(rows[0]["centroid"]) if rows else 0
        return cls(np.array([r["centroid"] for r in rows]).reshape(len(rows), width), spark.read.parquet(f"{path}/entries"))

    def add(self, path: str, vectors: DataFrame) -> None:
        """Appends vectors to the written index; the centroids stay."""
        self.reassigned(vectors).entries.write.mode("append").partitionBy("list").parquet(f"{path}/entries")

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, most: int = TUNING) -> int:
        """The fewest lists to look into so that of `most` queries at most this share of exact neighbours is found."""
        asked = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(most)
        exact = nearest_to_each(self.entries, asked, k).select(F.col("query_id").alias("q"), "vec_id")
        home = self.entries.select("vec_id", "list").join(exact, "vec_id")
        order = _near_lists(asked, self.centroids, len(self.centroids)).select(F.col("vec_id").alias("q"), "nth", "list")
        places = {r["nth"]: r["count"] for r in home.join(order, ["q", "list"]).groupBy("nth").count().collect()}
        total, seen = sum(places.values()), 0
        for nth in range(len(self.centroids)):
            seen += places.get(nth, 0)
            if seen >= recall * total:
                return nth + 1
        return max(1, len(self.centroids))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, place, vec_id, similarity: the k nearest of each of queries(vec_id, embedding), itself left out.

        Slices of a list meet blocks of the queries that look into it, both of bounded size; each meeting keeps k a
        query. Ties by vec_id. Queries without a direction, or of another width, find nothing.
        """
        wanted = _near_lists(queries, self.centroids, probes).filter(F.col("list") != NOWHERE).select("list", F.col("vec_id").alias("query_id"), "embedding")
        slices = self.entries.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row a list
        blocks = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        plan = F.broadcast(slices.join(blocks, "list"))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.entries.join(plan, "list").withColumn("slice", deal("vec_id", "slices")).withColumn("block", every("blocks")).select("list", "slice", "block", "vec_id", "embedding")
        right = wanted.join(plan, "list").withColumn("block", deal("query_id", "blocks")).withColumn("slice", every("slices")).select("list", "slice", "block", "query_id", "embedding")
        width = self.centroids.shape[1]

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            found: list[list] = [[], [], []]
            names, asked = a["vec_id"].to_numpy(), b["query_id"].to_pylist()
            m, _ = _unit(a["embedding"].to_pylist(), width)
            q, _ = _unit(b["embedding"].to_pylist(), width)
            for query, s in zip(asked, q @ m.T):
                at = np.flatnonzero(names != query)
                best = at[np.lexsort((names[at], -s[at]))[:k]]
                for c, v in zip(found, ([query] * len(best), names[best].tolist(), s[best].tolist())):
                    c.extend(v)
            return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "similarity": pa.array(found[2], pa.float64())})

        keys = ("list", "slice", "block")
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, similarity double")
        place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        return met.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).select("query_id", "place", "vec_id", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the pairs (query_id, vec_id) of exact that found has."""
    pairs = exact.select("query_id", "vec_id").distinct()
    hits = pairs.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, pairs.count())
