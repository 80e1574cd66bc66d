"""Chunking of Markdown and exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import strip


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, least: float | None = None, over_fetch: int = 1) -> DataFrame:
    """The k vectors of the greatest similarity; of k * over_fetch fetched, those of at least `least`. Ties by vec_id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.filter(where) if where is not None else vectors
    found = found.filter(F.size("embedding") == len(query)).withColumn("similarity", cosine(F.col("embedding"), q))
    top = found.orderBy(F.desc_nulls_last("similarity"), "vec_id").limit(k * over_fetch)
    if least is not None:
        top = top.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k)
    return top


#: Vectors and queries that one task holds at a time, and similarities that it computes at once.
SLICE, BLOCK, CELLS = 50_000, 2_000, 4_000_000


def _by_width(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a table(vec_id, embedding), as matrices by dimension; those without one are left out."""
    ids, column, out = t["vec_id"].to_numpy(), t["embedding"].combine_chunks(), {}
    widths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]):
        some = widths == width
        m = column.filter(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        with np.errstate(invalid="ignore", divide="ignore"):
            m /= np.linalg.norm(m, axis=1, keepdims=True)
        out[int(width)] = ids[some], m
    return out


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, place, vec_id, similarity: for each of queries(vec_id, embedding) the k nearest of vectors, itself left out.

    Exact. Slices of vectors meet blocks of queries, both of bounded size, as matrices; each meeting keeps k a query.
    Zero vectors are near to none; vectors of another dimension than a query are not compared with it. Ties by vec_id.
    """
    n_slices, n_blocks = (-(-max(df.count(), 1) // size) for df, size in ((vectors, SLICE), (queries, BLOCK)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(deal(n_slices).alias("slice"), every(n_blocks).alias("block"), "vec_id", "embedding")
    right = queries.select(every(n_slices).alias("slice"), deal(n_blocks).alias("block"), "vec_id", "embedding")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        sides = _by_width(a)
        for width, (queries, q) in _by_width(b).items():
            names, m = sides.get(width, (None, None))
            step = max(1, CELLS // len(m)) if m is not None else len(q)
            for at in range(0, len(q) if m is not None else 0, step):
                with np.errstate(invalid="ignore"):
                    near = q[at : at + step] @ m.T
                for query, s in zip(queries[at : at + step].tolist(), near):
                    ok = np.flatnonzero(np.isfinite(s) & (names != query))
                    if len(ok) > k:  # all that may be among the first k, ties included
                        ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
                    best = ok[np.lexsort((names[ok], -s[ok]))[:k]]
                    for c, v in zip(found, ([query] * len(best), names[best].tolist(), s[best].tolist())):
                        c.extend(v)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "similarity": pa.array(found[2], pa.float64())})

    met = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(meet, "query_id long, vec_id long, similarity double")
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).select("query_id", "place", "vec_id", "similarity")


def heading_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a section: key, section, heading, content. Headings of level 1 to 3 start one; blank sections go."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?m)(?=^#{1,3}\s)")).alias("section", "content"))
    parts = parts.withColumn("content", F.trim(F.regexp_replace("content", r"^\n+|\n+$", ""))).filter("content <> ''")
    heading = F.regexp_extract("content", r"^#{1,3}\s+([^\n]*)", 1)
    return parts.select(key, "section", heading.alias("heading"), "content")


def paragraph_chunks(sections: DataFrame, key: list[str], text: str, limit: int = 500) -> DataFrame:
    """Sections over limit tokens (a quarter of their characters) split at blank lines; others stay as they are.

    Tokens are added up by paragraph. Each chunk after the first begins with the two paragraphs that ended the one
    before it; one paragraph is never split. The fold carries places only, and one entry a finished chunk.
    """
    parts = F.filter(F.split(text, r"\n\n+"), lambda p: p != "")
    tokens = lambda n: F.ceil(n / 4).cast("int")
    first = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("done"), *[F.lit(0).alias(c) for c in ("at", "i", "tokens", "last", "before")])

    def step(a: Column, p: Column) -> Column:
        n = F.length(p)
        full = (a["tokens"] + tokens(n) > limit) & (a["i"] > a["at"])
        two = a["i"] - a["at"] > 1
        carried = tokens(a["last"] + F.when(two, a["before"] + 2).otherwise(0))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.struct(a["at"].alias("at"), (a["i"] - a["at"]).alias("n"))))).otherwise(a["done"]).alias("done"),
            F.when(full, a["i"] - F.when(two, 2).otherwise(1)).otherwise(a["at"]).alias("at"),
            (a["i"] + 1).alias("i"),
            F.when(full, carried + tokens(n)).otherwise(a["tokens"] + tokens(n)).alias("tokens"),
            n.alias("last"),
            a["last"].alias("before"),
        )

    ends = F.aggregate(parts, first, step, lambda a: F.when(a["i"] > a["at"], F.concat(a["done"], F.array(F.struct(a["at"].alias("at"), (a["i"] - a["at"]).alias("n"))))).otherwise(a["done"]))
    cut = sections.select(*key, F.col(text).alias("_t"), parts.alias("_parts"), ends.alias("_ends"))
    cut = cut.withColumn("_ends", F.when(F.ceil(F.length("_t") / 4) <= limit, F.array(F.struct(F.lit(0).alias("at"), F.lit(-1).alias("n")))).otherwise(F.col("_ends")))
    rows = cut.select(*key, "_t", "_parts", F.posexplode_outer("_ends").alias("chunk", "_c")).filter("_c is not null")
    content = F.when(F.col("_c.n") < 0, F.col("_t")).otherwise(strip(F.array_join(F.slice("_parts", F.col("_c.at") + 1, F.greatest(F.col("_c.n"), F.lit(0))), "\n\n")))
    return rows.select(*key, "chunk", content.alias("content"))
