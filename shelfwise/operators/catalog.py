"""Catalog operators: cascades, overlays, searches, alternatives and row security."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.barcodes import is_valid_ean
from shelfwise.functions.products import reference_kind


def cascade(keys: DataFrame, tiers: list[tuple[str, DataFrame]], on: list[str], order: list[str], missing: str = "not_found", single: tuple[str, ...] = ()) -> DataFrame:
    """Resolves each key by the first tier that holds it.

    tiers: (status, frame with the columns of `on` that it knows and a column payload), best first. One row a key:
    the key, found_status, payload. A tier may know fewer key columns than `on`; ties within a tier go by `order`.
    single: tiers in which a key with several rows counts as unknown.
    """
    hits = []
    for rank, (status, frame) in enumerate(tiers):
        known = [c for c in on if c in frame.columns]
        # one row a key before the join, so that no key multiplies; it aggregates map-side, and nothing is sorted
        best = F.min(F.struct(*[c for c in order if c in frame.columns], F.col("payload").alias("_payload"))).alias("_best")
        one = frame.groupBy(*known).agg(best, F.count("*").alias("_count"))
        one = (one.filter("_count = 1") if status in single else one).select(*known, F.col("_best._payload").alias("payload"))
        hits.append(keys.join(one, known).select(*on, F.lit(rank).alias("_rank"), F.lit(status).alias("found_status"), "payload"))
    every = hits + [keys.select(*on, F.lit(len(tiers)).alias("_rank"), F.lit(missing).alias("found_status"), F.lit(None).cast("string").alias("payload"))]
    # min over structs aggregates map-side: no key's rows meet in a window
    first = reduce(DataFrame.unionByName, every).groupBy(*on).agg(F.min(F.struct("_rank", "found_status", "payload")).alias("_hit"))
    return first.select(*on, "_hit.found_status", "_hit.payload")


def by_alternate(frame: DataFrame, key: str, codes: str) -> DataFrame:
    """frame once for each of its other codes, which take the key's place."""
    return frame.select(*[c for c in frame.columns if c not in (key, codes)], F.explode(F.array_distinct(codes)).alias(key))


def resolve_codes(
    keys: DataFrame,
    products: DataFrame,
    stock: DataFrame,
    local: DataFrame | None = None,
    demo: DataFrame | None = None,
    cache: DataFrame | None = None,
    external: DataFrame | None = None,
    offline: DataFrame | None = None,
    alternates: str = "alternate_eans",
) -> DataFrame:
    """Each of keys(store_id, ean) by the first source that has it, with found_status and payload.

    In order: the offline copy, where one is given; the store's own list; its stock, by code and by another code of
    the product; all products, likewise; the demo catalog; the cache; outside finds. products(id, ean, alternates,
    is_active, payload) and stock(store_id, ean, product_id, is_active) must have one row a code, or the code counts
    as unknown there; an inactive row is none. Stock brings its product's payload. Others: ean, payload, and store_id if
    they are a store's.
    """
    active = products.filter("is_active")
    sold = stock.filter("is_active").join(active.select(F.col("id").alias("product_id"), alternates, "payload"), "product_id")
    tiers = [("found_offline", offline), ("found_local", local), ("found_store", sold.select("store_id", "ean", "payload"))]
    tiers += [("found_store_alternate", by_alternate(sold.select("store_id", "ean", alternates, "payload"), "ean", alternates))]
    tiers += [("found_global", active.select("ean", "payload")), ("found_global_alternate", by_alternate(active.select("ean", alternates, "payload"), "ean", alternates))]
    tiers += [("found_demo", demo), ("found_cache", cache), ("found_external", external)]
    tables = ("found_store", "found_store_alternate", "found_global", "found_global_alternate", "found_cache")
    return cascade(keys, [(s, f) for s, f in tiers if f is not None], ["store_id", "ean"], [], single=tables)


def resolve_references(refs: DataFrame, by_id: DataFrame, by_code: DataFrame, by_demo: DataFrame) -> DataFrame:
    """ref, kind, payload of refs(ref): a demo id, a product's id or a code, each looked up where its kind says.

    by_id(id, payload), by_code(ean, payload), by_demo(demo_id, payload) have one row a key.
    """
    kind = reference_kind(F.col("ref"))
    bare = F.regexp_replace("ref", "^(?:gp|ean|demo):", "")
    r = refs.select("ref", kind.alias("kind")).withColumn("_bare", bare)
    for name, frame, key in (("demo", by_demo, "demo_id"), ("id", by_id, "id"), ("ean", by_code, "ean")):
        one = frame.select(F.lit(name).alias("kind"), F.col(key).alias("_bare"), F.col("payload").alias(f"_{name}"))
        r = r.join(one, ["kind", "_bare"], "left")
    return r.select("ref", "kind", F.coalesce("_demo", "_id", "_ean").alias("payload"))


def hydrate(refs: DataFrame, products: DataFrame, local: DataFrame, demo: DataFrame, cache: DataFrame) -> DataFrame:
    """refs(ref_id, product_id, ean) with source and payload: by product id, by code, then from the local, demo and cached products.

    products(id, ean, payload), others (ean, payload), one row a key. A code that nothing knows gets its placeholder,
    an id that nothing knows another; refs without both are left out, and of equal refs (by code, else id) the first.
    """
    key = F.coalesce(F.nullif("ean", F.lit("")), "product_id")
    one = refs.withColumn("_key", key).filter("_key is not null").groupBy("_key").agg(F.min(F.struct("ref_id", "product_id", "ean")).alias("r")).select("r.*")
    take = lambda f, k, name: f.select(F.col(k[0]).alias(k[1]), F.col("payload").alias(name))
    out = one.join(take(products, ("id", "product_id"), "_id"), "product_id", "left")
    for name, frame in (("_code", products), ("_local", local), ("_demo", demo), ("_cache", cache)):
        out = out.join(take(frame, ("ean", "ean"), name), "ean", "left")
    known = ["_id", "_code", "_local", "_demo", "_cache"]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), c[1:]) for c in known], F.lit("unknown"))
    name = F.coalesce(*known, F.concat(F.lit("Товар "), F.nullif("ean", F.lit(""))), F.lit("Неизвестный товар"))
    return out.select("ref_id", "product_id", "ean", source.alias("source"), name.alias("payload"))


def take_rows(df: DataFrame, n: int, when_zero: int | None = None) -> DataFrame:
    """The first n rows; 0 takes all, or when_zero of them."""
    n = n or when_zero or 0
    return df.limit(n) if n else df


def first_filled(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows, else the last; asks for one row of each."""
    for f in frames[:-1]:
        if not f.isEmpty():
            return f
    return frames[-1]


def one_of(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """df filtered by the columns whose value is set; 'all' and None set nothing."""
    for c, v in filters.items():
        if v is not None and v != "all":
            df = df.filter(F.col(c) == F.lit(v))
    return df


def blank(c: str) -> Column:
    """Null or an empty text."""
    return F.col(c).isNull() | (F.col(c) == "")


def needs_enrichment(df: DataFrame, missing: list[str], ean: str | None = None, placeholder: str = "kaspi_") -> DataFrame:
    """Rows where any of the columns is blank, or the code is a placeholder or not valid."""
    tests = [blank(c) for c in missing]
    if ean:
        tests.append(blank(ean) | F.col(ean).startswith(placeholder) | ~F.coalesce(is_valid_ean(F.col(ean)), F.lit(False)))
    return df.filter(reduce(lambda a, b: a | b, tests))


def contains_all(column: str, wanted: dict[str, str]) -> Column:
    """Whether a map column holds all wanted entries; nothing wanted holds always."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at(F.col(column), F.lit(k)) == F.lit(v), F.lit(False)) for k, v in wanted.items()], F.lit(True))


def overlay(base: DataFrame, over: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """base with columns taken from over where it has the key, and is_overlaid."""
    marked = over.select(*on, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base.join(marked, on, "left")
    return out.select(
        *[c for c in base.columns if c not in columns],
        *[F.coalesce(f"_o_{c}", *([c] if c in base.columns else [])).alias(c) for c in columns],
        F.coalesce("_hit", F.lit(False)).alias("is_overlaid"),
    )


def alternate_key_join(left: DataFrame, key: str, right: DataFrame, keys: str) -> DataFrame:
    """Equi-join of left.key with each element of right's array column keys."""
    return left.join(right.withColumn(key, F.explode(F.array_distinct(keys))), key)


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose columns, joined by blanks, hold the query literally, whatever the case; a blank query keeps all."""
    q = query.strip().lower()
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(q)) if q else df


def search_any(df: DataFrame, folded: list[str], exact: list[str], query: str) -> DataFrame:
    """Rows where any folded column (case ignored) or exact column holds the query; a blank query keeps all."""
    if not query.strip():
        return df
    q = query.lower()
    tests = [F.lower(c).contains(q) for c in folded] + [F.col(c).contains(q) for c in exact]
    return df.filter(reduce(lambda a, b: a | b, tests))


SORTS = {
    "cheap": lambda: [F.coalesce("price", F.lit(0.0)).asc()],
    "pricey": lambda: [F.coalesce("price", F.lit(0.0)).desc()],
    "rating": lambda: [F.coalesce("quality", F.lit(0)).desc()],
    "default": lambda: [F.col("fits").desc(), F.coalesce("quality", F.lit(0)).desc()],
}


def sort_catalog(df: DataFrame, mode: str, tie: str) -> DataFrame:
    """df in one of the catalog orders; tie keeps it stable."""
    return df.orderBy(*SORTS[mode](), F.col(tie).asc())


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= n)


def visible_rows(rows: DataFrame, owned: DataFrame, on: str) -> DataFrame:
    """Rows of stores that the caller owns."""
    return rows.join(owned.select(on).distinct(), on, "left_semi")


def split_checked(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with the names of the checks that failed; a null check passes."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    marked = df.withColumn("failed", failed)
    return marked.filter(F.size("failed") == 0).drop("failed"), marked.filter(F.size("failed") > 0)


def without_errors(rows: DataFrame, name: str = "name", error: str = "error") -> DataFrame:
    """Rows that have a name and no error; blank texts count as neither."""
    return rows.filter((F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(error), F.lit("")) == ""))
