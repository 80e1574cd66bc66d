"""Exact n-gram Jaccard join by grouped prefixes.

Documents are sets of word shingles. Equal sets collapse to one class, classes with an equal prefix and size
to one group. Prefixes take the rarest shingles first, by a document-frequency sketch of fixed size, so that
passages which many documents share stay out of them. Group pairs are filtered by size and by the prefix
length that the pair's own overlap bound allows, then expanded to members. Member pairs are filtered by parity
sketches, a bit or two a shingle: bits that differ between two sketches are shingles that one set lacks, so a
pair with too many of them cannot link. Only what passes is verified on whole sets, of 64-bit shingle hashes.

Links are wanted as components: pairs whose members are already in one component are never formed. A first
round verifies each group against the two that share most prefix shingles with it, out of those that lead a
shingle's list (with the fewest shingles of their own), which connects families of copies at linear cost; a
second round takes every candidate pair that still lies in different components. Joins whose sides grow with
the corpus ask for sort-merge, so that plans and their memory are alike at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import bound_batches, connected_components, materialise

#: Counters of the document-frequency sketch: fixed, so what is broadcast never grows (1 byte a counter).
SKETCH_BITS = 21
SLICES = 128
#: Bits of the filter that says which documents have candidates: fixed as well.
FILTER_BITS = 1 << 24


def _hashes(batch: pa.RecordBatch, text_col: str, k: int):
    data, off = tk.flat(batch.column(text_col))
    s, e, first = tk.word_bounds(data, off)
    return tk.windows(tk.span_hash(data, s, e, tk.FOLDED), first, k)


def _sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """log2 of the approximate count of shingles in each of 2**SKETCH_BITS buckets, over all documents."""
    per = (1 << SKETCH_BITS) // SLICES

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for c in tk.chunks(b, text_col):
                g, _ = _hashes(c, text_col, k)
                np.add.at(total, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            cut = np.minimum(total, 65535).astype("<u2").reshape(SLICES, per)
            yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([x.tobytes() for x in cut], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1)):
                sums.setdefault(s, np.zeros(per, np.uint64))
                sums[s] += np.frombuffer(c.as_buffer(), "<u2")
        if sums:
            logs = [np.log2(v.astype(np.float64) + 1).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()), "logs": pa.array(logs, pa.binary())})

    out = np.zeros((SLICES, per), np.uint8)
    rows = docs.select(text_col).mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, logs binary")
    for r in rows.collect():  # SLICES rows of a fixed length
        out[r["slice"]] = np.frombuffer(r["logs"], np.uint8)
    return out.reshape(-1)


def _tokens(g: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Shingles as sorted distinct 63-bit numbers: rarity first, then 57 bits of the hash."""
    q = logs[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.unique((np.minimum(q, np.uint64(63)) << np.uint64(57)) | (tk.mix(g) >> np.uint64(7)))


def _pairs_ok(nx, ny, i, j, num: int, den: int):
    """Size filter, and the prefix that the pair's overlap bound allows. i, j: places of a shared shingle."""
    need = F.expr(f"cast(({num} * ({nx} + {ny}) + {num + den - 1}) div {num + den} as int)")
    big, small = F.greatest(nx, ny), F.least(nx, ny)
    return (small * den >= big * num) & (F.col(i) <= F.col(nx) - need) & (F.col(j) <= F.col(ny) - need)


def _parity(t: np.ndarray) -> bytes:
    """For each of 1 to 2 bits a token, whether an odd number of tokens falls on it; a power of two of bits."""
    bits = 1 << max(6, int(len(t)).bit_length())
    odd = np.bincount((tk.mix(t) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens that two sketches do not share; a larger sketch is folded first."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b), those that may link by their sketches(rep, n, parity)."""

    def keep(batches):
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            x, y = batch.column("pa"), batch.column("pb")
            d = np.array([_apart(x[i].as_buffer(), y[i].as_buffer()) for i in range(len(n))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((n - d) * (num + den) >= 2 * num * n))

    sa = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    sb = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    return pairs.join(sb.hint("merge"), "b").join(sa.hint("merge"), "a").mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b), those whose whole sets link."""

    def overlap(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                both = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), "<u8") for v in (x, y)]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * common >= num * (len(both) - common):
                    keep.append(i)
            yield pa.record_batch({"src": pa.array(a[keep], pa.int64()), "dst": pa.array(b[keep], pa.int64())})

    sa = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("sa"))
    sb = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("sb"))
    return pairs.join(sb.hint("merge"), "b").join(sa.hint("merge"), "a").mapInArrow(overlap, "src long, dst long")


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when den * intersection >= num * union of their sets of k-word shingles (A-Z folded);
    component_id is the smallest id reachable by links. Null and wordless texts have an empty set and stand
    alone; fewer than k words are one shingle. Rows that repeat an id are that document each, with all links of any;
    a row with a null id takes the component of its class. An empty table gives none. Other columns are not read. A
    very long text is the work of one task.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _components(docs, k, num, den)
    # Where ids repeat, texts are the nodes, and those of one id are linked too.
    keyed = docs.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("text").isNull(), "text")))
    nodes = keyed.filter("node is not null").groupBy("node").agg(F.first("text").alias("text"))
    nodes = nodes.union(keyed.filter("node is null").select("node", "text")).withColumnRenamed("node", "doc_id")
    found = materialise(_components(nodes, k, num, den).withColumnsRenamed({"doc_id": "node", "component_id": "c"}), "nodes")
    rows = keyed.filter("node is not null").select("doc_id", "node").join(found.filter("node is not null").hint("merge"), "node")
    unnamed = found.filter("node is null").select(F.col("node").alias("doc_id"), "n_shingles", "c")
    rows = materialise(rows.select("doc_id", "n_shingles", "c").union(unnamed), "rows")
    full = rows.filter("n_shingles > 0")
    of = full.filter("doc_id is not null").select("doc_id", "c").distinct()
    same = of.join(of.groupBy("doc_id").agg(F.min("c").alias("dst")).hint("merge"), "doc_id").select(F.col("c").alias("src"), "dst")
    joined = connected_components(same).withColumnsRenamed({"node": "c", "component": "root"})
    full = full.join(joined.hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = full.join(least.hint("merge"), "root", "left").select("doc_id", "n_shingles", "component_id")
    return full.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The same of docs(doc_id, text) whose ids, where they are not null, do not repeat."""
    spark = docs.sparkSession
    bound_batches(spark)
    logs = spark.sparkContext.broadcast(_sketch(docs, "text", k))

    def sign(batches):
        for whole in batches:
            for b in tk.chunks(whole, "text"):
                g, first = _hashes(b, "text", k)
                n, digests, keys, prefixes, parities = [], [], [], [], []
                for x, y in zip(first[:-1], first[1:]):
                    t = _tokens(g[x:y], logs.value)
                    p = t[: len(t) - -(-num * len(t) // den) + 1] if len(t) else t
                    n.append(len(t))
                    digests.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest())
                    keys.append(hashlib.blake2b(p.tobytes(), digest_size=16).digest())
                    prefixes.append(p.astype(np.int64))
                    parities.append(_parity(t))
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").cast(pa.int64()),
                        "n": pa.array(n, pa.int32()),
                        "digest": pa.array(digests, pa.binary()),
                        "key": pa.array(keys, pa.binary()),
                        "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                        "parity": pa.array(parities, pa.binary()),
                    }
                )

    signed = materialise(docs.mapInArrow(sign, "doc_id long, n int, digest binary, key binary, prefix array<long>, parity binary"), "signed")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = materialise(some.groupBy("digest", "key", "n").agg(F.min("doc_id").alias("rep")), "classes")
    groups = classes.groupBy("key", "n").agg(F.min("rep").alias("gid"), F.count("*").alias("size"))
    groups = materialise(groups, "groups")
    crowd = groups.filter("size > 1").select("key", "n", "gid")
    crowd = materialise(classes.join(crowd, ["key", "n"]).select("gid", "rep"), "members")

    prefixes = some.select(F.col("doc_id").alias("gid"), "n", "prefix").join(groups.select("gid").hint("merge"), "gid", "left_semi")
    every = prefixes.select("gid", "n", F.posexplode("prefix").alias("i", "token"))
    # The leading group of each shared shingle, by aggregation: a shingle's list is never one task's, and AQE may split the join.
    leads = every.groupBy("token").agg(F.min(F.struct("i", "n", "gid")).alias("l"), F.count("*").alias("many")).filter("many > 1")
    leads = leads.select("token", F.col("l.gid").alias("g2"), F.col("l.n").alias("n2"), F.col("l.i").alias("i2"))
    posts = materialise(every.join(leads.hint("merge"), "token"), "posts")
    # First round: of the leading groups of its shingles, each group meets the two that share most of them.
    first = posts.filter(_pairs_ok("n", "n2", "i", "i2", num, den) & (F.col("gid") != F.col("g2")))
    most = Window.partitionBy("gid").orderBy(F.desc("shared"), "g2")
    first = first.groupBy("gid", "g2").agg(F.count("*").alias("shared")).withColumn("place", F.row_number().over(most)).filter("place <= 2")
    first = first.select(F.least("gid", "g2").alias("ga"), F.greatest("gid", "g2").alias("gb")).distinct()

    def near_first(pairs):
        """Of group pairs and of groups with several members, each member against the other, or own, group's first."""
        one = crowd.select(F.col("gid").alias("ga"), F.col("rep").alias("ma"))
        two = crowd.select(F.col("gid").alias("gb"), F.col("rep").alias("mb"))
        pairs = pairs.join(one, "ga", "left").select("ga", "gb", F.coalesce("ma", "ga").alias("ma"))
        a = pairs.select(F.col("ma").alias("a"), F.col("gb").alias("b"))
        b = pairs.filter("ma = ga").join(two, "gb").select(F.col("ga").alias("a"), F.col("mb").alias("b"))
        return a.union(b).union(crowd.select(F.col("gid").alias("a"), F.col("rep").alias("b"))).filter("a <> b").distinct()

    def kinds_of(labels):
        """Members of groups of several by component, and the groups, with themselves, whose members lie in several."""
        of = labels.select(F.col("node").alias("rep"), "component")
        held = crowd.join(of, "rep", "left").select("gid", "rep", F.coalesce("component", "rep").alias("c"))
        many = held.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi")
        return held, many.select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))

    def across(pairs, labels):
        """Of group pairs and of groups with several members, the member pairs in different components.

        Groups meet by component first, so that members of one component are never paired.
        """
        of = labels.select(F.col("node").alias("rep"), "component")
        held, several = kinds_of(labels)
        kinds = held.select("gid", "c").distinct()
        both = pairs.union(several)
        for g, c in (("ga", "ca"), ("gb", "cb")):
            alone = of.select(F.col("rep").alias(g), F.col("component").alias("_own"))
            both = both.join(kinds.select(F.col("gid").alias(g), F.col("c").alias("_c")), g, "left").join(alone, g, "left")
            both = both.withColumn(c, F.coalesce("_c", "_own", g)).drop("_c", "_own")
        both = both.filter("ca <> cb and (ga <> gb or ca < cb)")
        for g, c, m in (("ga", "ca", "a"), ("gb", "cb", "b")):
            both = both.join(held.select(F.col("gid").alias(g), F.col("c").alias(c), F.col("rep").alias("_m")), [g, c], "left")
            both = both.withColumn(m, F.coalesce("_m", g)).drop("_m")
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sketches = some.select(F.col("doc_id").alias("rep"), "n", "parity")

    def sets_of(pairs):
        """Whole sets of the documents that pairs name; a filter of fixed size lets a few others through."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
        bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("bit")
        words = ids.select(bit).groupBy(F.expr("bit div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits"))
        words = words.toArrow()  # FILTER_BITS / 32 rows at most
        bits = np.zeros(FILTER_BITS // 32, np.int64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy()
        passed = spark.sparkContext.broadcast(bits.astype(np.uint32))

        def whole(batches):
            for batch in batches:
                bit = batch.column("bit").to_numpy()
                batch = batch.filter(pa.array((passed.value[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 > 0))
                for b in tk.chunks(batch, "text"):
                    g, at = _hashes(b, "text", k)
                    packed = []
                    for x, y in zip(at[:-1], at[1:]):
                        packed.append(np.unique(g[x:y]).astype("<u8").tobytes())
                    yield pa.record_batch({"rep": b.column("doc_id").cast(pa.int64()), "tokens": pa.array(packed, pa.binary())})

        texts = docs.filter("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
        return texts.mapInArrow(whole, "rep long, tokens binary")

    tried = materialise(near_first(first), "tried")
    likely = materialise(_possible(tried, sketches, num, den), "pairs")
    links = materialise(_verify(likely, sets_of(likely), num, den), "links")
    labels = connected_components(links)

    # Every candidate pair left in different components: first pairs of components of a shingle, then members.
    marked = posts.select("token", "gid", "n", "i").join(labels.withColumnRenamed("node", "gid").hint("merge"), "gid", "left")
    marked = marked.select("token", "gid", "n", "i", F.coalesce("component", "gid").alias("c"))
    of = marked.groupBy("token", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("i")).alias("left"))
    x, y = (of.select("token", *(F.col(c).alias(c + s) for c in ("c", "lo", "hi", "left"))) for s in "xy")
    near = (F.col("hix") * den >= F.col("loy") * num) & (F.col("hiy") * den >= F.col("lox") * num)
    # no member pair of two components can share more shingles than are left from the shared one on
    near &= F.least("leftx", "lefty") * (num + den) >= (F.col("lox") + F.col("loy")) * num
    cross = x.join(y.hint("merge"), "token").filter((F.col("cx") < F.col("cy")) & near).select("token", "cx", "cy")
    p = marked.select("token", F.col("c").alias("cx"), F.col("gid").alias("g1"), F.col("n").alias("n1"), F.col("i").alias("i1"))
    q = marked.select("token", F.col("c").alias("cy"), F.col("gid").alias("g2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    rest = cross.join(p, ["token", "cx"]).join(q, ["token", "cy"]).filter(_pairs_ok("n1", "n2", "i1", "i2", num, den)).select("g1", "g2")
    # A group is where its first member is. Where others of it are elsewhere, it also meets the groups of the first's component.
    mixed = q.join(kinds_of(labels)[1].withColumnRenamed("ga", "g2").select("g2").hint("merge"), "g2", "left_semi")
    inner = p.join(mixed.withColumnRenamed("cy", "cx").hint("merge"), ["token", "cx"]).filter(F.col("g1") != F.col("g2"))
    rest = rest.union(inner.filter(_pairs_ok("n1", "n2", "i1", "i2", num, den)).select("g1", "g2"))
    rest = rest.select(F.least("g1", "g2").alias("ga"), F.greatest("g1", "g2").alias("gb")).distinct()
    met = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(_possible(across(rest, labels).join(met, ["a", "b"], "left_anti"), sketches, num, den), "pairs")
    links = links.union(materialise(_verify(rest, sets_of(rest), num, den), "links"))
    labels = connected_components(links).withColumnRenamed("node", "rep")

    full = signed.filter("n > 0").drop("prefix", "parity").join(classes.select("digest", "n", "rep").hint("merge"), ["digest", "n"], "left").join(labels, "rep", "left")
    full = full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    empty = signed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(empty)
