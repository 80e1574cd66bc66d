"""Removal of byte strings that occur twice anywhere in the corpus.

A string of `length` bytes that occurs twice holds, in both places, the same anchors: grams of half that length
whose hash is the smallest of a window (winnowing guarantees one). So only suffixes that start around a repeated
anchor can share `length` bytes. Anchors are dealt by their hash; an anchor whose whole context (all windows that
can hold it) repeats is settled by that context's hash. The other contexts, one of each kind, are sent by their
anchor, and there a suffix array, built by linear grouping, over blocks of bytes shows the repeats.

Copies and runs are settled within a batch before they are shuffled. Anchors that very many places share (told by a
sample of texts, which decides about speed only) are dealt by their context as well; their contexts, and those of any
anchor with more kinds than one suffix array takes, are cut into all strings of `length` bytes around the anchor,
whose hashes are counted by ordinary aggregation. So no task holds a group that grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import bound_batches, materialise
from shelfwise.llm.lyndon import lyndon_suffix_array


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of width values."""
    n, m, s = len(x) - width + 1, x, 1
    while s * 2 <= width:
        m = pick(m[:-s], m[s:])
        s *= 2
    return pick(m[:n], m[width - s : width - s + n])


def anchors(total: np.ndarray, inverse: np.ndarray, s: int, e: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the text at s:e, given running sums of its bytes' hashes."""
    gram, width = length // 2, length - length // 2 + 1
    i = np.arange(s, e - gram + 1)
    h = tk.mix((total[i + gram] - total[i]) * inverse[i])
    least = slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(h == slide(np.concatenate([pad, least, pad]), width, np.maximum))
    return chosen + s, h[chosen]


def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = tk.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tk.BYTE[data] * p[: len(data)], out=total[1:])
    return total, q


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common from their start."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _partings(strings: list[bytes]) -> list[list[int]]:
    """For each string the numbers of bytes, ascending, after which some other string parts from it.

    In sorted order, what two strings share is the least of what neighbours between them share; a stack holds
    the least values to one side of a string.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared = [_shared(strings[i], strings[j]) for i, j in zip(order, order[1:])]
    found: list[set[int]] = [set() for _ in strings]
    for way in (1, -1):
        stack: list[int] = []
        for i, n in zip(order[1:] if way > 0 else order[-2::-1], shared[::way]):
            while stack and stack[-1] >= n:
                stack.pop()
            stack.append(n)
            found[i].update(stack)
    return [sorted(f - {0}) for f in found]


def repeated_windows(texts: list[bytes], before: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For contexts of one anchor (before: bytes left of it), the spans of at least `length` bytes that repeat in another.

    All hold the anchor's gram at one place, so two contexts agree from some place left of it to some place right of
    it. Those places cut all contexts into blocks; a block's bytes become one symbol. The suffix array of the
    contexts' symbols, with their common prefixes counted in bytes, shows the repeats: they start and end at blocks.
    """
    gram = length // 2
    left = [t[:b][::-1] for t, b in zip(texts, before)]
    right = [t[b + gram :] for t, b in zip(texts, before)]
    left_cuts, right_cuts = _partings(left), _partings(right)
    names: dict[tuple[int, bytes], int] = {}
    symbols, place, row = [], [], []
    for r, (t, b) in enumerate(zip(texts, before)):
        if max(left_cuts[r], default=0) + gram + max(right_cuts[r], default=0) < length:
            continue  # it agrees with none for long enough
        at = 0
        # contexts that agree up to a place have the same blocks up to there
        for cut in (*(b - c for c in reversed(left_cuts[r])), b, b + gram, *(b + gram + c for c in right_cuts[r]), len(t)):
            if cut > at:
                symbols.append(names.setdefault((at - b, t[at:cut]), len(names)))
                place.append(at)
                row.append(r)
                at = cut
        symbols.append(-r - 1)  # ends this context and occurs once
        place.append(len(t))
        row.append(r)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not row or row[0] == row[-1]:
        return out
    order = lyndon_suffix_array(symbols)
    rank = [0] * len(order)
    for k, i in enumerate(order):
        rank[i] = k
    same = 0
    for i, k in enumerate(rank):
        if k:
            j = order[k - 1]
            while symbols[i + same] == symbols[j + same]:
                same += 1
            if place[i + same] - place[i] >= length:
                out[row[i]].append((place[i], place[i + same]))
                out[row[j]].append((place[j], place[j + same]))
            same = max(same - 1, 0)
        else:
            same = 0
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same bytes; touching runs join."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, reach = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    return s[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


#: Contexts of one anchor that a suffix array takes in one task: some 2 MB of bytes.
MOST_KINDS = 4096
#: One text in so many is looked at for anchors that are shared very often.
SAMPLE = 64
#: Anchors settled at once within a task.
AT_ONCE = 500_000


def _hot_anchors(texts: DataFrame, length: int) -> np.ndarray:
    """Hashes of the anchors with over a 20,000th of the sample's places, and 64 of them: 20,000 hashes at most."""

    def sign(batches):
        for whole in batches:
            for b in tk.chunks(whole, "text", 1 << 20):
                data, off = tk.flat(b.column("text"))
                total, q = sums(data)
                found = [anchors(total, q, s, e, length)[1] for s, e in zip(off[:-1], off[1:]) if e - s >= length]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gram"])

    some = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(sign, "gram long")
    counts = materialise(some.groupBy("gram").agg(F.count("*").alias("n")), "sampled-anchors")
    whole = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") > max(64, whole // 20_000)).select("gram").toArrow()  # 20,000 rows at most
    return np.sort(rows["gram"].to_numpy())


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """text_key, spans (array of (s, e) in bytes) of texts(text_key, text) with repeated strings.

    text_key is a hash of the text; rows with equal keys are copies.
    """
    spark = texts.sparkSession
    half = length - length // 2  # bytes that a window can hold on either side of an anchor
    known = spark.sparkContext.broadcast(_hot_anchors(texts, length))
    names = ["gram", "ctx", "text_key", "pos", "many", "deal"]
    kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]

    def sign(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]

        def settle():
            """Of places alike in anchor and context, one goes on for all; the others are settled, and dealt anywhere."""
            gram, ctx, key, pos = (np.concatenate(c) for c in held)
            order = np.lexsort((pos, key, ctx, gram))
            gram, ctx, key, pos = gram[order], ctx[order], key[order], pos[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            # 0: with all of the anchor; 1 and the context: a hot anchor; 2 and the place: settled already
            hot = known.value[np.minimum(np.searchsorted(known.value, gram), max(len(known.value) - 1, 0))] == gram if len(known.value) else np.zeros(len(gram), bool)
            deal = np.where(hot, (ctx | 3) - 2, 0)
            deal = np.where(new, deal, (tk.mix(key.view(np.uint64) + pos.astype(np.uint64)).view(np.int64) | 3) - 1)
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((gram, ctx, key, pos, many, deal), kinds_)], names)

        rows = 0
        for whole in batches:
            for b in tk.chunks(whole, "text", 1 << 20):
                data, off = tk.flat(b.column("text"))
                total, q = sums(data)
                for key, s, e in zip(b.column("text_key").to_pylist(), off[:-1], off[1:]):
                    if e - s < length:
                        continue
                    at, h = anchors(total, q, s, e, length)
                    lo, hi = np.maximum(at - half, s), np.minimum(at + length, e)
                    ctx = tk.mix((total[hi] - total[lo]) * q[lo] + (hi - lo).astype(np.uint64) * tk._K[7] + (at - lo).astype(np.uint64) * tk._K[8])
                    for c, v in zip(held, (h.view(np.int64), ctx.view(np.int64), np.full(len(at), key, np.int64), (at - s).astype(np.int32))):
                        c.append(v)
                    rows += len(at)
                if rows >= AT_ONCE:
                    yield settle()
                    rows = 0
        if rows:
            yield settle()

    # Copies bring equal rows: one of them goes on, and the others settle it, as they are other places.
    signed = texts.mapInArrow(sign, "gram long, ctx long, text_key long, pos int, many boolean, deal long")
    by_gram = Window.partitionBy("gram", "deal").orderBy("ctx", "text_key", "pos")
    same = lambda f: (f("gram").over(by_gram) == F.col("gram")) & (f("ctx").over(by_gram) == F.col("ctx"))
    marked = signed.select("*", F.coalesce(same(F.lag), F.lit(False)).alias("follows"), F.coalesce(same(F.lead), F.lit(False)).alias("followed"))
    marked = marked.withColumn("kinds", F.sum(F.when(~F.col("follows"), 1).otherwise(0)).over(Window.partitionBy("gram", "deal")))
    kind = F.pmod(F.col("deal"), F.lit(4))
    marked = marked.select(
        "gram",
        "text_key",
        "pos",
        (F.col("many") | F.col("follows") | F.col("followed")).alias("settled"),
        # one of each kind of context goes on, where an anchor has several kinds, or is known to have many
        (~F.col("follows") & (((kind == 0) & (F.col("kinds") > 1)) | (kind == 1))).alias("send"),
        ((kind == 1) | (F.col("kinds") > MOST_KINDS)).alias("hot"),
    )
    marked = materialise(marked.filter("send or settled"), "anchors")

    places = marked.filter("send").groupBy("text_key").agg(F.collect_list(F.struct("gram", "pos", "hot")).alias("places"))
    sent = texts.select("text_key", "text").dropDuplicates(["text_key"]).join(places.hint("merge"), "text_key")

    fields = ["gram", "text_key", "pos", "lo", "bytes", "many", "deal"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int64()]

    def cut(batches):
        strings: list[tuple[int, int, int]] = []
        out: list[list] = [[] for _ in range(5)]

        def contexts():
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)] + [pa.nulls(len(out[0]), k) for k in types[5:]], fields)
            for c in out:
                c.clear()
            return rows

        def settle():
            """Of equal strings one goes on for all; the others are settled, and dealt anywhere. A place counts once."""
            h, key, at = (np.array(c, np.int64) for c in zip(*set(strings)))
            strings.clear()
            order = np.lexsort((at, key, h))
            h, key, at = h[order], key[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            deal = np.where(new, 0, tk.mix(key.view(np.uint64) + at.astype(np.uint64)).view(np.int64) | 1)
            none = [pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), none[0], pa.array(at, pa.int32()), none[1], pa.array(np.bincount(group)[group] > 1), pa.array(deal)], fields)

        for batch in batches:
            for key, text, places_ in zip(batch.column("text_key").to_pylist(), batch.column("text"), batch.column("places").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for p in places_:
                    if p["hot"]:
                        # all strings that hold the anchor, each under a hash of its own; no bytes are sent
                        for s in range(max(0, p["pos"] - half), min(p["pos"], len(raw) - length) + 1):
                            strings.append((int.from_bytes(hashlib.blake2b(raw[s : s + length], digest_size=8).digest(), "little", signed=True), key, s))
                    else:
                        lo = max(0, p["pos"] - half)
                        for c, v in zip(out, (p["gram"], key, p["pos"], lo, raw[lo : p["pos"] + length])):
                            c.append(v)
                if len(out[0]) >= 10_000:
                    yield contexts()
                if len(strings) >= AT_ONCE:  # between texts, so that all places of a text are in one lot
                    yield settle()
        yield contexts()
        if strings:
            yield settle()

    contexts = materialise(sent.mapInArrow(cut, "gram long, text_key long, pos int, lo int, bytes binary, many boolean, deal long"), "contexts")

    def group(batches):
        def settle(rows: list[tuple]):
            found = repeated_windows([r[4] for r in rows], [pos - lo for _, _, pos, lo, _ in rows], length)
            for (_, key, _, lo, _), spans in zip(rows, found):
                pairs = np.array(spans, np.int64).reshape(-1, 2)
                for s, e in zip(*_union(pairs[:, 0], pairs[:, 1])):
                    yield key, lo + int(s), lo + int(e)

        held: list[tuple] = []  # MOST_KINDS contexts at most
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("gram", "text_key", "pos", "lo", "bytes"))):
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["text_key", "s", "e"])
        if held and (out := list(settle(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["text_key", "s", "e"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = contexts.filter("bytes is not null").repartition(parts, "gram").sortWithinPartitions("gram")
    found = few.mapInArrow(group, "text_key long, s int, e int")
    alike = Window.partitionBy("gram", "deal")
    strings = contexts.filter("bytes is null").withColumn("n", F.count("*").over(alike)).filter("many or n > 1")
    hot = strings.select("text_key", F.col("lo").alias("s"), (F.col("lo") + length).alias("e"))
    settled = marked.filter("settled").distinct().select("text_key", F.greatest(F.col("pos") - half, F.lit(0)).alias("s"), (F.col("pos") + length).alias("e"))
    spans = found.union(settled).union(hot)
    return materialise(spans.groupBy("text_key").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row of docs.

    A byte goes if any string of `length` bytes that covers it starts elsewhere too, in the same row or another;
    strings never cross rows and are judged on the input. Null texts are empty; shorter texts stay; rows that
    repeat an id are rows like others, and so repeats. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(docs.select("text_key", "text"), length)
    # one narrow table of what is known of each text, so that the texts are shuffled once for it
    copies = docs.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    known = spans.join(copies.hint("merge"), "text_key", "full_outer").select("text_key", "spans", F.coalesce("copies", F.lit(1)).alias("copies"))

    def remove(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, copies, spans_ in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                n = len(raw)
                if copies > 1 and n >= length:
                    s, e = np.array([0]), np.array([n])
                else:
                    pairs = np.array([(x["s"], x["e"]) for x in spans_ or []], np.int64).reshape(-1, 2)
                    s, e = _union(pairs[:, 0], np.minimum(pairs[:, 1], n))
                edges = [0, *(int(v) for p in zip(s, e) for v in p), n]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for c, v in zip(out, (n, n - len(left), len(s), hashlib.sha256(left).hexdigest(), left)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    marked = docs.join(known.hint("merge"), "text_key", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    return marked.mapInArrow(remove, schema)
