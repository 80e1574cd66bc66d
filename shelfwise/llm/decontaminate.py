"""Benchmark decontamination in DataFrame operations only.

Two bitmaps of the benchmark's windows, of a size that follows the benchmark and never the corpus, travel with the
plan; a document's windows are looked up in them where the document is, and only those that pass become rows.
These meet the hash set of the windows, which is broadcast, and are then verified on the words themselves. Hit
spans or whole documents can be removed. Each row is judged by its own text, so null and reused ids are rows like
others, and rows without a window that passes are never shuffled with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ascii_lower, fresh, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of the windows' hashes (some 40 each with Spark's overhead) up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits a window of the bitmaps, and the greatest bitmap: 2 MiB. A fuller bitmap lets more windows through to the
#: hash set, and changes no result.
BITS_EACH, MOST_BITS = 16, 1 << 24
FOUND = "array<struct<len:int,h:bigint,pos:int,gram:array<string>>>"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _start(hashes: str, at: Column | int, n: int) -> Column:
    """Hash of a window's first two words."""
    return F.xxhash64(*[F.get(hashes, F.lit(at) + j if isinstance(at, int) else at + j) for j in range(min(n, 2))])


def _window(hashes: str, at: Column | int, n: int) -> Column:
    """Hash of a window of n words and of n."""
    return F.xxhash64(*[F.get(hashes, F.lit(at) + j if isinstance(at, int) else at + j) for j in range(n)], F.lit(n))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """item_id, len, h, start, gram of every window of n words of each item; a shorter item, if not empty, is one."""
    items = benchmark.select(F.col("item_id"), F.col("text")).withColumn("w", words(F.col("text"))).filter(F.size("w") > 0)
    sized = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = sized.select("item_id", "len", F.explode_outer(F.expr("transform(sequence(0, size(w) - len), p -> slice(w, p + 1, len))")).alias("gram"))
    hashed = grams.withColumn("_wh", F.transform("gram", lambda x: F.xxhash64(x)))
    h, start = F.lit(None).cast("long"), F.lit(None).cast("long")
    for m in range(1, n + 1):
        h = F.when(F.col("len") == m, _window("_wh", 0, m)).otherwise(h)
        start = F.when(F.col("len") == m, _start("_wh", 0, m)).otherwise(start)
    return hashed.select("item_id", "len", h.alias("h"), start.alias("start"), "gram").distinct()


class Windows:
    """The benchmark's windows as a table, their lengths, and the two bitmaps as constant columns."""

    def __init__(self, benchmark: DataFrame, n: int):
        self.table = materialise(benchmark_windows(benchmark, n), "benchmark-windows")
        counts = {r["len"]: r["count"] for r in self.table.groupBy("len").count().collect()}  # n rows at most
        self.lengths, total = sorted(counts), sum(counts.values())
        self.small = total * 40 <= BROADCAST_BYTES
        self.log = min(MOST_BITS, max(1 << 12, total * BITS_EACH)).bit_length() - 1
        self.starts, self.whole = self._bitmap("start"), self._bitmap("h")

    def _slot(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.log)

    def _bitmap(self, column: str) -> Column:
        """An array of 2**log / 64 longs; its text is folded to a constant."""
        slot = self._slot(F.col(column))
        bits = self.table.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
        held = {r["word"]: r["bits"] for r in bits.collect()}  # MOST_BITS / 64 rows at most
        text = ",".join(str(held.get(i, 0)) for i in range(1 << (self.log - 6)))
        return F.split(F.lit(text), ",").cast("array<bigint>")

    def _set(self, bitmap: Column, h: Column) -> Column:
        slot = self._slot(h)
        return F.getbit(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    def _passing(self, w: str, wh: str, n: int) -> Column:
        starts = F.when(F.size(wh) >= n, F.sequence(F.lit(0), F.size(wh) - n)).otherwise(F.array().cast("array<int>"))
        held = F.filter(starts, lambda p: self._set(self.starts, _start(wh, p, n)) & self._set(self.whole, _window(wh, p, n)))
        return F.transform(held, lambda p: F.struct(F.lit(n).alias("len"), _window(wh, p, n).alias("h"), p.alias("pos"), F.slice(w, p + 1, F.lit(n)).alias("gram")))

    def passing(self, w: str, wh: str) -> Column:
        """Windows of a document's words w, with hashes wh, that both bitmaps let through."""
        return F.concat(F.array().cast(FOUND), *[self._passing(w, wh, n) for n in self.lengths])


def _scan(docs: DataFrame, windows: Windows, row: str, found: str, keep: list[str], text: Column, count: str | None = None) -> DataFrame:
    """keep, a number a row, and the windows that pass; written, so that texts are scanned once and rows keep numbers."""
    w, wh = fresh(docs, "_w"), fresh(docs, "_wh")
    scanned = docs.withColumn(w, words(text)).withColumn(wh, F.transform(w, lambda x: F.xxhash64(x)))
    sizes = [F.size(w).cast("long").alias(count)] if count else []
    return materialise(scanned.select(*keep, F.monotonically_increasing_id().alias(row), windows.passing(w, wh).alias(found), *sizes), "scanned")


def _hits(scanned: DataFrame, windows: Windows, row: str, found: str) -> DataFrame:
    """row, spans (sorted distinct (pos, end) of hit windows), items (distinct item ids) of rows with hits."""
    passed = scanned.filter(F.size(found) > 0).select(F.col(row).alias("row"), F.explode_outer(found).alias("f")).select("row", "f.*")
    keys = windows.table.select("h").distinct()
    passed = passed.join(F.broadcast(keys) if windows.small else keys.hint("merge"), "h")
    # Verification on the words; sort-merge, as hits grow with the corpus. A hot window is split by AQE.
    true = passed.join(windows.table.select("h", "len", "gram", "item_id").hint("merge"), ["h", "len", "gram"])
    return true.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))).alias("spans"), F.collect_set("item_id").alias("items")
    )


def _covered(spans: str) -> Column:
    """Words in the union of sorted spans."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0L, 'reach', 0), (s, x) -> named_struct("
        "'n', s.n + greatest(0, x.end - greatest(x.pos, s.reach)), 'reach', greatest(s.reach, x.end)), s -> s.n)"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A word is hit if it lies in any occurrence of a benchmark window. Null and empty texts have no words; an
    empty benchmark, or empty docs, hit nothing; rows that repeat an id, or have none, are judged by their own
    texts; items that repeat an id, or a text, count once an id. Other columns are not read. A very long text is
    the work of one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    windows = Windows(benchmark, n)
    scanned = _scan(docs, windows, "row", "found", ["doc_id"], F.col("text"), "n_words")
    out = scanned.drop("found").join(_hits(scanned, windows, "row", "found").hint("merge"), "row", "left")
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(_covered("spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(listed, ","), F.lit("")), 256).alias("items_sha256"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows of docs without a window that passes, the others with their spans (null: none true), and spans' name."""
    row, found, spans = (fresh(docs, c) for c in ("_row", "_found", "_spans"))
    windows = Windows(benchmark, n)
    scanned = _scan(docs, windows, row, found, docs.columns, F.col("text"))
    hits = _hits(scanned, windows, row, found).select(F.col("row").alias(row), F.col("spans").alias(spans))
    some = scanned.filter(F.size(found) > 0).join(hits.hint("merge"), row, "left").select(*docs.columns, spans)
    return scanned.filter(F.size(found) == 0).select(docs.columns), some, spans


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs without the rows that any benchmark window hits; all columns stay, whatever their names.

    Each row is judged by its own text, with null and reused ids too. Null and empty texts, and all rows where the
    benchmark is empty, stay; copies of a row stay or go together.
    """
    clean, some, spans = _marked(docs, benchmark, n)
    return clean.union(some.filter(F.col(spans).isNull()).select(docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with the hit words cut out of their texts; all else of a text, and all columns, stay as they are."""
    clean, some, spans = _marked(docs, benchmark, n)
    gaps, held = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), 0)
    hit = lambda i: F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["end"]))
    kept = F.transform(held, lambda w, i: F.when(hit(i), "").otherwise(w))
    pieces = F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    cut = some.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(pieces, "")))
    return clean.union(cut.select(docs.columns))
