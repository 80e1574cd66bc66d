"""Phrase collocations by language, mined from counts over all documents.

A count sketch of hashed runs of words (first pairs, then longer runs whose pairs all pass) bounds every phrase's count
from above, so that no frequent phrase is missed. Phrases whose bounds reach the least count are the candidates. Those
that occur in a shard of the texts are compiled, with a delimiter before, between and behind their words, into
Aho-Corasick automata; the shard is scanned for all overlapping matches and the counts of all shards are summed.
Thresholds and scores then rest on these exact counts.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import materialise

#: Breaks between pieces become newlines, blanks spaces, A-Z a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 0x20
_FOLD[[*b".,;:!?\n\v\f\r"]] = 0x0A

#: A sketch has a cell for about four bytes of text, within these bounds; its heavy cells (32 MiB at most, as a bitmap
#: or as a list) go to every task. A sketch that is too small lets more phrases through to be counted, and loses none.
LEAST_LOG, MOST_LOG = 16, 28
#: Cells of one block of a sketch, which is merged at once; occurrences that a task holds before it sends them on.
BLOCK_LOG, FLUSH = 16, 2_000_000
#: Bits of a phrase's hash that say where its counts are summed.
PART_LOG = 8
#: Bytes of the texts that a task scans together, and of the phrases of one automaton. A shard with more phrases has
#: several automata, each of which scans the shard again; the number of all phrases of the corpus plays no part.
SHARD_BYTES, AUTOMATON_CHARS = 16_000_000, 4_000_000


class Words:
    """Words of texts of one language: bytes, bounds, pieces, and hashes of runs of words."""

    def __init__(self, texts: pa.Array, lang: str):
        data, off = tk.flat(texts)
        self.data = _FOLD[data]
        self.s, self.e, _ = tk.word_bounds(self.data, off)
        # both terms only grow, so the sum changes wherever a break or a text ends
        self.piece = np.cumsum(self.data == 0x0A)[self.s] + np.searchsorted(off, self.s, "right") if len(self.s) else self.s
        self.hash = tk.span_hash(self.data, self.s, self.e) if len(self.s) else np.zeros(0, np.uint64)
        self.salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))

    def counts(self) -> pa.Array:
        """Distinct words and their counts."""
        inside = (self.data != 0x20) & (self.data != 0x0A)
        ends = np.concatenate([[0], np.cumsum(self.e - self.s)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(self.s), [None, pa.py_buffer(ends), pa.py_buffer(self.data[inside])])
        return pc.value_counts(words)

    def runs(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For n from 2: a hash of the n words from each word on, whether of one piece or not."""
        g = self.hash
        for n in range(2, longest + 1):
            g = g[: max(len(self.hash) - n + 1, 0)] * tk._K[0] + self.hash[n - 1 :]
            yield n, tk.mix(g ^ self.salt ^ tk._K[n])

    def pairs(self) -> np.ndarray:
        return self.piece[1:] == self.piece[:-1]


class Sketch:
    """Which cells are heavy: for pairs of words, and for longer runs. Absent tables let everything pass."""

    def __init__(self, log: int, pairs: np.ndarray | None = None, longer: np.ndarray | None = None):
        self.log, self.tables = log, (pairs, longer)

    def cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.log)).astype(np.int64)

    def heavy(self, n: int, h: np.ndarray) -> np.ndarray:
        table = self.tables[n > 2]
        if table is None:
            return np.ones(len(h), bool)
        c = self.cell(h)
        if table.dtype == np.uint32:
            return table[np.searchsorted(table[:-1], c.astype(np.uint32))] == c if len(table) else np.zeros(len(h), bool)
        return ((table[c >> 3] >> (c & 7).astype(np.uint8)) & 1).astype(bool)

    def passing(self, w: Words, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, hashes, and which runs of n words may be frequent, as both runs of n - 1 words in them may be."""
        ok = np.zeros(0, bool)
        for n, h in w.runs(longest):
            ok = (w.pairs() if n == 2 else ok[:-1] & ok[1:])[: len(h)]
            at = np.flatnonzero(ok)
            ok = np.zeros(len(h), bool)
            ok[at[self.heavy(n, h[at])]] = True
            yield n, h, ok


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Texts of each language, in chunks of about 1 MB."""
    for code in pc.unique(batch.column("lang")).to_pylist():
        for b in tk.chunks(batch.filter(pc.equal(batch.column("lang"), code)), "text"):
            yield code, b.column("text")


def _cell_rows(cells: list[np.ndarray], least: int) -> pa.RecordBatch:
    """Blocks of cells with their counts, which are cut off at the least count: sums still reach it or do not."""
    cell, n = np.unique(np.concatenate(cells), return_counts=True)
    block, first = np.unique(cell >> BLOCK_LOG, return_index=True)
    ends = np.append(first, len(cell))
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    low, n = (cell & ((1 << BLOCK_LOG) - 1)).astype("<u2"), np.minimum(n, least).astype(_width(least))
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), binary(low), binary(n)], ["block", "cells", "counts"])


def _width(least: int) -> str:
    return "u1" if least < 256 else "<u4"


def _heavy_cells(rows: DataFrame, least: int, log: int) -> np.ndarray:
    """The cells that hold at least the least count, from rows of block, cells, counts: sorted if few, else a bitmap.

    A block is summed in one task in one array, whatever the corpus; the driver gets the heavy cells, 2**log at most.
    """

    def merge(batches):
        now, total = None, None

        def result():
            at = np.flatnonzero(total >= least).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at.tobytes()], pa.binary())], ["block", "cells"])

        for b in batches:
            for block, cells, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if block != now:
                    if now is not None:
                        yield result()
                    now, total = block, np.zeros(1 << BLOCK_LOG, np.int64)
                total[np.frombuffer(cells.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), _width(least))
        if now is not None:
            yield result()

    merged = rows.select("block", "cells", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, cells binary")
    found = [(np.frombuffer(r["cells"], "<u2").astype(np.uint32) + np.uint32(r["block"] << BLOCK_LOG)) for r in merged.collect()]
    heavy = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)
    if len(heavy) * 32 <= 1 << log:
        return heavy
    dense = np.zeros(1 << log, bool)
    dense[heavy] = True
    return np.packbits(dense, bitorder="little")


def _words_and_pairs(texts: DataFrame, sketch: Sketch, least: int) -> DataFrame:
    """Words with counts a task, and cells of pairs of words, in one pass; written."""

    def run(batches):
        cells, held, words, pending = [], 0, {}, 0

        def sent():
            for code, parts in words.items():
                t = pa.concat_arrays(parts)
                t = pa.table({"word": t.field(0), "n": t.field(1)}).group_by("word").aggregate([("n", "sum")])
                k = t.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([code] * k, pa.string()), t.column("word").combine_chunks().cast(pa.string()), t.column("n_sum").combine_chunks(), *[pa.nulls(k, x) for x in (pa.int32(), pa.binary(), pa.binary())]], names)
            if cells:
                b = _cell_rows(cells, least)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, x) for x in (pa.string(), pa.string(), pa.int64())], *b.columns], names)
            cells.clear(), words.clear()

        names = ["lang", "word", "n", "block", "cells", "counts"]
        for batch in batches:
            for code, part in _by_language(batch):
                w = Words(part, code)
                words.setdefault(code, []).append(w.counts())
                _, h, ok = next(sketch.passing(w, 2))
                cells.append(sketch.cell(h[ok]))
                held, pending = held + len(cells[-1]), pending + len(words[code][-1])
                if held + pending > FLUSH:
                    yield from sent()
                    held = pending = 0
        yield from sent()

    return materialise(texts.mapInArrow(run, "lang string, word string, n long, block int, cells binary, counts binary"), "words-and-pairs")


def _longer_runs(texts: DataFrame, sketch, longest: int, least: int) -> DataFrame:
    """Cells of runs of three words and more whose pairs may all be frequent."""

    def run(batches):
        cells, held = [], 0
        for batch in batches:
            for code, part in _by_language(batch):
                for n, h, ok in sketch.value.passing(Words(part, code), longest):
                    if n > 2 and ok.any():
                        cells.append(sketch.value.cell(h[ok]))
                        held += len(cells[-1])
                if held > FLUSH:
                    yield _cell_rows(cells, least)
                    cells, held = [], 0
        if cells:
            yield _cell_rows(cells, least)

    return texts.mapInArrow(run, "block int, cells binary, counts binary")


def _scan(w: Words, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of passing pairs, each between delimiters, and a newline wherever a chain of such pairs ends.

    As bytes, with the place of each of these words among them.
    """
    to_next = np.append(ok, False)
    k = np.flatnonzero(to_next | np.append(False, ok))
    size, last = (w.e - w.s)[k], ~to_next[k]
    step = size + 1 + 2 * last
    start = np.cumsum(step) - step
    out = np.full(int(step.sum()), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start + 1, size) + inner] = w.data[np.repeat(w.s[k], size) + inner]
    out[(start + size + 2)[last]] = 0x0A
    at = np.zeros(len(w.s), np.int64)
    at[k] = start + 1
    return out, at


def _scan_text(w: Words, ok: np.ndarray) -> str:
    """What an automaton scans of these words."""
    return _scan(w, ok)[0].tobytes().decode("utf-8", "surrogateescape")


class Shard:
    """Texts of one language that are scanned together, and where each kind of passing run in them is first found."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size = self.merged = self.held = 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, w: Words, passing: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
        """Takes a chunk, if anything passes in it; how many bytes and kinds of runs came with it."""
        if not (ok := passing[0][2]).any():
            return 0
        text, at = _scan(w, ok)
        size = w.e - w.s
        found = [(h[i], at[i], at[i + n - 1] + size[i + n - 1]) for n, h, ok in passing for i in [np.flatnonzero(ok)]]
        h, start, end = map(np.concatenate, zip(*found))
        h, first = np.unique(h, return_index=True)
        self.runs.append((h, start[first] + self.size, end[first] + self.size))
        self.texts.append(text.tobytes())
        self.size += len(text)
        self.held += len(h)
        if self.held > 2 * self.merged + (1 << BLOCK_LOG):
            self.merge()
        return len(text)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, start, end = map(np.concatenate, zip(*self.runs))
        h, first = np.unique(h, return_index=True)
        self.runs = [(h, start[first], end[first])]
        self.merged = self.held = len(h)
        return self.runs[0]

    def counted(self, chars: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
        """Hashes, phrases and matches, overlapping ones too: an automaton for each `chars` characters of phrases."""
        h, start, end = self.merge()
        whole = b"".join(self.texts)
        ends = np.cumsum(end - start)
        first = 0
        while first < len(h):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + chars)))
            phrases = b"\n".join([whole[a:b] for a, b in zip(start[first:last].tolist(), end[first:last].tolist())]).decode().split("\n")
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i in sorted(range(len(phrases)), key=phrases.__getitem__):  # phrases of one start lie together, which is faster
                automaton.add_word(f" {phrases[i]} ", i)
            automaton.make_automaton()
            n = np.zeros(len(phrases), np.int64)
            for text in self.texts:
                hits = np.fromiter(map(itemgetter(1), automaton.iter(text.decode())), np.int64)
                n += np.bincount(hits, minlength=len(n))
            yield h[first:last], phrases, n
            first = last


def _count(texts: DataFrame, sketch, longest: int, least: int) -> DataFrame:
    """lang, phrase, a of all phrases with at least the least count; written.

    A task compiles the phrases that the sketch lets pass in a shard of its texts, and counts their matches there. It
    sends them on, many a row, by the first bits of their hash; each such part of a language is summed in one task.
    """
    chars, shard_bytes = AUTOMATON_CHARS, SHARD_BYTES

    def run(batches):
        shards: dict[str, Shard] = {}
        held = 0

        def sent():
            for code, shard in shards.items():
                for h, phrases, n in shard.counted(chars):
                    part, first = np.unique((h >> np.uint64(64 - PART_LOG)).astype(np.int32), return_index=True)
                    bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(h)]))
                    lines = ["\n".join(phrases[a:b]) for a, b in bounds]
                    counts = [n[a:b].astype("<i8").tobytes() for a, b in bounds]
                    columns = [pa.array([code] * len(part), pa.string()), pa.array(part), pa.array(lines, pa.string()), pa.array(counts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "part", "phrases", "n"])
            shards.clear()

        for batch in batches:
            for code, part in _by_language(batch):
                w = Words(part, code)
                passing = list(sketch.value.passing(w, longest))
                if passing[0][2].any():
                    held += shards.setdefault(code, Shard()).add(w, passing)
                    if held > shard_bytes:
                        yield from sent()
                        held = 0
        yield from sent()

    def merge(batches):
        now, parts, held = None, [], 0

        def summed():
            return pa.concat_tables(parts).group_by("phrase").aggregate([("a", "sum")]).rename_columns(["phrase", "a"])

        def result():
            t = summed()
            t = t.filter(pc.greater_equal(t.column("a"), least))
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(t), pa.string()), t.column("phrase").combine_chunks().cast(pa.string()), t.column("a").combine_chunks()], ["lang", "phrase", "a"])

        for b in batches:
            for code, part, lines, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if (code, part) != now:
                    if parts:
                        yield result()
                    now, parts, held = (code, part), [], 0
                phrases = pa.array(lines.as_py().split("\n"), pa.large_string())
                parts.append(pa.table({"phrase": phrases, "a": np.frombuffer(n.as_buffer(), "<i8")}))
                held += len(phrases)
                if held > FLUSH:
                    parts = [summed()]
                    held = len(parts[0])
        if parts:
            yield result()

    sent_on = texts.mapInArrow(run, "lang string, part int, phrases string, n binary")
    summed = sent_on.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(merge, "lang string, phrase string, a long")
    return materialise(summed, "phrases")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 2 to `longest` words with at least `least` occurrences, and (lang, word, n)."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log = min(MOST_LOG, max(LEAST_LOG, math.ceil(math.log2(size / 4 + 1))))
    first = _words_and_pairs(texts, Sketch(log), least)
    words = materialise(first.filter("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    pairs = _heavy_cells(first.filter("block is not null"), least, log)
    longer = _heavy_cells(_longer_runs(texts, broadcast(Sketch(log, pairs)), longest, least), least, log) if longest > 2 else None
    sketch = broadcast(Sketch(log, pairs, longer))
    return _count(texts, sketch, longest, least), words


def collocations(
    docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, contained_percent: int = 100, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and phrase.

    A phrase's score is the lowest of its cuts in two, floor(1000 a n / (l r)) with the parts' counts l and r; the
    first of equal cuts counts. A phrase goes if it lies in a longer one with contained_percent of its count. Rows
    count each, repeated ones too, whatever their ids; a null language is `und`; null and empty texts have no words; an
    empty table has no phrases. Other columns are not read. A very long text is the work of one task, in its own chunk.
    """
    phrases, words = phrase_counts(docs, least, longest, lang_col, text_col)
    known = phrases.withColumnRenamed("a", "f").union(words.filter(F.col("n") >= least))
    total = F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("n")))  # a row a language

    # a longer phrase is no more frequent than what it holds, so those with one word more tell for all longer ones
    split = phrases.withColumn("w", F.split("phrase", " "))
    longer = split.filter(F.size("w") > 2)
    ends = F.explode(F.array(*[F.array_join(F.slice("w", first, F.size("w") - 1), " ") for first in (1, 2)]))
    inside = longer.select("lang", "a", ends.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = split.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < contained_percent * F.col("a")))

    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    # precisions add up to 38 digits, so the products are whole
    score = F.expr("cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))

    # the first of each part of a language go to the window over the language
    order = [F.col("m.score").desc(), F.col("a").desc(), "phrase"]
    for key in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(1 << PART_LOG))], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= top)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
