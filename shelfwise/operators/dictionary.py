"""Texts against a dictionary of any size: every entry that a text contains, in one pass over the text."""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of the entries that one pass looks for (some 300 MB of a task's memory); more entries make more passes.
PASS_CHARS = 8_000_000
#: Entries found that a task holds before it hands rows on.
HELD = 100_000
FOUND = "array<struct<tag:string,term:string,at:int>>"


def find_terms(rows: DataFrame, text: str, terms: DataFrame, found: str = "found") -> DataFrame:
    """rows with found: tag, term and first place (from 0, in code points) of each entry of terms(tag, term) in a text.

    An entry counts wherever its characters stand, as with contains; both sides are lower-cased. Entries that repeat
    count once, those of several tags once a tag; blank ones never. found is in order of place, term and tag; empty for
    null texts. A column of that name is replaced. Entries beyond PASS_CHARS are dealt over passes by their hash, in
    which rows stay where they are: nothing is shuffled but the dictionary.
    """
    clean = terms.select(F.col("tag").cast("string").alias("tag"), F.lower("term").alias("term")).filter("term <> '' and tag is not null").distinct()
    chars = clean.agg(F.sum(F.length("term"))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    out = rows.withColumn(found, F.array().cast(FOUND))
    for i in range(passes):
        part = clean.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == i)
        entries = [tuple(r) for r in part.groupBy("term").agg(F.sort_array(F.collect_list("tag"))).collect()]  # PASS_CHARS characters about
        out = _pass(out, text, found, entries) if entries else out
    return out.withColumn(found, F.array_sort(found, lambda a, b: _order(a, b)))


def _order(a, b):
    key = lambda x: F.struct(x["at"], x["term"], x["tag"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _pass(rows: DataFrame, text: str, found: str, entries: list[tuple[str, list[str]]]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(entries)
    schema = StructType([*rows.schema.fields])
    names = rows.columns

    def run(batches):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (term, _) in enumerate(held.value):
            automaton.add_word(term, i)
        automaton.make_automaton()
        words = pa.array([term for term, _ in held.value], pa.string())
        tags = [t for _, ts in held.value for t in ts]
        sizes = np.array([len(ts) for _, ts in held.value], np.int64)
        starts, lengths, tags = np.cumsum(sizes) - sizes, np.array([len(term) for term, _ in held.value], np.int64), pa.array(tags, pa.string())

        def with_found(rows, ends, entries, counts):
            """rows with the entries found in them, after those found before; counts: entries a row."""
            entries, ends, counts = np.array(entries, np.int64), np.array(ends, np.int64), np.array(counts, np.int64)
            n = sizes[entries]
            first = np.cumsum(n) - n
            tag = np.repeat(starts[entries] - first, n) + np.arange(n.sum())
            each = np.repeat(entries, n)
            new = pa.StructArray.from_arrays([tags.take(pa.array(tag)), words.take(pa.array(each)), pa.array((np.repeat(ends, n) + 1 - lengths[each]).astype(np.int32))], ["tag", "term", "at"])
            per = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=n, minlength=len(counts)).astype(np.int64)
            before = rows.column(names.index(found))
            old = before.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            both = pa.concat_arrays([before.flatten().cast(new.type), new])
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(old)), old), np.repeat(np.arange(len(per)), per)]), kind="stable")
            offsets = np.concatenate([[0], np.cumsum(old + per)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), both.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([column if c == found else rows.column(k) for k, c in enumerate(names)], names)

        for b in batches:
            start, ends, entries, counts, many = 0, [], [], [], 0
            for row, t in enumerate(b.column(names.index(text))):
                seen: dict[int, int] = {}
                for end, i in automaton.iter((t.as_py() or "").lower()):
                    seen.setdefault(i, end)
                entries.extend(seen)
                ends.extend(seen.values())
                counts.append(len(seen))
                many += int(sizes[list(seen)].sum()) if seen else 0
                if many >= HELD:
                    yield with_found(b.slice(start, row + 1 - start), ends, entries, counts)
                    start, ends, entries, counts, many = row + 1, [], [], [], 0
            if counts:
                yield with_found(b.slice(start), ends, entries, counts)

    return rows.mapInArrow(run, schema)
