"""Quality rules by suffix-array repetition, with the base counts of the rule set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import textkernel as tk
from shelfwise.llm.common import bound_batches

WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a sequence and the common prefix of each suffix with the one before it."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, step = new, step * 2
        if rank.max(initial=0) == n - 1 or step >= n:
            break
        levels.append(rank)
    sa = np.argsort(rank, kind="stable")
    i, j = sa[1:].copy(), sa[:-1].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, length = levels[level], 1 << level
        inside = (i + lcp[1:] < n) & (j + lcp[1:] < n)
        same = np.zeros(len(i), bool)
        same[inside] = r[(i + lcp[1:])[inside]] == r[(j + lcp[1:])[inside]]
        # a rank of 2**level words may stand for a shorter suffix, which equals no other
        lcp[1:] += same * length
    return sa, lcp


def repeated_spans(symbols: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """Which symbols lie in a substring of at least `least` symbols that occurs twice, and the longest such.

    Common-prefix intervals of the suffix array are the maximal repeats; neighbours in the array span them.
    """
    sa, lcp = suffix_array(symbols)
    hit = np.flatnonzero(lcp >= least)
    edge = np.zeros(len(symbols) + 1, np.int64)
    for at in (sa[hit], sa[hit - 1]):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + lcp[hit], -1)
    return np.cumsum(edge[:-1]) > 0, int(lcp[hit].max(initial=0))


def _duplicated(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks all but the first of equal (row, h)."""
    order = np.lexsort((h, rows))
    r, x = rows[order], h[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
    return out


def _judge(b: pa.RecordBatch, max_fraction: float, max_longest: float) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept of each row."""
    data, off = tk.flat(b.column("text"))
    s, e, first = tk.word_bounds(data, off)
    n_words = np.diff(first)

    def per_row(mark):
        total = np.zeros(len(mark) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    chars = per_row(((data & 0xC0) != 0x80) & ~tk.SPACE[data])
    symbols = per_row(SYMBOLS[data])
    # lines with a word, equal to an earlier one
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), off[1:]]))
    starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 10]
    stop = ends[np.searchsorted(ends, starts, side="right")]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~tk.SPACE[data], out=filled[1:])
    full = filled[stop] > filled[starts]
    starts, stop = starts[full], stop[full]
    row = np.searchsorted(off, starts, side="right") - 1
    dup_lines = np.bincount(row[_duplicated(row, tk.span_hash(data, starts, stop))], minlength=len(n_words))

    h = tk.span_hash(data, s, e)
    g, at = tk.windows(h, first, WINDOW)
    rows = np.repeat(np.arange(len(n_words)), np.diff(at))
    repeats, longest = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for r in np.unique(rows[_duplicated(rows, g)]):  # only texts that repeat a window need a suffix array
        covered, longest[r] = repeated_spans(h[first[r] : first[r + 1]], WINDOW)
        repeats[r] = covered.sum()
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    bad = failed | (repeats > max_fraction * n_words) | (longest > max_longest * n_words)
    return [n_words, chars, symbols, dup_lines, repeats, longest, failed, ~bad]


def quality_rules(
    docs: DataFrame, max_fraction: float = 0.2, max_longest: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts and verdict of every row of docs.

    kept is false for texts under 20 words, for those with over 30 % of their words in repeated 8-word windows
    (base_failed), and where the suffix array shows repeats that cover over max_fraction of the words, or one
    repeat of over max_longest of them. Null and empty texts count 0 and fail; rows that repeat an id, or have none,
    are judged each; an empty table gives none. Other columns are not read. A long text is one task's work, of its
    own length only.
    """

    bound_batches(docs.sparkSession)

    def judge(batches):
        for whole in batches:
            for b in tk.chunks(whole, "text", 1 << 20):
                cols = [pa.array(x) for x in _judge(b, max_fraction, max_longest)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, SCHEMA)


def keep_quality(docs: DataFrame, max_fraction: float = 0.2, max_longest: float = 0.1) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps; nothing is shuffled.

    Null and empty texts go; ids, repeated rows and columns of any name do not matter; an empty table stays empty.
    """

    bound_batches(docs.sparkSession)

    def keep(batches):
        for whole in batches:
            for b in tk.chunks(whole, "text", 1 << 20):
                yield b.filter(pa.array(_judge(b, max_fraction, max_longest)[-1]))

    return docs.mapInArrow(keep, docs.schema)
