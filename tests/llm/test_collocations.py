"""Collocations against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import collocations as c

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest, top, percent=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    able = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + k]) for p, a in able.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * a >= percent * f[(p[0], *p[i : i + k])]}
    out = collections.defaultdict(list)
    for p, a in able.items():
        if p not in gone:
            cuts = [(1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "CITY", "de", "la", "Ünï", "😀", "x\x00y", "İ", "a|b", "aa"]
    marks = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!"]
    return ["".join(words[int(rng.zipf(1.6)) % 11] + marks[rng.integers(len(marks))] for _ in range(rng.integers(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    lang = [None, "en", "und", "de", "en", "en"]
    return [(lang[i % 6], t) for i, t in enumerate(texts(150, 1))] + [("en", None), (None, None), ("en", ""), ("en", " .\t"), ("fr", "la " * 5000), ("en", "new york city " * 3000)] + [("de", "Copy of a text, of a text")] * 12


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.withColumns({x: F.lit("x") for x in ("phrase", "a", "n", "w", "id", "word")}).repartition(5)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("least,longest,top,percent", [(10, 5, 2000, 100), (5, 3, 7, 60), (3, 2, 50, 100)])
def test_against_brute_force(spark, rows, least, longest, top, percent):
    df = c.collocations(frame(spark, rows), least=least, longest=longest, top=top, contained_percent=percent)
    assert got(df) == brute(rows, least, longest, top, percent)


def test_full_sketch_and_many_automata_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "MOST_LOG", 16)
    monkeypatch.setattr(c, "AUTOMATON_CHARS", 400)
    assert got(c.collocations(frame(spark, rows), least=4)) == brute(rows, 4, 5, 2000)


def test_large_least_counts_and_empty_tables(spark, rows):
    assert got(c.collocations(frame(spark, rows), least=300)) == brute(rows, 300, 5, 2000)
    assert got(c.collocations(frame(spark, rows).filter("false"))) == []
    assert got(c.collocations(frame(spark, [(None, None), ("en", "")]))) == []


def test_scan_text_is_guarded():
    import pyarrow as pa

    w = c.Words(pa.array(["A b. c d\te", "f g", None, "h"]), "en")
    _, _, ok = next(c.Sketch(16).passing(w, 2))
    assert c._scan_text(w, ok) == " a b \n c d e \n f g \n"


def test_small_shards_and_pieces_lose_nothing(spark, rows, monkeypatch):
    for name, value in {"SHARD_BYTES": 500, "AUTOMATON_CHARS": 400, "FLUSH": 50}.items():
        monkeypatch.setattr(c, name, value)
    assert got(c.collocations(frame(spark, rows), least=4)) == brute(rows, 4, 5, 2000)


def test_texts_are_read_as_often_whatever_the_number_of_phrases(spark, rows, monkeypatch):
    steps, write = [], c.materialise
    monkeypatch.setattr(c, "materialise", lambda df, name="step": steps.append(name) or write(df, name))
    c.phrase_counts(frame(spark, rows), least=4)
    few = len(steps)
    monkeypatch.setattr(c, "AUTOMATON_CHARS", 40)
    c.phrase_counts(frame(spark, rows), least=4)
    assert len(steps) == 2 * few
