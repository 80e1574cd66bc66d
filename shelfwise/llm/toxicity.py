"""Toxicity by weak supervision.

Voters are lexicon entries (fixed insults, and word stems mined from training labels) and text patterns. A
generative label model estimates each voter's accuracy by expectation maximisation and how voters correlate
given the class; correlated voters share their weight. A linear classifier learns the posterior labels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches, materialise

# Common insults of the four languages.
INSULTS = {
    "en": ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown"],
    "fr": ["imbécile", "crétin", "connard", "salaud", "débile", "ordure"],
    "de": ["dummkopf", "arschloch", "trottel", "abschaum", "vollidiot", "widerlich"],
    "es": ["imbécil", "estúpido", "idiota", "basura", "escoria", "asqueroso"],
}
SHOUT = re.compile(r"!{2,}")
WORD = re.compile(r"[^\W\d_]{4,}")
STEM_LENGTHS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Model:
    stems: list[str]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def held_out(id_col: str = "doc_id"):
    """True for rows whose labels are never used: crc32 of the id's text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def _automaton(stems: list[str]) -> ahocorasick.Automaton | None:
    if not stems:
        return None
    a = ahocorasick.Automaton()
    for i, s in enumerate(stems):
        a.add_word(s, (i, len(s)))
    a.make_automaton()
    return a


def features(texts: list[str], stems: list[str], a) -> np.ndarray:
    """A row a text: count of each stem at word starts, then the pattern voters."""
    out = np.zeros((len(texts), len(stems) + 4), np.float32)
    for row, t in zip(out, texts):
        t = t or ""
        low = t.lower()
        if a is not None:
            for last, (i, length) in a.iter(low):
                at = last - length
                if at < 0 or not low[at].isalnum():
                    row[i] += 1
        hits = row[: len(stems)]
        row[-4] = hits.sum() >= 2  # several insults
        row[-3] = (hits > 0).sum() >= 2  # different insults
        row[-2] = hits.sum() * 100 >= max(1, low.count(" "))  # dense insults
        row[-1] = min(len(SHOUT.findall(t)), 5) >= 3 and hits.sum() > 0
    return out


def _mine(train: DataFrame, max_stems: int, support: int, precision: float, base: float) -> list[str]:
    """Word stems that mark toxic training rows, max_stems at most.

    A stem must be in four standard deviations more toxic rows than the share base of all rows lets expect, so that
    stems of common rows are no voters where toxic rows are many.
    """

    def stems(batches):
        for b in batches:
            pos: dict[str, list[int]] = {}
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(WORD.findall((t or "").lower()))
                for p in {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | words:
                    pos.setdefault(p, [0, 0])[1 - bool(y)] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pos), pa.string()), pa.array([v[0] for v in pos.values()], pa.int64()), pa.array([v[1] for v in pos.values()], pa.int64())],
                ["stem", "pos", "neg"],
            )

    counts = train.mapInArrow(stems, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = F.col("pos") + F.col("neg")
    clear = F.col("pos") - n * base >= 4 * F.sqrt(n * (base * (1 - base)))
    best = counts.filter((F.col("pos") >= support) & (F.col("pos") >= precision * n) & clear)
    rows = best.orderBy(F.desc("pos"), F.length("stem"), "stem").limit(max_stems * 40).collect()
    chosen: list[str] = []
    for r in rows:  # the shortest stem stands for the longer ones
        if not any(r["stem"].startswith(c) for c in chosen):
            chosen = [c for c in chosen if not c.startswith(r["stem"])] + [r["stem"]]
        if len(chosen) >= max_stems:
            break
    return chosen


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior P(toxic) of each row from binary votes; the given label is a voter of its own.

    Class-conditional vote rates come from expectation maximisation that starts at the labels. A voter's
    evidence is divided by the summed squared correlation with other voters within the classes. Voters that never
    or always vote tell nothing, and are left out, as they would all seem to correlate.
    """
    v = np.column_stack([votes > 0, labels > 0]).astype(float)
    v = v[:, (v.mean(0) > 0) & (v.mean(0) < 1)] if len(v) else v
    post = np.where(labels > 0, 0.9, 0.05)
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        p1 = (v.T @ post + 0.5) / (w1 + 1)
        p0 = (v.T @ (1 - post) + 0.5) / (w0 + 1)
        centred = v - (np.outer(post, p1) + np.outer(1 - post, p0))
        cov = centred.T @ centred
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        share = 1 / np.maximum(((cov / np.outer(d, d)) ** 2).sum(1), 1)
        odds = math.log(max(w1, 1e-9) / max(w0, 1e-9)) + (v * np.log(p1 / p0) * share + (1 - v) * np.log((1 - p1) / (1 - p0)) * share).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post


def _fold(x: np.ndarray, stems: int) -> np.ndarray:
    """Features of the linear classifier: presence and log counts of each stem, totals, patterns."""
    c = x[:, :stems]
    return np.column_stack([c > 0, np.log1p(c.sum(1)), (c > 0).any(1), x[:, stems:]]).astype(float)


def train_model(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_stems: int = 128, support: int = 4, precision: float = 0.8
) -> Model:
    """Fits on labelled rows that are not held out, max_rows of them at most, chosen by a hash of their id.

    Of rows that share an id one counts, that of the least hash of its text. max_stems bounds the voters, the
    columns of the model. The defaults of the last three come from folds of the training rows.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic is not null and doc_id is not null").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toArrow().sort_by("doc_id")  # max_rows pairs of numbers
    ids, toxic = chosen["doc_id"].to_numpy(), chosen["toxic"].to_numpy()

    def label(batches):
        """The chosen rows with their labels; no text is shuffled."""
        for b in batches:
            doc = b.column("doc_id").fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, doc), max(len(ids) - 1, 0))
            hit = (ids[at] == doc) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(doc), bool)
            rows = b.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(toxic[at[hit]] if len(ids) else [], pa.int32())], ["doc_id", "text", "toxic"])

    found = docs.select("doc_id", "text").mapInArrow(label, "doc_id long, text string, toxic int")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("row"))
    train = materialise(one.select("row.text", "row.toxic"), "training-rows")
    mined = _mine(train, max_stems, support, precision, float(np.mean(toxic > 0)) if len(toxic) else 0.0)
    fixed = [w for words in INSULTS.values() for w in words]
    stems = mined + [w for w in fixed if not any(w.startswith(m) for m in mined)]

    def vote(batches):
        a = _automaton(stems)
        for b in batches:
            x = features(b.column("text").to_pylist(), stems, a)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("toxic").cast(pa.int32())], ["x", "y"])

    rows = train.mapInArrow(vote, "x binary, y int").collect()
    width = len(_fold(np.zeros((1, len(stems) + 4)), len(stems))[0])
    if not rows:
        return Model(stems, np.zeros(width + 1), np.zeros(width), np.ones(width))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    y = np.array([r["y"] for r in rows])
    post = label_model(x, y)
    z = _fold(x, len(stems))
    mean, scale = z.mean(0), z.std(0) + 1e-3
    z = np.column_stack([(z - mean) / scale, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - post) + w)
    return Model(stems, w, mean, scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    Scores come from the text alone. Null and empty texts get the score of a text without votes; rows that
    repeat an id are scored each; without usable labels all scores are equal; an empty table gives none. Other columns
    are not read. A very long text is the work of one task.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train_model(docs, labels, **fit)

    def score(batches):
        a = _automaton(model.stems)
        for b in batches:
            z = (_fold(features(b.column("text").to_pylist(), model.stems, a), len(model.stems)) - model.mean) / model.scale
            p = 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
