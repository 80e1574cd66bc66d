"""Personal data by candidate gradient boosting, in DataFrame operations only.

Strict rules give the base spans, which always stay. High-recall generators propose further spans that may
overlap each other and the base. Boosted trees over format and context features score the proposals. They are
fitted on counts of feature combinations over all documents (a table of bounded size). Labels come from evidence
that the features do not hold: a check digit for cards, the range of octets for addresses, an international prefix
for phones, a whole domain for mail. Prefixes mark some phones only, so their probability is divided by what held-out
documents with evidence reach on average. Each kind has a threshold of its own, calibrated on those documents.
Proposals over it, and clear of base spans, are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

# The kinds in the order of the rule set, and their patterns. Possessive forms match the same
# text as plain ones here, without retries; (?:\G|(?<!...)) keeps a search from starting anew inside a run.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wide forms: what differs from the base by separators, brackets, missing prefixes, or spelled-out signs.
PROPOSED = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[a-z0-9-]+(?:\.|\x20dot\x20)[a-z]{2}))[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++){1,8}+",
    "ip": r"(?<![0-9.,-])[0-9]{1,3}(?:[.,-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]){8,15}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
# Words that announce a kind, in the four languages, in the 24 characters before a span.
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|correo|écri",
    "ip": r"(?i)\bip\b|host|server|addr|login",
    "card": r"(?i)card|carte|karte|tarjeta|visa|credit|pay",
    "phone": r"(?i)tel|phone|call|fax|mobil|móvil|appel|anruf|llam",
}
FEATURES = ["kind", "digits", "groups", "first", "last", "parens", "before", "after", "context"]
#: Kinds of which much shows no evidence: phones are often written without a prefix. Cards always pass their check digit.
PARTIAL = ["phone"]
#: Share of the documents, by a hash of their text, that are held out to calibrate the thresholds.
HELD_OUT = 4


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _luhn(m: Column) -> Column:
    each = F.filter(F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), ""), lambda x: x != "")
    worth = F.transform(each, lambda x, i: x.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (x.cast("int") > 4), 9).otherwise(0))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The strict check of a match of a kind."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(_digits(m).between(16, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return _digits(m).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """All matches in order: an array of (s, e, m, before, after); s and e in code points, before up to 24 of them."""
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    gaps = F.split(text, pattern, -1)
    edges = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(24)).alias("before"), F.left(g, F.lit(1)).alias("after")))
    rows = F.arrays_zip(edges.alias("g"), F.slice(edges, 2, 2**31 - 1).alias("next"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    start = lambda a, x: a["at"] + x["g"]["n"]

    def step(a: Column, x: Column) -> Column:
        end = start(a, x) + F.length(x["m"])
        row = F.struct(start(a, x).alias("s"), end.alias("e"), x["m"].alias("m"), x["g"]["before"].alias("before"), x["next"]["after"].alias("after"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(row)).alias("out")))

    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(guard, walked).otherwise(none)


def _guards(text: Column) -> dict[str, Column]:
    """Cheap tests that a text can hold a kind at all."""
    digit = text.rlike("[0-9]")
    return {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": digit}


def evidence(kind: str, m: Column) -> Column:
    """What speaks for a proposal besides its features."""
    if kind == "ip":
        return F.forall(F.split(m, "[.,-]"), lambda p: p.try_cast("int") <= 255)
    if kind == "card":
        return F.when(_digits(m).between(13, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return m.rlike(r"^(?:\+|00)") & _digits(m).between(8, 15)
    return m.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")


def _class(c: Column) -> Column:
    """0 for nothing or white space, 1 for a letter or digit, 2 for others."""
    return F.when((c == "") | c.isNull() | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)


def _features(kind: str, x: Column) -> list[Column]:
    m = x["m"]
    groups = F.array_remove(F.split(m, "[^0-9]+"), "")
    # an international prefix is evidence, so the groups of a phone are counted without it
    groups = F.when(m.rlike(r"^(?:\+|00)"), F.slice(groups, 2, 99)).otherwise(groups) if kind == "phone" else groups
    size = lambda i: F.coalesce(F.length(F.try_element_at(groups, F.lit(i))), F.lit(0))
    digits = F.length(F.array_join(groups, ""))
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.least(digits, F.lit(20)),
        "groups": F.least(F.size(groups), F.lit(6)),
        "first": F.least(size(1), F.lit(6)),
        "last": F.least(size(-1), F.lit(6)),
        "parens": F.contains(m, F.lit("(")).cast("int"),
        "before": _class(F.right(x["before"], F.lit(1))),
        "after": _class(x["after"]),
        "context": x["before"].rlike(CONTEXT[kind]).cast("int"),
    }
    if kind == "email":  # its digits say nothing
        values |= {f: F.lit(0) for f in ("digits", "groups", "first", "last")}
    return [values[f].cast("int").alias(f) for f in FEATURES]


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, proposed, fold of docs: spans (kind, s, e), proposals with features and label y, and a hash."""
    text = F.col("t")
    guard = _guards(text)
    wide = guard | {"email": guard["email"] | text.rlike(r"(?i)\bat\b")}
    docs = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    fold = F.pmod(F.xxhash64("t"), F.lit(HELD_OUT)).cast("int").alias("fold")
    docs = docs.select("doc_id", fold, *[matches(text, BASE[k], guard[k]).alias(f"b_{k}") for k in KINDS], *[matches(text, PROPOSED[k], wide[k]).alias(f"p_{k}") for k in KINDS])

    def strict(i: int, k: str) -> Column:
        held = F.filter(f"b_{k}", lambda x: valid(k, x["m"]))
        return F.transform(held, lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def described(k: str) -> Column:
        label = lambda x: F.coalesce(evidence(k, x["m"]), F.lit(False)).cast("int").alias("y")
        return F.transform(f"p_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), label(x), *_features(k, x)))

    base = [strict(i, k) for i, k in enumerate(KINDS)]
    proposed = [described(k) for k in KINDS]
    return docs.select("doc_id", "fold", F.concat(*base).alias("base"), F.concat(*proposed).alias("proposed"))


@dataclass(frozen=True)
class Boosted:
    """Sum of small regression trees over integer features, and the threshold of the score, or one a kind."""

    trees: list
    start: float
    threshold: float
    by_kind: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_value(t, x) for t in self.trees), np.zeros(len(x)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients: (feature, bound, left, right) or a leaf's value."""
    leaf = float(rate * g.sum() / (h.sum() + 1.0))
    best = (1e-6, None, None)
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for b in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= b
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                if gain > best[0]:
                    best = (gain, f, b)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], int(best[2]), _grow(x[left], g[left], h[left], depth - 1, rate), _grow(x[~left], g[~left], h[~left], depth - 1, rate)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, b, left, right = tree
    return np.where(x[:, f] <= b, _value(left, x), _value(right, x))


def boost(x: np.ndarray, pos: np.ndarray, n: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.9) -> Boosted:
    """Fits to counts: n rows with features x, pos of them positive. The threshold gives the wanted precision."""
    if not len(x) or not pos.sum():
        return Boosted([], 0.0, math.inf)
    start = math.log((pos.sum() + 0.5) / (n.sum() - pos.sum() + 0.5))
    score, trees = np.full(len(x), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, pos - n * p, n * p * (1 - p), depth, rate)
        trees.append(tree)
        score = score + _value(tree, x)
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(pos[order]) / np.cumsum(n[order])
    held = np.flatnonzero(good >= precision)
    return Boosted(trees, start, float(score[order][held[-1]]) - 1e-9 if len(held) else math.inf)


def _tree_column(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, b, left, right = tree
    return F.when(x[FEATURES[f]] <= b, _tree_column(left, x)).otherwise(_tree_column(right, x))


def calibrate(model: Boosted, x: np.ndarray, pos: np.ndarray, n: np.ndarray, precision: float) -> tuple[float, ...]:
    """A threshold for each kind, from held-out counts.

    c is the share of a kind's personal data that shows evidence: all of it, but for kinds of PARTIAL evidence, where
    it is the mean probability of proposals with evidence. A proposal over the threshold is, by itself and not in the
    mean only, personal data with a probability / c of `precision` at least. Held-out proposals over it must show
    about the evidence that this promises, or the threshold rises until they do; a kind without evidence gets none.
    """
    out = []
    for kind, name in enumerate(KINDS):
        of = x[:, 0] == kind
        if not pos[of].sum():
            out.append(math.inf)
            continue
        score = model.score(x[of])
        p = 1 / (1 + np.exp(-score))
        c = float((p * pos[of]).sum() / pos[of].sum()) if name in PARTIAL else 1.0
        least = min(precision * c, 1 - 1e-9)
        order = np.argsort(-score, kind="stable")
        rate = np.cumsum(pos[of][order]) / np.cumsum(n[of][order])
        held = np.flatnonzero((p[order] >= least) & (rate >= 0.9 * least))
        out.append(float(score[order][held[-1]]) - 1e-9 if len(held) else math.inf)
    return tuple(out)


def fit(found: DataFrame, precision: float = 0.9, **options) -> Boosted:
    """Boosted trees from all documents' proposals, fitted on three folds of four and calibrated on the other."""
    # explode_outer: for explode, the optimiser would repeat the arrays in a filter below it
    seen = found.select("fold", F.explode_outer("proposed").alias("p")).filter("p is not null")
    table = seen.groupBy((F.col("fold") == 0).alias("held"), *[f"p.{f}" for f in FEATURES]).agg(F.sum("p.y").alias("pos"), F.count("*").alias("n"))
    rows = table.orderBy("held", *FEATURES).collect()  # every feature has a few values: a table of bounded size
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    pos, n = np.array([r["pos"] for r in rows], float), np.array([r["n"] for r in rows], float)
    held = np.array([r["held"] for r in rows], bool)
    model = boost(x[~held], pos[~held], n[~held], precision=precision, **options)
    return Boosted(model.trees, model.start, model.threshold, calibrate(model, x[held], pos[held], n[held], precision) if model.trees else ())


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of docs.

    spans lists kind:start:end (code points, end exclusive) by kind, then start; n_added of them are the method's.
    Added spans may overlap each other, never a base span. Null and empty texts have none; rows that repeat an id are
    searched each; an empty table gives none; without evidence for a kind nothing of it is added. Other columns are
    not read. A very long text is the work of one task.
    """
    # written, as the fit and the result both read it: spans and features only, no texts
    found = materialise(_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "candidates")
    model = fit(found, **options)
    if not any(math.isfinite(t) for t in model.by_kind):
        out = found.withColumn("added", F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    else:
        score = lambda p: sum((_tree_column(t, p) for t in model.trees), F.lit(model.start))
        least = F.array(*[F.lit(t) for t in model.by_kind])
        clear = lambda p: ~F.exists("base", lambda b: (b["s"] < p["e"]) & (p["s"] < b["e"]))
        chosen = F.filter("proposed", lambda p: clear(p) & (score(p) >= F.get(least, p["kind"])))
        out = found.select("doc_id", "base", F.array_distinct(F.transform(chosen, lambda p: F.struct(p["kind"], p["s"], p["e"]))).alias("added"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
