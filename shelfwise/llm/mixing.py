"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import fresh, materialise

#: Sources up to which their plan, a row a source, is broadcast; beyond it is joined by shuffle.
MOST_SOURCES = 100_000
#: Fine slots of a source; a source of more blocks makes them finer.
SLOTS = 1 << 16


def exponent(shares: list[float], target_entropy: float, max_epochs: float, times: list[int] | None = None) -> float:
    """The largest exponent in [0, 1] whose weights reach the share target_entropy of the greatest entropy.

    times: how many sources have each share, where that is not one each.

    Weights are shares ** exponent, normalised. If the rarest source would then be read over max_epochs times
    while the commonest is read once, the exponent is raised until that limit holds.
    """
    times = [t for s, t in zip(shares, times or [1] * len(shares)) if s > 0]
    shares = [s for s in shares if s > 0]
    if sum(times) < 2:
        return 1.0

    def entropy(a: float) -> float:
        w = [s**a for s in shares]
        z = sum(x * t for x, t in zip(w, times))
        return -sum(t * x / z * math.log(x / z) for x, t in zip(w, times))

    def epochs(a: float) -> float:
        return (max(shares) / min(shares)) ** (1 - a)

    def bisect(fits) -> float:
        """The end of the range of exponents from 0 that fit; fits turns false once, upwards."""
        lo, hi = 0.0, 1.0
        if fits(hi):
            return hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
        return lo

    a = bisect(lambda x: entropy(x) >= target_entropy * math.log(sum(times)))
    limit = bisect(lambda x: epochs(x) > max_epochs)
    return a if epochs(a) <= max_epochs * (1 + 1e-9) else min(1.0, limit + 1e-12)


def plan_epochs(totals: dict[str, int], target_entropy: float, max_epochs: float) -> dict[str, float]:
    """How often each source is read, so that token shares get their weights and no source is read less than once."""
    whole = sum(totals.values())
    used = {s: t / whole for s, t in totals.items() if t > 0} if whole else {}
    a = exponent(list(used.values()), target_entropy, max_epochs)
    most = max(used.values(), default=1.0)
    return {s: (most / used[s]) ** (1 - a) if s in used else 1.0 for s in totals}


def source_plan(totals: DataFrame, target_entropy: float, max_epochs: float, block_tokens: int, min_blocks: int) -> DataFrame:
    """source, total, epochs, n_blocks of totals(source, tokens), as plan_epochs has them.

    The driver sees one row for each different total only: n tokens have at most sqrt(2 n) of them.
    """
    sizes = totals.filter("tokens > 0").groupBy("tokens").agg(F.count("*").alias("times")).orderBy("tokens").collect()
    whole = sum(r["tokens"] * r["times"] for r in sizes)
    a = exponent([r["tokens"] / whole for r in sizes], target_entropy, max_epochs, [r["times"] for r in sizes])
    most = sizes[-1]["tokens"] if sizes else 1
    epochs = F.when(F.col("tokens") > 0, F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - a))).otherwise(1.0)
    blocks = F.greatest(F.lit(min_blocks), F.ceil(F.col("tokens") / block_tokens)).cast("long")
    return totals.select("source", F.col("tokens").cast("double").alias("total"), epochs.alias("epochs"), blocks.alias("n_blocks"))


def mix(
    docs: DataFrame,
    target_entropy: float = 0.98,
    max_epochs: float = 2.0,
    block_tokens: int = 1_000_000,
    min_blocks: int = 64,
    seed: int = 17,
) -> DataFrame:
    """docs with columns n_tokens, epoch, block, mix_pos added, one row for each time that a document is read.

    Tokens are words [^\\x20\\x09-\\x0D]+ here. A source's documents fall into blocks by a hash of their id; every
    epoch reads the blocks in another order, and the last, partial epoch ends with the block that fills the
    source's budget. Sorting by mix_pos gives a stream that has the target weights throughout. Every document is
    read at least once. A null source is one of its own, null texts have no tokens, rows that repeat an id are
    read each. Columns of docs that have the new names are replaced.
    """
    new = ["n_tokens", "epoch", "block", "mix_pos"]
    docs = docs.select([c for c in docs.columns if c not in new])
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.withColumn("n_tokens", tokens)
    hashed = F.xxhash64(F.col("doc_id"), F.lit(seed))

    def fine(slots: int) -> DataFrame:
        """Tokens of fine slots: blocks are unions of slots, so the texts are read once for all totals."""
        return materialise(sized.groupBy("source", F.pmod(hashed, F.lit(slots)).alias("slot")).agg(F.sum("n_tokens").alias("tokens")), "slots")

    n_slots, held = SLOTS, fine(SLOTS)
    plan = materialise(source_plan(held.groupBy("source").agg(F.sum("tokens").alias("tokens")), target_entropy, max_epochs, block_tokens, min_blocks), "plan")
    facts = plan.agg(F.count("*").alias("n"), F.max("n_blocks").alias("blocks")).first()
    if (facts["blocks"] or 0) > n_slots:
        n_slots = 1 << (facts["blocks"] - 1).bit_length()
        held = fine(n_slots)
    small = F.broadcast if facts["n"] <= MOST_SOURCES else lambda df: df
    same = F.col("f.source").eqNullSafe(F.col("p.source"))
    slots = held.alias("f").join(small(plan.alias("p")), same).select("f.*", "p.epochs", "p.n_blocks", "p.total")
    blocks = slots.groupBy("source", "epochs", "total", (F.col("slot") % F.col("n_blocks")).alias("block")).agg(F.sum("tokens").alias("tokens"))
    runs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("epochs")).cast("int") - 1, F.lit(0)))))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)) + F.col("epoch") * F.col("total"))
    runs = runs.filter((F.col("epoch") == 0) | (F.col("before") < F.col("epochs") * F.col("total")))
    mix_pos = F.when(F.col("total") > 0, F.col("before") / (F.col("epochs") * F.col("total"))).otherwise(F.lit(0.0))
    runs = runs.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", mix_pos.alias("mix_pos")))).alias("runs"))
    count, run = fresh(docs, "_n_blocks"), fresh(docs, "_run")
    read = sized.alias("f").join(small(plan.select("source", F.col("n_blocks").alias(count)).alias("p")), same).select("f.*", f"p.{count}")
    read = read.withColumn("block", F.pmod(hashed, F.lit(n_slots)) % F.col(count)).drop(count)
    out = read.alias("d").join(runs.alias("r"), (F.col("d.block") == F.col("r.block")) & F.col("d.source").eqNullSafe(F.col("r.source")))
    return out.select("d.*", F.explode("r.runs").alias(run)).select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_tokens", F.col(f"{run}.epoch").alias("epoch"), "block", F.col(f"{run}.mix_pos").alias("mix_pos")
    )
