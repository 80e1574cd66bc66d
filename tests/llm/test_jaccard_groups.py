"""Groups of one prefix whose members lie in several components, against brute force."""

import numpy as np
import pytest

jaccard_join = pytest.importorskip("shelfwise.llm.jaccard_join")


def words(n, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n)]


def shingles(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def least(rows, k, num, den):
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return {i: min(rows[x][0] for x in range(len(rows)) if root[x] == r) for (i, _), r in zip(rows, root)}


@pytest.mark.parametrize("order", [(1, 2, 3, 4), (4, 3, 2, 1), (2, 1, 3, 4), (1, 3, 2, 4)])
def test_later_members_of_two_linked_groups_meet(spark, order):
    """Two ends and two heads of one text: the heads are alike, the ends are not, and both ends are frequent."""
    head, one, two = words(120, 1), words(80, 2), words(80, 3)
    changed = [*head[:60], "other", *head[61:]]
    texts = [head + one, head + two, changed + one, changed + two]
    rows = [(i, " ".join(t)) for i, t in zip(order, texts)]
    rows += [(100 * (1 + s) + i, " ".join(head[-2:] + end)) for s, end in enumerate((one, two)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, k=3, num=9, den=10).collect()}
    assert got == least(rows, 3, 9, 10)
