"""Tasks hand on what they find in pieces of bounded size, with the same results as whole."""

import numpy as np

from shelfwise.operators import dictionary, retrieval


def test_entries_found_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "HELD", 3)
    monkeypatch.setattr(dictionary, "PASS_CHARS", 4)
    terms = [("a", "ab"), ("b", "ab"), ("a", "bc"), ("c", "é"), ("c", "x"), ("c", "")]
    texts = [(1, "abc abc"), (2, None), (3, ""), (4, "zé AB"), (5, "nothing"), (6, "x" * 5), (7, "bcab")]
    rows = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    got = dictionary.find_terms(rows, "t", spark.createDataFrame(terms, "tag string, term string")).collect()
    want = {i: sorted(((t or "").lower().index(w), w, g) for g, w in terms if w and w in (t or "").lower()) for i, t in texts}
    assert [r["id"] for r in got] == [i for i, _ in texts]
    assert {r["id"]: [(x["at"], x["term"], x["tag"]) for x in r["found"]] for r in got} == want


def test_similarities_are_computed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 7)
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)] + [(40, [1.0, 2.0]), (41, [2.0, 4.0]), (42, []), (43, None), (44, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["place"]): r["vec_id"] for r in retrieval.nearest_to_each(v, v.filter("vec_id % 2 = 0"), 5).collect()}
    want = {}
    for q, e in rows[::2]:
        near = []
        for i, o in rows:
            if i != q and e and o and len(e) == len(o) and any(e) and any(o):
                near.append((-round(float(np.dot(e, o)) / (np.linalg.norm(e) * np.linalg.norm(o)), 9), i))
        want[q] = sorted(near)
    for (q, place), i in got.items():
        s = dict((o, s) for s, o in want[q])
        assert s[i] == want[q][place - 1][0]
    assert {(q, n + 1) for q, w in want.items() for n in range(min(5, len(w)))} == set(got)
