"""Suitability rules with all of their lists."""

import pytest

from shelfwise.functions.products import FIT_RULES
from shelfwise.operators import fitcheck
from tests.test_operators import PRODUCT, PROFILE, SCHEMA


def checked(spark, change):
    row = PRODUCT | PROFILE | change
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    got = fitcheck.check_fit(spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)).first()
    return got["verdict"], [tuple(r) for r in got["reasons"]]


def test_lists_are_whole():
    sizes = {"milk": 40, "eggs": 13, "gluten": 37, "peanuts": 6, "tree_nuts": 24, "soy": 15, "fish": 26, "crustaceans": 19, "mollusks": 20, "sesame": 8, "celery": 4, "mustard": 5, "lupin": 5, "sulfites": 18}
    assert {a: len(words) for a, words in FIT_RULES["synonyms"].items()} == sizes and sum(sizes.values()) == 240
    assert [len(FIT_RULES[k]) for k in ("trace_phrases", "sweeteners", "haram", "sugar")] == [18, 7, 10, 3]


def test_every_synonym_is_a_danger(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple((PRODUCT | PROFILE | {"ingredients": w.upper(), "user_allergens": [a]})[n] for n in names) for a, words in FIT_RULES["synonyms"].items() for w in words]
    got = fitcheck.check_fit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 240 and all([tuple(r) for r in g["reasons"]] == [("danger", "allergen", g["user_allergens"][0])] for g in got)


D, W, S = "danger", "warning", "safe"


@pytest.mark.parametrize(
    "change, verdict, reasons",
    [
        ({"ingredients": "Shrimp, mustard", "user_allergens": ["mustard", "crustaceans", "milk"]}, D, [(D, "allergen", "mustard"), (D, "allergen", "crustaceans")]),
        # traces are told of besides the synonym that is in the same text
        ({"ingredients": "Sugar. May contain celery", "user_allergens": ["celery"]}, D, [(D, "allergen", "celery"), (W, "trace", "celery")]),
        ({"ingredients": "x. Traces of rye", "conditions": ["celiac"]}, D, [(D, "health", "gluten"), (W, "trace", "gluten")]),
        # by phrase, then by allergen; each once
        (
            {"ingredients": "may contain soy" + " " * 100 + "не исключено наличие: молоко, soy", "user_allergens": ["milk", "soy"]},
            D, [(D, "allergen", "milk"), (D, "allergen", "soy"), (W, "trace", "milk"), (W, "trace", "soy")],
        ),
        ({"ingredients": "may contain " + "x" * 100 + " celery", "user_allergens": ["celery"]}, D, [(D, "allergen", "celery")]),
        ({"ingredients": "phenylalanine", "conditions": ["pku"]}, D, [(D, "health", "aspartame")]),
        ({"ingredients": "vodka", "halal_only": True}, D, [(D, "halal", "ingredient")]),
        ({"allergens": ["en:wheat-germ"], "conditions": ["celiac"]}, D, [(D, "health", "gluten")]),
        ({"allergens": ["en:milk"], "diets": ["vegan"]}, "caution", [("caution", "diet", "vegan")]),
        ({"ingredients": "milk", "diets": ["vegan"]}, S, []),
        # confirmations, unless there is a danger
        ({"halal_status": "yes", "halal_only": True, "user_allergens": ["milk"]}, S, [(S, "halal", "yes"), (S, "allergen", "none")]),
        ({"traces": ["en:soy"], "user_allergens": ["soy"], "halal_status": "yes", "halal_only": True}, W, [(W, "allergen", "soy"), (S, "halal", "yes")]),
        ({"ingredients": "milk", "user_allergens": ["milk"], "halal_status": "yes", "halal_only": True}, D, [(D, "allergen", "milk")]),
    ],
)
def test_rules(spark, change, verdict, reasons):
    assert checked(spark, change) == (verdict, reasons)
