"""A knowledge base of additives as a dimension, and what it says of products by their ingredients.

The knowledge base is Markdown: a section an additive, `### E120 — name`, with one line a property. Ingredients are
texts, whose items end at commas, semicolons and line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import strip

# Names of the properties, and of the halal procedure its forbidden words and codes, doubtful words, the
# doubtful codes by the mark that clears them, and these marks.
PROPERTIES = {"origin": "Происхождение", "halal": "Халал", "allergen": "Аллерген", "vegan": "Веган", "note": "Примечание"}
FORBIDDEN_WORDS = ["свиной жир", "lard", "pork fat", "свинина", "алкоголь", "ethanol", "ethyl alcohol", "спирт этиловый", "кармин", "cochineal", "шеллак", "shellac"]
FORBIDDEN_CODES = ["E120", "E904"]
DOUBTFUL_WORDS = ["желатин", "gelatin"]
DOUBTFUL_UNLESS_PLANT = ["E471", "E472a", "E472b", "E472c", "E472d", "E472e", "E470a", "E422", "E322"]
DOUBTFUL_UNLESS_SYNTHETIC = ["E631"]
DOUBTFUL_CODES = ["E481", "E482", "E483"]
PLANT_MARKS = ["растительн", "халял"]
SYNTHETIC_MARKS = ["синтетич"]

HEADING = r"^[ \t]*(E[0-9]{3,4}[a-z]?)[ \t]*[—–-][ \t]*([^\r\n]*)"


def sections(pages: DataFrame, source: str = "source_file", content: str = "content") -> DataFrame:
    """code, name, origin, halal, allergen, vegan, note and verdict of each additive in Markdown pages.

    Sections without a code in their heading are none. Of sections with one code the first counts, by source (nulls
    first) and place; of properties that repeat in a section too. Missing ones are null. verdict is that of halal (see
    verdict); "как E471" takes that additive's own, and is doubtful where that is not known.
    """
    parts = pages.select(F.col(source).alias("source"), F.posexplode(F.split(content, r"(?m)^### ")).alias("at", "part")).filter("at > 0")
    value = lambda title: F.nullif(strip(F.regexp_extract("part", rf"(?m)^- \*\*{title}:\*\*([^\r\n]*)", 1)), F.lit(""))
    read = parts.select(
        "source", "at", F.regexp_extract("part", HEADING, 1).alias("code"), strip(F.regexp_extract("part", HEADING, 2)).alias("name"), *[value(t).alias(c) for c, t in PROPERTIES.items()]
    ).filter("code <> ''")
    facts = ["name", *PROPERTIES]
    first = read.groupBy("code").agg(F.min(F.struct("source", "at", *facts)).alias("r")).select("code", *[F.col(f"r.{c}").alias(c) for c in facts])
    own = first.withColumn("own", verdict(F.col("halal"))).withColumn("as_code", F.regexp_extract("halal", r"(?i)^как (E[0-9]{3,4}[a-z]?)", 1))
    other = own.select(F.col("code").alias("as_code"), F.col("own").alias("others"))
    return own.join(other, "as_code", "left").select("code", *facts, F.when(F.col("own") == "as", F.coalesce(F.nullif("others", F.lit("as")), F.lit("doubtful"))).otherwise(F.col("own")).alias("verdict"))


def verdict(halal: Column) -> Column:
    """forbidden, doubtful, allowed, as (another additive), or null, of what a section says.

    No is forbidden. What holds doubts or disputes, or a no after a yes, is doubtful.
    """
    x = F.lower(halal)
    return (
        F.when(x.startswith("нет"), "forbidden")
        .when(x.contains("сомнит") | x.contains("спорно") | x.rlike(r"^да.*[ ,(]нет"), "doubtful")
        .when(x.startswith("как "), "as")
        .when(x.startswith("да"), "allowed")
    )


def item_words(item: Column) -> Column:
    """An item's words in lower case, each between spaces; a code is one word, however it is written (E-471, е 471)."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(item), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(plain, " +", " "), r" [eе] ?([0-9]{3,4}[a-i]?)(?= )", " e$1")


def item_codes(words: Column) -> Column:
    """Codes among an item's words, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(words, " "), lambda w: w.rlike("^e[0-9]{3,4}[a-i]?$")), lambda w: F.concat(F.lit("E"), F.substr(w, F.lit(2)))))


def _any(words: Column, sought: list[str], whole: bool = True) -> Column:
    return F.exists(F.array(*map(F.lit, sought)), lambda s: F.contains(words, F.concat(F.lit(" "), s, F.lit(" ")) if whole else s))


def findings(products: DataFrame, key: str, ingredients: str, additives: DataFrame) -> DataFrame:
    """One row for each word or code of the procedure, and each known or unknown code, in each item of each product.

    Columns: key (the product's), at (the item's number from 0), found (a word, or a code), kind (forbidden, doubtful, allowed or
    unknown), and allergen, vegan of its section.
    """
    items = products.select(F.col(key).alias("key"), F.posexplode(F.split(ingredients, "[,;\r\n]")).alias("at", "item")).select("key", "at", item_words(F.col("item")).alias("words"))
    words = F.col("words")
    plant, synthetic = _any(words, PLANT_MARKS, False), _any(words, SYNTHETIC_MARKS, False)
    named = lambda sought, kind: F.transform(F.filter(F.array(*map(F.lit, sought)), lambda s: F.contains(words, F.concat(F.lit(" "), s, F.lit(" ")))), lambda s: F.struct(s.alias("found"), F.lit(kind).alias("kind")))
    ruled = lambda c: F.when(c.isin(FORBIDDEN_CODES), "forbidden").when(c.isin(DOUBTFUL_CODES) | c.isin(DOUBTFUL_UNLESS_PLANT) & ~plant | c.isin(DOUBTFUL_UNLESS_SYNTHETIC) & ~synthetic, "doubtful").when(c.isin(DOUBTFUL_UNLESS_PLANT + DOUBTFUL_UNLESS_SYNTHETIC), "allowed")
    all_found = F.concat(named(FORBIDDEN_WORDS, "forbidden"), F.filter(named(DOUBTFUL_WORDS, "doubtful"), lambda _: ~plant), F.transform(item_codes(words), lambda c: F.struct(c.alias("found"), ruled(c).alias("kind"))))
    found = items.withColumn("f", F.explode(all_found)).select("key", "at", "f.found", F.col("f.kind").alias("ruled"))
    dim = additives.select(F.col("code").alias("found"), "verdict", "allergen", "vegan")
    kind = F.coalesce("ruled", "verdict", F.when(F.col("found").rlike("^E[0-9]"), "unknown"))
    return found.join(dim, "found", "left").select("key", "at", "found", kind.alias("kind"), "allergen", "vegan")


def halal_decisions(products: DataFrame, key: str, ingredients: str, status: str, additives: DataFrame) -> DataFrame:
    """What the procedure decides of each product, and why: key, decision, basis, n_codes, unknown_codes, not_vegan, allergens.

    A certificate (status yes) makes a product halal, a status of no makes it not_halal, its ingredients unseen. Else a
    forbidden find makes it not_halal, a doubtful one doubtful, none probable; basis is the find that decides, the first
    in the text (ties: in code point order), or certificate, status or ingredients (nothing found). Rows that share a key
    are one product, whose certificate counts if any row has it, and then its no. The other columns tell of all codes:
    how many differ, which the knowledge base lacks, which are not vegan, which it calls allergens. Null ingredients
    hold nothing; a null key is a key.
    """
    held = products.select(F.col(key).alias("key"), F.col(status).alias("_status"), F.col(ingredients).alias("_text"))
    rank = F.when(F.col("kind") == "forbidden", 0).when(F.col("kind") == "doubtful", 1)
    code = F.when(F.col("found").rlike("^E[0-9]"), F.col("found"))
    say = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, code))), ",")
    starts = lambda c, *p: F.coalesce(F.lower(c).rlike(f"^({'|'.join(p)})"), F.lit(False))
    # a row for each product beside its finds, so that one aggregation does for both
    rows = held.select("key", "_status", F.lit(None).cast("int").alias("at"), *[F.lit(None).cast("string").alias(c) for c in ("found", "kind", "allergen", "vegan")])
    both = rows.unionByName(findings(held, "key", "_text", additives).withColumn("_status", F.lit(None).cast("string")))
    g = both.groupBy("key").agg(
        F.max((F.lower("_status") == "yes").cast("int")).alias("yes"), F.max((F.lower("_status") == "no").cast("int")).alias("no"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "at", "found"))).alias("worst"), F.count_distinct(code).alias("n_codes"),
        say(F.col("kind") == "unknown").alias("unknown_codes"), say(starts("vegan", "нет")).alias("not_vegan"), say(starts("allergen", "да")).alias("allergens"),
    )
    by = lambda a, b, c, d, e: F.when(F.col("yes") == 1, a).when(F.col("no") == 1, b).when(F.col("worst.rank") == 0, c).when(F.col("worst.rank") == 1, d).otherwise(e)
    found = F.col("worst.found")
    return g.select(
        F.col("key").alias(key), by("halal", "not_halal", "not_halal", "doubtful", "probable").alias("decision"), by(F.lit("certificate"), F.lit("status"), found, found, F.lit("ingredients")).alias("basis"),
        "n_codes", "unknown_codes", "not_vegan", "allergens",
    )
