"""Column functions for dynamic-language text and number semantics: truthiness, parsing, normalising, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents folded to base letters and the sign unified to an apostrophe, and HTML entities of product
# pages in the order in which they are decoded.
ACCENTED = "éèêëáàâäíìîïóòôöúùûü`"
FOLDED = "eeeeaaaaiiiioooouuuu'"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&plusmn;", "±"), ("&mdash;", "—"), ("&deg;", "°")]
#: White space as page scripts know it: of all scripts, and the byte order mark.
SPACES = r"[\s\x0B\x{A0}\x{FEFF}\p{Z}]"


def truthy_or(a: Column, b: Column) -> Column:
    """a unless it is null or an empty string, else b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def truthy_number_or(a: Column, b: Column) -> Column:
    """a unless it is null, 0 or not a number, else b."""
    return F.coalesce(F.when(~F.isnan(a.cast("double")) & (a != 0), a), b)


def truthy_flag_or(a: Column, b: Column) -> Column:
    """a if it is true, else b."""
    return F.coalesce(F.when(a, a), b)


def strip(x: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def number_or_null(x: Column) -> Column:
    """A finite number, else null; blanks are null and nothing raises."""
    v = F.trim(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def leading_number(x: Column) -> Column:
    """The number a text starts with, as in '85 g'; a comma ends it."""
    return F.nullif(F.regexp_extract(x, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def decimal_number(x: Column) -> Column:
    """The same where the decimal sign may be a comma."""
    return leading_number(F.translate(x, ",", "."))


def scraped_number(x: Column) -> Column:
    """All digits and points of a text as one number; zero is null."""
    return F.nullif(F.regexp_replace(x, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def string_array(x: Column) -> Column:
    """A JSON array or a comma list as trimmed, non-blank, distinct items in first-seen order."""
    items = F.coalesce(F.from_json(x, "array<string>"), F.split(x, ","), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, lambda i: F.trim(i)), lambda i: i != ""))


def strip_html(x: Column) -> Column:
    """Visible text: line breaks and paragraph ends become commas, tags go, entities are decoded, commas collapse.

    What is left blank is null.
    """
    out = F.regexp_replace(x, r"(?i)<br\s*/?>|</p>", ", ")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, f",({SPACES}*,)+", ",")
    out = F.regexp_replace(out, f"^{SPACES}*,{SPACES}*", "")
    return F.nullif(F.regexp_replace(out, f"^{SPACES}+|{SPACES}+$", ""), F.lit(""))


def fold_accents(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, FOLDED)


def normalise_text(x: Column) -> Column:
    """Lower case, the signs ', ` and ´ gone, all but Latin and Cyrillic letters and digits to single spaces."""
    out = F.regexp_replace(F.lower(x), "['`´]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-zа-яё0-9\s]", " "), r"\s+", " "))


def normalise_brand(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^a-zа-яё0-9]", "")


def tokens(x: Column, stop_words: list[str]) -> Column:
    """Words of two or more letters that are no stop words, with repeats."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(F.split(normalise_text(x), " "), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the longer token list that the lists have in common; a's repeats count, empty lists give 0."""
    shared = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.greatest(F.size(a), F.size(b)))


def slug_title(x: Column) -> Column:
    """Words of a slug with the first letter raised and the rest as it is."""
    word = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))
    return F.array_join(F.transform(F.split(x, "-"), word), " ")


def language(x: Column) -> Column:
    """kz for any Kazakh letter, ru for any Cyrillic letter, else en."""
    return F.when(x.rlike("(?iu)[әғқңөұүһі]"), "kz").when(x.rlike("(?iu)[а-яё]"), "ru").otherwise("en")


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 4)


def content_hash(file: Column, heading: Column, content: Column) -> Column:
    return F.sha2(F.concat(file, F.char(F.lit(0)), F.coalesce(heading, F.lit("")), F.char(F.lit(0)), content), 256)


def half_star(quality: Column) -> Column:
    """A quality of 0 to 100 as 0 to 5 stars in halves."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.floor(quality / 100 * 10 + 0.5) / 2))


def traffic_light(x: Column, low: float, high: float) -> Column:
    return F.when(x > high, "high").when(x > low, "medium").when(x.isNotNull(), "low")


def age_bucket(ts: Column, as_of: Column) -> Column:
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    unit = lambda n, u: F.concat((F.floor(s / n)).cast("string"), F.lit(u))
    return F.when(s < 60, "now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def clamp_small(x: Column, low: int, high: int) -> Column:
    """Rounded half up and clamped; not a number is null."""
    return F.when(~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x + 0.5))))
