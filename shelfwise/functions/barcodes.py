"""Barcode checks and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix ranges and their countries, and parts of addresses that tell where an image is kept.
PREFIXES = [
    ("000", "139", "US/CA"), ("300", "379", "FR"), ("400", "440", "DE"), ("460", "469", "RU"), ("487", "487", "KZ"), ("500", "509", "UK"),
    ("540", "549", "BE/LU"), ("560", "569", "PT"), ("570", "579", "DK"), ("590", "599", "PL"), ("600", "639", "ZA"), ("640", "649", "FI"),
    ("700", "709", "NO"), ("730", "739", "SE"), ("760", "769", "CH"), ("800", "839", "IT"), ("840", "849", "ES"), ("860", "869", "TR"),
    ("870", "879", "NL"), ("900", "919", "AT"), ("930", "939", "AU"),
]
IMAGE_SOURCES = [("openfoodfacts.org", "openfoodfacts"), ("cdn-kaspi.kz", "kaspi"), ("arbuz.kz", "arbuz"), ("ean-db.com", "ean-db"), ("/products/", "local")]


def _weighted(x: Column, n: int, first: int) -> Column:
    """Check digit over the first n digits with weights first, 4 - first, first, ..."""
    digits = [F.substring(x, i + 1, 1).cast("int") * (first if i % 2 == 0 else 4 - first) for i in range(n)]
    total = digits[0]
    for d in digits[1:]:
        total = total + d
    return (10 - total % 10) % 10


def is_valid_ean(x: Column) -> Column:
    """EAN-13 and EAN-8 with a right check digit, and any 12 digits."""
    last = lambda n: F.substring(x, n, 1).cast("int")
    return (
        F.when(x.rlike("^[0-9]{13}$"), _weighted(x, 12, 1) == last(13))
        .when(x.rlike("^[0-9]{12}$"), F.lit(True))
        .when(x.rlike("^[0-9]{8}$"), _weighted(x, 7, 3) == last(8))
        .otherwise(F.lit(False))
    )


def padded_ean13(x: Column) -> Column:
    """12 digits with a computed check digit appended; others as they are."""
    return F.when(x.rlike("^[0-9]{12}$"), F.concat(x, _weighted(x, 12, 1).cast("string"))).otherwise(x)


def country(x: Column) -> Column:
    """GS1 country of a 13-digit code; short codes are internal, others unknown."""
    out = F.lit("unknown")
    for lo, hi, name in reversed(PREFIXES):
        out = F.when(F.substring(x, 1, 3).between(lo, hi), name).otherwise(out)
    return F.when(F.length(x) < 7, "internal").when(x.rlike("^[0-9]{13}$"), out).otherwise("unknown")


def image_source(url: Column, own_host: str | None = None) -> Column:
    """Where an image is kept, by the first part of its address that fits; own_host is the shop's own store, r2.

    The shop's own addresses with /products/ in them count as local, as that part comes first.
    """
    out = F.when(url.contains(own_host), "r2").otherwise("other") if own_host else F.lit("other")
    for part, name in reversed(IMAGE_SOURCES):
        out = F.when(url.contains(part), name).otherwise(out)
    return F.when(F.nullif(url, F.lit("")).isNotNull(), out)


def object_key(ean: Column, kind: str, url: Column) -> Column:
    """products/<ean>/<kind>.<ext>, the extension from the address, jpg if it has none."""
    ext = F.lower(F.regexp_extract(url, r"(?i)\.(png|jpe?g|gif|webp|avif)(?:\?|$)", 1))
    ext = F.when(ext.isin("", "jpeg"), "jpg").otherwise(ext)
    return F.concat(F.lit("products/"), ean, F.lit(f"/{kind}."), F.coalesce(ext, F.lit("jpg")))
