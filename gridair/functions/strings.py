"""Names, slugs, cities, numbers and fuzzy words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair import constants as C


def normalise_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def slug(name: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def city_of(name: Column) -> Column:
    """City of a station name 'Site, City - Agency' or 'Site - City - Agency'."""
    parts = F.transform(F.split(name, " - "), lambda p: F.trim(p))
    body = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    with_comma = F.filter(body, lambda p: p.contains(","))
    last_comma = F.try_element_at(with_comma, F.lit(-1))
    return F.coalesce(F.trim(F.substring_index(last_comma, ",", -1)), F.element_at(body, -1))


def spaced(name: Column) -> Column:
    """Trimmed lower case with single spaces."""
    return F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")


def city_key(name: Column) -> Column:
    """Canonical city key: spacing and case removed, known aliases replaced."""
    key = spaced(name)
    pairs = [F.lit(x) for kv in C.CITY_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def people(n: Column) -> Column:
    """Head counts in words: millions from a million on, grouped thousands below."""
    return F.when(n >= 1e6, F.concat(F.format_number(n / 1e6, 1), F.lit(" million"))).otherwise(F.format_number(n, 0))


def people_indian(n: Column, crore: str = "crore", lakh: str = "lakh") -> Column:
    """Head counts in crore and lakh."""
    return (F.when(n >= 1e7, F.concat(F.format_number(n / 1e7, 1), F.lit(f" {crore}")))
            .when(n >= 1e5, F.concat(F.format_number(n / 1e5, 1), F.lit(f" {lakh}")))
            .otherwise(F.format_number(n, 0)))


def percent(share: Column) -> Column:
    return F.format_number(share * 100.0, 0)


def numbers(text: Column) -> Column:
    """All numbers in a text as doubles; commas removed, Devanagari digits mapped."""
    plain = F.replace(F.translate(text, "०१२३४५६७८९", "0123456789"), F.lit(","), F.lit(""))
    hits = F.regexp_extract_all(plain, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(hits, lambda h: h.cast("double"))


def similarity(a: Column, b: Column) -> Column:
    """Fuzzy equality of two words: 1 when equal, 0 when either is shorter than four letters, else the share
    of letters that need no edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.when(a == b, F.lit(1.0)).when((F.length(a) < 4) | (F.length(b) < 4), F.lit(0.0))
            .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest.cast("double")))


def hash_number(text: Column) -> Column:
    """A number below 2**32 from the first eight hex digits of a text's md5: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
