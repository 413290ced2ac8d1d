"""Text normalization as native column expressions.

Only Unicode compatibility folding needs Python; it runs as an Arrow UDF. Callers keep
rows of pure ASCII away from it (``nfkc=False``), as :func:`normalize_entities` does.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Token and country aliases that results have to agree on.
COMPANY_TOKENS = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "limited": "ltd", "ltd": "ltd",
    "llc": "llc", "plc": "plc", "pvt": "pvt", "private": "pvt", "public": "public",
}
ADDRESS_TOKENS = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "boulevard": "blvd", "blvd": "blvd",
    "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "parkway": "pkwy", "pkwy": "pkwy", "highway": "hwy", "hwy": "hwy",
    "suite": "ste", "ste": "ste", "building": "bldg", "bldg": "bldg", "floor": "fl", "fl": "fl",
}
COUNTRY_ALIASES = {
    "usa": "united states", "us": "united states", "u s": "united states", "u s a": "united states",
    "uk": "united kingdom", "gb": "united kingdom", "great britain": "united kingdom",
    "uae": "united arab emirates", "u a e": "united arab emirates",
    "ind": "india", "india": "india", "can": "canada", "ca": "canada", "canada": "canada", "aus": "australia", "australia": "australia",
    "de": "germany", "deu": "germany", "germany": "germany", "fr": "france", "fra": "france", "france": "france",
    "jp": "japan", "jpn": "japan", "japan": "japan", "sg": "singapore", "sgp": "singapore", "singapore": "singapore",
}


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_text(value: Column, nfkc: bool = True) -> Column:
    """Lower-case; every run outside ``[a-z0-9]`` becomes one blank; NULL gives ''."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    if nfkc:
        value = F.coalesce(_nfkc(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def map_tokens(normalized: Column, aliases: dict[str, str]) -> Column:
    known = _literal_map(aliases)
    return F.array_join(F.transform(F.split(normalized, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def normalize_name(value: Column, nfkc: bool = True) -> Column:
    return map_tokens(normalize_text(value, nfkc), COMPANY_TOKENS)


def normalize_address(value: Column, nfkc: bool = True) -> Column:
    return map_tokens(normalize_text(value, nfkc), ADDRESS_TOKENS)


def normalize_country(value: Column, nfkc: bool = True) -> Column:
    text = normalize_text(value, nfkc)
    return F.coalesce(F.try_element_at(_literal_map(COUNTRY_ALIASES), text), text)


def parse_match_list(value: Column) -> Column:
    """Ids of ``a,b``, ``[a, b]`` or ``['a','b']`` as a distinct array.

    NULL, '' and ``[]`` give an empty array. An id cannot contain a comma.
    """
    inner = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\[|\]$", "")
    ids = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def format_match_list(ids: Column) -> Column:
    """Sorted, comma-separated ids, or ``[]``."""
    joined = F.array_join(F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))), ",")
    return F.when(joined == "", F.lit("[]")).otherwise(joined)


def initials(name: Column) -> Column:
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    one = F.substring(F.try_element_at(words, F.lit(1)), 1, 2)
    two = F.concat(F.substring(F.try_element_at(words, F.lit(1)), 1, 1), F.substring(F.try_element_at(words, F.lit(-1)), 1, 1))
    return F.upper(F.when(F.size(words) == 0, "").when(F.size(words) == 1, one).otherwise(two))


def preview(text: Column, length: int = 140, leeway: int = 5) -> Column:
    """Text cut to ``length`` with ``...``; texts within the leeway stay whole."""
    return F.when(F.length(text) > length + leeway, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)
