"""The three keys of a posting. They differ on white space; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip, text_or_empty


def _choice(url: Column, title: Column, company: Column) -> Column:
    url = text_or_empty(url)
    return F.when(url != "", url).otherwise(F.concat(text_or_empty(title), F.lit("|"), text_or_empty(company)))


def dedupe_key(url: Column, title: Column, company: Column) -> Column:
    """K1: lower case of the url or title|company, not trimmed."""
    return F.lower(_choice(url, title, company))


def fingerprint(url: Column, title: Column, company: Column) -> Column:
    """K2: the same choice, trimmed, lower case; the first 16 hex digits of its SHA-256."""
    return F.substring(F.sha2(F.encode(F.lower(strip(_choice(url, title, company))), "UTF-8"), 256), 1, 16)


def row_key(url: Column, title: Column, company: Column) -> Column:
    """K3: the trimmed url, or trimmed title|company where that is empty; lower case."""
    url = strip(text_or_empty(url))
    both = F.concat(strip(text_or_empty(title)), F.lit("|"), strip(text_or_empty(company)))
    return F.lower(F.when(url != "", url).otherwise(both))
