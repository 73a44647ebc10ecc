"""Dates that are kept as text."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip, text_or_empty


def month_day(value: Column) -> Column:
    """"Jun 17"; what does not parse keeps its first ten characters; null is empty."""
    text = text_or_empty(value)
    day = F.left(strip(text), F.lit(10))
    parsed = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(parsed, "MMM d"), F.left(text, F.lit(10)))


def infer_full_date(value: Column, today: datetime.date) -> Column:
    """an ISO date, or "Jun 17" in the latest year that is not in the future, as minutes; else empty."""
    text = strip(text_or_empty(value))
    iso = F.when(F.left(text, F.lit(10)).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("yyyy-M-d")))
    short = F.when(text.rlike(r"^[A-Za-z]{3} +\d{1,2}$"), F.regexp_replace(F.initcap(text), " +", " "))
    in_year = lambda y: F.try_to_timestamp(F.concat(short, F.lit(f" {y}")), F.lit("MMM d yyyy"))
    this = in_year(today.year)
    guess = F.when(this.cast("date") <= F.lit(today), this).otherwise(in_year(today.year - 1))
    return F.coalesce(F.date_format(F.coalesce(iso, guess), "yyyy-MM-dd HH:mm"), F.lit(""))


def parsed_stamp(value: Column) -> Column:
    """An ISO timestamp, or null."""
    return F.try_to_timestamp(value)
