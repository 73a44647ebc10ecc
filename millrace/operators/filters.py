"""Filters and the rule gate. Rows are rejected on positive evidence only."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import patterns as P
from millrace.functions.text import split_places, text_or_empty


def keyword_prefilter(df: DataFrame, include: Sequence[str] = (), require: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Over title and description. Any excluded word drops; with include or require lists one of each must occur."""
    text = F.lower(F.concat(text_or_empty(F.col("title")), F.lit(" "), text_or_empty(F.col("description"))))
    keep = F.lit(True)
    for words, wanted in ((exclude, False), (include, True), (require, True)):
        pattern = P.keywords(words)
        if pattern:
            keep = keep & (text.rlike(pattern) if wanted else ~text.rlike(pattern))
    return df.filter(keep)


def place_ok(location: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Blank passes; one acceptable place is enough; inside a place exclude beats include."""
    wanted, banned = P.keywords(include), P.keywords(exclude)
    if not wanted and not banned:
        return F.lit(True)

    def fine(p: Column) -> Column:
        ok = p.rlike(wanted) if wanted else F.lit(True)
        return ok & ~p.rlike(banned) if banned else ok

    return (text_or_empty(location) == "") | F.exists(split_places(location), fine)


def location_prefilter(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.filter(place_ok(F.col("location"), include, exclude))


@dataclass(frozen=True)
class GateRules:
    enabled: bool = True
    blocked_sources: Sequence[str] = tuple(rules.BLOCKED_SOURCES)
    title_reject: dict[str, list[str]] = field(default_factory=lambda: rules.TITLE_REJECT)
    location_allow: Sequence[str] = tuple(rules.LOCATION_ALLOW)
    location_deny: Sequence[str] = tuple(rules.LOCATION_DENY)


def gate_source(source: Column, blocked: Sequence[str]) -> Column:
    """P3."""
    low, out = F.lower(text_or_empty(source)), F.lit(None).cast("struct<rule:string,detail:string>")
    for name in reversed(list(blocked)):
        out = F.when(low.contains(name.lower()), F.struct(F.lit("source").alias("rule"), F.lit(name).alias("detail"))).otherwise(out)
    return out


def gate_title(title: Column, groups: dict[str, list[str]]) -> Column:
    """The first rule group that hits, with the text it hit."""
    title = text_or_empty(title)
    tries = [
        F.when(title.rlike(p), F.struct(F.lit(name).alias("rule"), F.regexp_extract(title, p, 0).alias("detail")))
        for name, p in P.rule_groups(groups).items()
    ]
    return F.coalesce(*tries, F.lit(None).cast("struct<rule:string,detail:string>"))


def gate_location(location: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """P5: a denied place and no allowed one anywhere."""
    location, no, yes = text_or_empty(location), P.alternation(deny), P.alternation(allow)
    return F.when(
        location.rlike(no) & ~location.rlike(yes), F.struct(F.lit("location").alias("rule"), F.regexp_extract(location, no, 0).alias("detail"))
    )


def gate(df: DataFrame, gate_rules: GateRules = GateRules()) -> DataFrame:
    """Adds ``gate``, struct (rule, detail); null passes."""
    if not gate_rules.enabled:
        return df.withColumn("gate", F.lit(None).cast("struct<rule:string,detail:string>"))
    return df.withColumn(
        "gate",
        F.coalesce(
            gate_source(F.col("source"), gate_rules.blocked_sources),
            gate_title(F.col("title"), gate_rules.title_reject),
            gate_location(F.col("location"), gate_rules.location_allow, gate_rules.location_deny),
        ),
    )


def is_internship(title: Column) -> Column:
    """P8."""
    return P.hit(title, P.FLAGS + rules.INTERNSHIP_TITLE)


def is_new_grad(title: Column) -> Column:
    """A new-graduate title that is no internship."""
    return P.hit(title, P.FLAGS + rules.NEW_GRAD_TITLE) & ~is_internship(title)


def is_watchlist_row(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Adds ``watched``: a board's source, or a company whose label is on the list (blank labels do not count)."""
    labels = watchlist.select(F.lower(F.trim("label")).alias("_label")).filter("_label <> ''").distinct().withColumn("_on", F.lit(True))
    found = df.join(labels, F.lower(F.col("company")) == F.col("_label"), "left")
    return found.withColumn("watched", F.coalesce(F.col("source").contains(":"), F.lit(False)) | F.col("_on").isNotNull()).drop("_label", "_on")


def section_allowed(section: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """P10: case-insensitive substrings of the heading; exclude beats include."""
    low = F.lower(text_or_empty(section))
    any_of = lambda words: F.greatest(F.lit(False), F.lit(False), *[low.contains(w.lower()) for w in words])
    ok = any_of(include) if include else F.lit(True)
    return ok & ~any_of(exclude) if exclude else ok


def row_flag_skip(flags: Column, closed: bool = True, no_sponsor: bool = False, citizenship: bool = False, advanced: bool = False) -> Column:
    """Whether a list row is skipped for a mark."""
    skip = F.lit(False)
    for name, on in (("closed", closed), ("no_sponsor", no_sponsor), ("citizenship", citizenship), ("advanced", advanced)):
        skip = skip | flags[name] if on else skip
    return skip


def unexpired_alerts(alerts: DataFrame, today: datetime.date) -> DataFrame:
    """The last day counts."""
    return alerts.filter(F.to_date("expires") >= F.lit(today))


def unexpired_seen(seen: DataFrame, now: datetime.datetime, days: int = 120) -> DataFrame:
    """Stamps that do not parse count as expired."""
    stamp = F.try_to_timestamp(F.col("alerted_at").cast("string"))
    return seen.filter(F.coalesce(stamp >= F.lit(now) - F.expr(f"interval {days} days"), F.lit(False)))
