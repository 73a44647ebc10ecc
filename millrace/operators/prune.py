"""Pruning a tracker to the best rows of each company."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import patterns as P
from millrace.functions.text import clean_cell, text_or_empty
from millrace.operators.ordered import first_by
from millrace.operators.stats import live
from millrace.operators.tracker import soft_delete
from millrace.schemas import USER


@dataclass(frozen=True)
class PruneRules:
    keep: int = 2


def _has(c: Column, pattern: str) -> Column:
    return P.hit(c, P.FLAGS + pattern)


def _any_word(c: Column, words: list[str]) -> Column:
    return F.greatest(*[F.contains(c, F.lit(w)) for w in words])


def hard_excluded(title: Column, location: Column, why: Column, concerns: Column) -> Column:
    """The first reason against a row, or null."""
    title, low = text_or_empty(title), F.lower(text_or_empty(location))
    blob = F.concat_ws(" ", title, text_or_empty(why), text_or_empty(concerns))
    rescued = _has(title, rules.GRAD_RESCUE)
    level = F.when(F.lower(title).contains("technical staff"), F.replace(F.lower(title), F.lit("technical staff"), F.lit(""))).otherwise(title)
    senior = _has(level, rules.SENIOR) | _has(title, rules.LEVEL_3)
    years = F.coalesce(F.nullif(F.regexp_extract(title, P.FLAGS + rules.YEARS, 1), F.lit("")).try_cast("int"), F.lit(0))
    engineer = _has(title, rules.ENGINEERING)
    for tier in rules.TIERS:
        engineer = engineer | _has(title, tier)
    return (
        F.when(_has(blob, rules.WRONG_CYCLE), "wrong cycle")
        .when(_has(title, rules.PHD), "PhD role")
        .when(senior & ~rescued, "too senior")
        .when((years >= 2) & ~rescued, "needs 2+ yrs")
        .when(_has(blob, rules.DEGREE), "advanced degree required")
        .when(_has(title, rules.HARD_OTHER), "non-engineering")
        .when(_has(title, rules.SOFT_OTHER) & ~engineer, "non-engineering")
        .when(_has(title, rules.QUANT) & ~_has(title, rules.QUANT_RESCUE), "quant specialist")
        .when(~_any_word(low, rules.PLACES_KEPT), "location")
    )


def is_protected() -> Column:
    """Any user column with a real value."""
    out = F.lit(False)
    for c in USER:
        out = out | (clean_cell(F.col(c)) != "")
    return out


def is_engaged() -> Column:
    """P14."""
    return (clean_cell(F.col("status")) != "") | (clean_cell(F.col("date_applied")) != "")


def fit_rank() -> list[Column]:
    """Tier, place, mention of 2027, score, key."""
    title, low = text_or_empty(F.col("title")), F.lower(text_or_empty(F.col("location")))
    tier = F.lit(4)
    for i, pattern in reversed(list(enumerate(rules.TIERS))):
        tier = F.when(_has(title, pattern), i).otherwise(tier)
    place = F.when(_any_word(low, rules.PLACES_FIRST), 0).when(_any_word(low, rules.PLACES_SECOND), 1).otherwise(2)
    blob = F.concat_ws(" ", title, text_or_empty(F.col("reason")), text_or_empty(F.col("concerns")))
    return [tier, place, F.when(_has(blob, rules.MENTIONS_2027), 0).otherwise(1), F.desc(F.coalesce(F.col("score"), F.lit(0))), F.col("key")]


def plan_prunes(rows: DataFrame, prune_rules: PruneRules = PruneRules()) -> DataFrame:
    """Keys to prune among live rows: all but protected ones and, per company, the best few of those not excluded."""
    marked = rows.withColumn("_safe", is_protected()).withColumn("_why", hard_excluded(F.col("title"), F.col("location"), F.col("reason"), F.col("concerns")))
    open_ = marked.filter(~F.col("_safe"))
    best = first_by(open_.filter("_why is null").withColumn("_c", F.lower(F.trim(text_or_empty(F.col("company"))))), ["_c"], *fit_rank(), n=prune_rules.keep)
    return open_.select("key", F.coalesce("_why", F.lit("over the limit")).alias("why")).join(best.select("key"), "key", "left_anti")


def prune_apply(tracker: DataFrame, now: str, prune_rules: PruneRules = PruneRules()) -> DataFrame:
    """T5."""
    return soft_delete(tracker, plan_prunes(live(tracker), prune_rules), "prune", now)
