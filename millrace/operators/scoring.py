"""Classification labels to an explainable score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import patterns as P
from millrace.functions.keys import fingerprint
from millrace.functions.text import once, strip, text_or_empty
from millrace.schemas import CLASSIFICATION

LABELS = [f.split()[0] for f in CLASSIFICATION.split(", ")]


@dataclass(frozen=True)
class Scoring:
    family_base: dict[str, int] = field(default_factory=lambda: rules.FAMILY_BASE)
    seniority_delta: dict[str, int] = field(default_factory=lambda: rules.SENIORITY_DELTA)
    start_delta: dict[str, int] = field(default_factory=lambda: rules.START_DELTA)
    max_years: int = 1
    location_bonus: int = 1
    focus_bonus: int = 1
    skill_bonus: int = 1
    skills_least: int = 3
    reject_score: int = 1
    threshold: int = 7
    location_allow: Sequence[str] = tuple(rules.LOCATION_ALLOW)


def parse_classification(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """JSON text to labels; rows that break the schema go to the second frame, not to the matches."""
    parsed = df.withColumn("labels", F.from_json(column, CLASSIFICATION, {"mode": "PERMISSIVE"}))
    label = lambda n: F.col(f"labels.{n}")
    ok = (
        label("role_family").isin(rules.ROLE_FAMILIES)
        & label("seniority").isin(rules.SENIORITIES)
        & label("start_timing").isin(rules.START_TIMINGS)
        & label("min_years_experience").between(0, 15)
        & label("clearance_required").isNotNull()
        & label("advanced_degree_required").isNotNull()
        & label("matched_skills").isNotNull()
        & label("evidence").isNotNull()
    )
    marked = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.filter("_ok").drop("_ok"), marked.filter("not _ok").drop("_ok")


def rule_classifier(df: DataFrame, skills: Sequence[str] = tuple(rules.SKILLS)) -> DataFrame:
    """The default classifier: labels from rules over title and description."""
    title, text = text_or_empty(F.col("title")), F.concat_ws(" ", F.col("title"), F.col("description"))
    sec, ai, infra, swe = (P.hit(title, P.FLAGS + t) for t in rules.TIERS)
    family = (
        F.when(P.hit(title, P.FLAGS + rules.HARD_OTHER), "non_technical").when(sec, "security").when(ai, "ml_ai").when(infra, "infra_devops")
        .when(P.hit(title, P.FLAGS + r"\bdata\b"), "data").when(swe, "software_engineering").otherwise("other_technical")
    )
    seniority = (
        F.when(P.hit(title, P.FLAGS + rules.INTERNSHIP_TITLE), "intern").when(P.hit(title, P.FLAGS + rules.SENIOR), "senior_plus")
        .when(P.hit(title, P.FLAGS + rules.NEW_GRAD_TITLE), "new_grad").when(P.hit(title, P.FLAGS + r"\bjunior\b"), "junior").otherwise("unclear")
    )
    years = F.try_to_number(F.nullif(F.regexp_extract(text, P.FLAGS + rules.YEARS, 1), F.lit("")), F.lit("99"))
    named = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lower(F.lit(s))), F.lit(s)) for s in skills]))
    found = once(F.lower(text), named) if skills else F.array().cast("array<string>")
    return (
        df.withColumn("role_family", family)
        .withColumn("seniority", seniority)
        .withColumn("min_years_experience", F.least(F.lit(15), F.coalesce(years.cast("int"), F.lit(0))))
        .withColumn("start_timing", F.when(P.hit(text, r"2027"), "2027_or_later").otherwise("unclear"))
        .withColumn("clearance_required", P.hit(text, P.FLAGS + r"security clearance|\bts/sci\b"))
        .withColumn("advanced_degree_required", P.hit(text, P.FLAGS + rules.DEGREE))
        .withColumn("matched_skills", found)
        .withColumn("evidence", F.lit(""))
    )


def classify(df: DataFrame, labels: DataFrame | None = None, classifier: Callable[[DataFrame], DataFrame] | None = None, skills: Sequence[str] = tuple(rules.SKILLS)) -> DataFrame:
    """Labels from a table keyed by fingerprint (``fp``), from a given classifier, or by rule."""
    if labels is not None:
        keyed = df.withColumn("fp", fingerprint(F.col("url"), F.col("title"), F.col("company")))
        return keyed.join(labels.select(F.col("fp").alias("_fp"), *LABELS), F.col("fp") == F.col("_fp"), "inner").drop("_fp")
    return classifier(df) if classifier else rule_classifier(df, skills)


def classification_defaults(df: DataFrame) -> DataFrame:
    """C3."""
    return (
        df.withColumn("role_family", F.coalesce("role_family", F.lit("other_technical")))
        .withColumn("seniority", F.coalesce("seniority", F.lit("unclear")))
        .withColumn("start_timing", F.coalesce("start_timing", F.lit("unclear")))
        .withColumn("min_years_experience", F.greatest(F.lit(0), F.coalesce(F.expr("try_cast(min_years_experience as int)"), F.lit(0))))
        .withColumn("clearance_required", F.coalesce("clearance_required", F.lit(False)))
        .withColumn("advanced_degree_required", F.coalesce("advanced_degree_required", F.lit(False)))
        .withColumn("matched_skills", F.filter(F.coalesce("matched_skills", F.array().cast("array<string>")), lambda s: strip(s) != ""))
    )


def hard_rejects(max_years: int = 1) -> Column:
    """C4: dealbreakers in order."""
    years = F.col("min_years_experience")
    return F.array_compact(
        F.array(
            F.when(F.col("role_family") == "non_technical", "non-technical role"),
            F.when(F.col("seniority") == "senior_plus", "senior/staff-level role"),
            F.when(F.col("seniority") == "intern", "internship or temporary position"),
            F.when(years > max_years, F.concat(F.lit("requires "), years.cast("string"), F.lit("+ years experience"))),
            F.when(F.col("start_timing") == "2026_or_earlier", "starts 2026 or earlier"),
            F.when(F.col("clearance_required"), "active security clearance required"),
            F.when(F.col("advanced_degree_required"), "MS/PhD required"),
        )
    )


def soft_concerns() -> Column:
    """C6."""
    return F.array_compact(
        F.array(
            F.when(F.col("seniority") == "unclear", "level not stated in posting"),
            F.when(F.col("start_timing") == "unclear", "start date not stated"),
            F.when(F.col("role_family") == "other_technical", "technical but outside target role families"),
        )
    )


def _looked_up(c: Column, table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*table.items())])[c], F.lit(default))


def score(df: DataFrame, weights: Scoring = Scoring()) -> DataFrame:
    """Score 0..10, suitable, concerns (array), reason."""
    df = classification_defaults(df).withColumn("_rejects", hard_rejects(weights.max_years))
    gained = (
        _looked_up(F.col("role_family"), weights.family_base, 3)
        + _looked_up(F.col("seniority"), weights.seniority_delta, 0)
        + _looked_up(F.col("start_timing"), weights.start_delta, 0)
        + F.when(P.hit(F.col("location"), P.alternation(weights.location_allow)), weights.location_bonus).otherwise(0)
        + F.when(F.col("role_family").isin("security", "ml_ai"), weights.focus_bonus).otherwise(0)
        + F.when(F.size("matched_skills") >= weights.skills_least, weights.skill_bonus).otherwise(0)
    )
    total = F.when(F.size("_rejects") > 0, weights.reject_score).otherwise(gained)
    evidence = strip(text_or_empty(F.col("evidence")))
    reason = F.concat(
        F.col("role_family"), F.lit("/"), F.col("seniority"), F.lit(", "), F.col("min_years_experience").cast("string"),
        F.lit("y exp, starts "), F.col("start_timing"), F.lit("."), F.when(evidence != "", F.concat(F.lit(" "), evidence)).otherwise(""),
    )
    return (
        df.withColumn("score", F.least(F.lit(10), F.greatest(F.lit(0), total)).cast("int"))
        .withColumn("suitable", F.col("score") >= weights.threshold)
        .withColumn("concerns", F.when(F.size("_rejects") > 0, F.col("_rejects")).otherwise(soft_concerns()))
        .withColumn("reason", reason)
        .drop("_rejects")
    )


def verdict_row(scored: DataFrame, stamp: str) -> DataFrame:
    """Match rows with joined lists and the time of the run."""
    return scored.withColumn("matched_skills", F.array_join("matched_skills", "; ")).withColumn("concerns", F.array_join("concerns", "; ")).withColumn("date_processed", F.lit(stamp))


def gated_rows_output(gated: DataFrame, stamp: str) -> DataFrame:
    """Rejected rows as match rows with score 0."""
    why = F.concat(F.lit("gated: "), F.col("gate.rule"), F.lit(" ("), F.col("gate.detail"), F.lit(")"))
    return gated.filter("gate is not null").select(
        "*", F.lit(0).alias("score"), F.lit(False).alias("suitable"), F.lit("").alias("matched_skills"), why.alias("concerns"), why.alias("reason"), F.lit(stamp).alias("date_processed")
    )


def run_summary(gated: DataFrame) -> DataFrame:
    """Rows, passed and rejected in one pass."""
    return gated.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("gate").isNull()).alias("passed"), F.count_if(F.col("gate").isNotNull()).alias("gated")
    )


def batch_health(attempted: DataFrame) -> DataFrame:
    """Unusable if something was attempted and all of it failed (``failed`` boolean)."""
    return attempted.agg(F.count(F.lit(1)).alias("scored"), F.count_if("failed").alias("errors")).withColumn(
        "usable", ~((F.col("scored") > 0) & (F.col("scored") == F.col("errors")))
    )
