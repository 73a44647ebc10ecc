"""Fixed schemas: postings, match rows, tracker rows, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTING = ("title", "company", "location", "salary", "url", "description", "source")
PIPELINE = ("url", "title", "company", "location", "salary", "source", "score", "suitable", "matched_skills", "concerns", "reason", "date_processed")
USER = ("date_applied", "cover_letter", "due_date", "round_num", "status", "as_of", "notes", "application_id", "pay")
LIFECYCLE = ("deleted_at", "deleted_reason", "created_at", "updated_at")
MATCH = ("date_processed", "title", "company", "location", "salary", "score", "suitable", "matched_skills", "concerns", "reason", "url", "source")
DELETE_REASONS = ("user", "prune", "review", "import-csv", "import-prune")
TRACKER_TYPES = {
    "key": "string",
    **{c: {"score": "int", "suitable": "boolean"}.get(c, "string") for c in PIPELINE},
    **dict.fromkeys(USER, "string"),
    **dict.fromkeys(LIFECYCLE, "string"),
}
CLASSIFICATION = (
    "role_family string, seniority string, min_years_experience int, start_timing string, "
    "clearance_required boolean, advanced_degree_required boolean, matched_skills array<string>, evidence string"
)


def with_columns_of(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing columns as typed nulls, in the order of ``types``, other columns dropped."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def evolve_schema(tracker: DataFrame, version: int, code_version: int, types: dict[str, str] = TRACKER_TYPES) -> DataFrame:
    """An older snapshot gets the columns it lacks; a newer one than the code is refused."""
    if version > code_version:
        raise ValueError(f"the snapshot has schema version {version}, this code knows {code_version}")
    return with_columns_of(tracker, types)
