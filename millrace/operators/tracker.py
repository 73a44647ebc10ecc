"""The tracker: pure functions tracker, changes -> tracker', and versioned storage.

Pipeline columns are only inserted, user columns only edited, deletions are tombstones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import row_key
from millrace.functions.text import strip, text_or_empty
from millrace.operators.filters import is_internship
from millrace.operators.joins import archive_classify, new_rows
from millrace.operators.ordered import last_wins_by_key
from millrace.operators.stats import live
from millrace.operators.version_log import Conflict, VersionLog
from millrace.schemas import DELETE_REASONS, PIPELINE, TRACKER_TYPES, USER, with_columns_of
from millrace.session import stored


def coerce_match_row(rows: DataFrame) -> DataFrame:
    """text fields of a match row to tracker types; trimmed, with its key."""
    number = F.expr("try_cast(try_cast(score as double) as int)")
    truth = F.lower(strip(text_or_empty(F.col("suitable"))))
    typed = rows.select(
        *[strip(F.col(c).cast("string")).alias(c) for c in PIPELINE if c not in ("score", "suitable")],
        number.alias("score"),
        F.when(truth.isin("true", "1", "yes"), True).when(truth.isin("false", "0", "no"), False).alias("suitable"),
        *[c for c in rows.columns if c == "ord"],
    )
    return typed.withColumn("key", row_key(F.col("url"), F.col("title"), F.col("company")))


def search_filter(q=None, company=None, status=None, min_score=None, archived: bool = False) -> Column:
    """``q`` is a pattern with % and _ over five columns; a backslash in it stands for itself."""
    keep = F.col("deleted_at").isNotNull() if archived else F.col("deleted_at").isNull()
    if q:
        like = "%" + q.replace("\\", "\\\\") + "%"
        some = F.lit(False)
        for c in ("title", "company", "location", "reason", "notes"):
            some = some | F.coalesce(F.col(c).ilike(like), F.lit(False))
        keep = keep & some
    if company:
        keep = keep & (F.col("company") == company)
    if status:
        keep = keep & (F.col("status").isNull() if status == "__none__" else F.col("status") == status)
    return keep & (F.col("score") >= min_score) if min_score is not None else keep


def sort_orders(name: str) -> list[Column]:
    """O1: named orders; an unknown name is ``score``. The key settles ties."""
    folded = lambda c: F.collate(F.col(c), "UTF8_LCASE")
    score, date = F.desc_nulls_last("score"), F.desc_nulls_last("date_processed")
    orders = {
        "date": [date, score],
        "score": [score, date],
        "company": [folded("company").asc_nulls_first(), score],
        "title": [folded("title").asc_nulls_first()],
        "status": [F.col("status").isNull(), folded("status").asc_nulls_first(), score],
    }
    return [*orders.get(name, orders["score"]), F.col("key")]


def search(tracker: DataFrame, q=None, company=None, status=None, min_score=None, archived: bool = False, sort: str = "score", limit: int | None = None) -> DataFrame:
    found = tracker.filter(search_filter(q, company, status, min_score, archived)).orderBy(*sort_orders(sort))
    return found.limit(limit) if limit else found


def get_by_key(tracker: DataFrame, key: str) -> DataFrame:
    """P19."""
    return tracker.filter(F.col("key") == key)


def update_user_fields(tracker: DataFrame, edits: DataFrame, now: str, blank_is_null: bool = False) -> DataFrame:
    """Edits (key, ord, user columns); only columns given change, the last edit of a key counts, unknown keys are ignored."""
    given = [c for c in edits.columns if c not in ("key", "ord")]
    unknown = [c for c in given if c not in USER]
    if unknown:
        raise ValueError(f"not user columns: {unknown}")
    value = lambda c: F.nullif(F.col(c), F.lit("")) if blank_is_null else F.col(c)
    last = last_wins_by_key(edits, "key", "ord").select(F.col("key").alias("_k"), *[value(c).alias(f"_new_{c}") for c in given])
    joined = tracker.join(last, F.col("key") == F.col("_k"), "left")
    edited = F.col("_k").isNotNull()
    changes = {c: F.when(edited, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in given}
    return joined.withColumns({**changes, "updated_at": F.when(edited, F.lit(now)).otherwise(F.col("updated_at"))}).select(*tracker.columns)


def soft_delete(tracker: DataFrame, keys: DataFrame, reason: str, now: str) -> DataFrame:
    """Live rows among ``keys`` become tombstones; others stay as they are."""
    if reason not in DELETE_REASONS:
        raise ValueError(f"not a reason: {reason}")
    marked = tracker.join(keys.select(F.col("key").alias("_k")).distinct(), F.col("key") == F.col("_k"), "left")
    now_gone = F.col("_k").isNotNull() & F.col("deleted_at").isNull()
    return marked.withColumns(
        {
            "deleted_reason": F.when(now_gone, reason).otherwise(F.col("deleted_reason")),
            "updated_at": F.when(now_gone, now).otherwise(F.col("updated_at")),
            "deleted_at": F.when(now_gone, now).otherwise(F.col("deleted_at")),
        }
    ).select(*tracker.columns)


def restore(tracker: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """T4: tombstones among ``keys`` live again."""
    marked = tracker.join(keys.select(F.col("key").alias("_k")).distinct(), F.col("key") == F.col("_k"), "left")
    back = F.col("_k").isNotNull() & F.col("deleted_at").isNotNull()
    blank = F.lit(None).cast("string")
    return marked.withColumns(
        {
            "updated_at": F.when(back, now).otherwise(F.col("updated_at")),
            "deleted_reason": F.when(back, blank).otherwise(F.col("deleted_reason")),
            "deleted_at": F.when(back, blank).otherwise(F.col("deleted_at")),
        }
    ).select(*tracker.columns)


def prune_internships(tracker: DataFrame, now: str, include_touched: bool = False) -> tuple[DataFrame, DataFrame]:
    """The keys of live internship titles (engaged ones only on demand), and the tracker without them."""
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    found = live(tracker).filter(is_internship(F.col("title")))
    keys = (found if include_touched else found.filter(~(filled("status") | filled("date_applied")))).select("key")
    return keys, soft_delete(tracker, keys, "prune", now)


def undo_prune(tracker: DataFrame, reason: str, now: str) -> DataFrame:
    """Restores every tombstone with the reason, whoever set it."""
    return restore(tracker, tracker.filter((F.col("deleted_reason") == reason) & F.col("deleted_at").isNotNull()).select("key"), now)


def apply_archive(tracker: DataFrame, keys: DataFrame, now: str, include_touched: bool = False) -> DataFrame:
    """T8."""
    chosen = archive_classify(keys, tracker, include_touched).filter("outcome = 'to_archive'").select("key")
    return soft_delete(tracker, chosen, "review", now)


class TrackerStore:
    """The tracker as a log of versions: a commit holds only its own rows. Any number of writers; one that comes
    second begins again from what the first has written."""

    def __init__(self, spark: SparkSession, path: str, every: int = 20, tries: int = 10) -> None:
        self.log = VersionLog(spark, path, ", ".join(f"{c} {t}" for c, t in TRACKER_TYPES.items()), every)
        self.spark, self.tries = spark, tries

    def version(self) -> int:
        return self.log.version()

    def history(self) -> DataFrame:
        """One row per commit."""
        return self.log.entries().orderBy("version")

    def read(self, version: int | None = None) -> DataFrame:
        """The tracker at a version, by default the newest."""
        self._there()
        return self.log.read(version)

    def _there(self) -> int:
        version = self.version()
        if not version:
            raise ValueError("the tracker has not been bootstrapped")
        return version

    def _retried(self, attempt: Callable[[int], tuple[int, int]]) -> tuple[int, int]:
        """An attempt from the newest version, again while other writers come first; then a snapshot if one is due."""
        for _ in range(self.tries):
            try:
                done = attempt(self._there())
            except Conflict:
                continue
            self.log.compact()
            return done
        raise Conflict(f"{self.tries} attempts met other writers")

    def bootstrap(self, tracker: DataFrame) -> int:
        """Only into an empty store; of two at once one fails. Keys have to be unique."""
        if self.version():
            raise ValueError("the tracker is there already")
        folder, n = self.log.write(with_columns_of(tracker, TRACKER_TYPES), 1)
        return self.log.commit(1, "snapshot", folder, n, n, n, "bootstrap")

    def store_matches(self, matches: DataFrame, now: str) -> tuple[int, int]:
        """Match rows (ord kept) inserted all or none; gives (added, seen): new keys, and rows with a
        key, repeats counted. The tracker's key column is read, its rows are neither read nor written."""
        rows = stored(coerce_match_row(matches).filter("key <> '' and key <> '|'"), "tracker-matches")
        keys = stored(rows.select("key").distinct(), "tracker-keys")
        seen = rows.count()

        def attempt(version: int) -> tuple[int, int]:
            fresh = new_rows(self.log.existing(keys, version), rows, now)
            folder, added = self.log.write(fresh, version + 1)
            self.log.commit(version + 1, "add", folder, added, added, seen, now)
            return added, seen

        return self._retried(attempt)

    def change(self, keys: DataFrame, edit: Callable[[DataFrame], DataFrame], note: str = "") -> tuple[int, int]:
        """T2 to T8 on the store: ``edit`` (such as :func:`soft_delete`) sees the rows of ``keys`` and gives them back
        changed; gives (version, rows written). Rows that the edit leaves as they are are not written."""
        wanted = keys.select(F.col("key").alias("_k")).distinct()

        def attempt(version: int) -> tuple[int, int]:
            before = stored(self.log.read(version).join(wanted, F.col("key") == F.col("_k"), "left_semi"), "tracker-before")
            folder, n = self.log.write(with_columns_of(edit(before), TRACKER_TYPES).exceptAll(before), version + 1)
            return self.log.commit(version + 1, "change", folder, n, 0, n, note), n

        return self._retried(attempt)
