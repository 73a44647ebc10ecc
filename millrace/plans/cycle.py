"""One pipeline cycle: postings -> dedupe -> filters -> new -> gate, stored once, then classify -> score as a lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millrace.operators.filters import GateRules, gate, keyword_prefilter, location_prefilter
from millrace.operators.joins import new_postings, with_fingerprint
from millrace.operators.ordered import dedupe, first_by
from millrace.operators.scoring import Scoring, classify, gated_rows_output, score, verdict_row
from millrace.schemas import MATCH
from millrace.session import stored
from millrace.sources.normalize import fill_multi_location


@dataclass(frozen=True)
class CycleOptions:
    include: Sequence[str] = ()
    require: Sequence[str] = ()
    exclude: Sequence[str] = ()
    places: Sequence[str] = ()
    no_places: Sequence[str] = ()
    no_prefilter: bool = False
    include_seen: bool = False
    no_gate: bool = False
    all_rows: bool = False  # gated rows are written too, with score 0


def survivors(postings: DataFrame, seen: DataFrame, options: CycleOptions = CycleOptions(), details: DataFrame | None = None) -> DataFrame:
    """Deduped, filtered, new postings with ``fp`` and ``gate``. The costly detail join follows the cheap filters."""
    df = dedupe(postings)
    if not options.no_prefilter:
        df = keyword_prefilter(location_prefilter(df, options.places, options.no_places), options.include, options.require, options.exclude)
    if details is not None and "detail_url" in df.columns:
        df = location_prefilter(fill_multi_location(df, details), options.places, options.no_places)
    df = with_fingerprint(df)
    df = df if options.include_seen else new_postings(df, seen)
    # Two urls can differ in K1 and share K2; one of them is scored.
    return gate(first_by(df, ["fp"], "ord"), GateRules(enabled=not options.no_gate))


def cycle(
    postings: DataFrame, seen: DataFrame, stamp: str, options: CycleOptions = CycleOptions(), labels: DataFrame | None = None,
    classifier: Callable[[DataFrame], DataFrame] | None = None, weights: Scoring = Scoring(), details: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Match rows, and the fingerprints decided (scored or gated): postings without a label stay undecided.

    The survivors are stored, since scored rows, rejected rows and fingerprints all come from them."""
    left = stored(survivors(postings, seen, options, details), "cycle-left")
    judged = score(classify(left.filter("gate is null"), labels, classifier), weights)
    rows = verdict_row(judged if options.all_rows else judged.filter("suitable"), stamp).select(*MATCH)
    rejected = gated_rows_output(left, stamp)
    if options.all_rows:
        rows = rows.unionByName(rejected.select(*MATCH))
    return rows, judged.select("fp").unionByName(left.filter("gate is not null").select("fp"))
