"""Community list documents (Markdown pipe tables and HTML tables) to postings.

Lines are rows; what the document carries from line to line (open table row, section,
header, company) becomes running sums and last-value windows inside the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import cell_text, demark, legend_flags, once, strip, synth_description
from millrace.functions.urls import pick_apply_url
from millrace.operators.filters import row_flag_skip, section_allowed
from millrace.operators.ordered import cap_rows, carry_last
from millrace.rules import LIST_LABELS
from millrace.schemas import POSTING

FIELDS = ("company", "title", "location", "url", "salary", "posted")


def list_lines(docs: DataFrame) -> DataFrame:
    """Docs (doc, text) -> doc, ord, line; a <tr> over several lines is one line at the place of its first."""
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("ord", "raw")).withColumn("line", strip(F.col("raw")))
    upto = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # A row is open from a line that starts it without ending it up to the next line that ends one.
    opens, ends = F.col("line").rlike("(?i)^<tr") & ~F.col("line").rlike("(?i)</tr>"), F.col("line").rlike("(?i)</tr>")
    marked = (
        lines.withColumn("_event", F.when(opens, 1).when(ends, 0))
        .withColumn("_open", F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(0)) == 1)
        .withColumn("_starts", F.when(F.col("_open"), 0).otherwise(1))
        .withColumn("_group", F.sum("_starts").over(upto))
    )
    return marked.groupBy("doc", "_group").agg(
        F.min("ord").alias("ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("line"),
    ).drop("_group")


def _cells(line: Column) -> Column:
    tr = F.regexp_extract_all(line, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)
    pipe = F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), _stripped)
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return F.when(line.rlike("(?i)^<tr"), tr).when(line.startswith("|") & (bars >= 3), pipe)


def _stripped(c: Column) -> Column:
    """``strip`` for texts that mostly end in plain spaces: the regular expression only where other white space is left."""
    return F.when(F.trim(c).rlike(r"(?U)^\s|\s$"), strip(c)).otherwise(F.trim(c))


def _header(labels: Column) -> Column:
    """Map field -> place (from 1); the first label of a field wins; null without company and title."""
    known = F.create_map(*[F.lit(x) for pair in LIST_LABELS.items() for x in pair])
    fields = F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), F.lit("")))
    places = lambda x: F.create_map(*[y for f in FIELDS for y in (F.lit(f), F.array_position(x, f).cast("int"))])
    is_header = lambda x: F.array_contains(x, "company") & F.array_contains(x, "title")
    return once(fields, lambda x: F.when(is_header(x), places(x)))


def norm_list(
    docs: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), skip_closed: bool = True, skip_no_sponsorship: bool = False,
    skip_citizenship: bool = False, skip_advanced_degree: bool = False, tags: tuple[str, ...] = ("new grad", "entry level"), max_jobs: int = 0,
) -> DataFrame:
    """docs: doc, text, label. Gives doc, ord and the posting columns."""
    lines = list_lines(docs)
    heading = F.regexp_extract("line", r"(?s)^#{1,6}\s+(.+?)\s*#*$", 1)
    # The text of a heading or of every cell is made once, below the windows; all that follows only looks at it.
    rows = lines.withColumn("cells", _cells(F.col("line"))).withColumn("texts", F.transform(F.coalesce("cells", F.array(heading)), cell_text))
    rows = rows.withColumn("_heading", F.when(F.col("cells").isNull() & F.col("line").rlike(r"^#{1,6}\s+\S"), F.get("texts", 0)))
    rows = carry_last(rows, "_heading", ["doc"], "ord", "section").withColumn("section", F.coalesce("section", F.lit("")))
    rows = rows.filter(F.size("cells") >= 3)
    filled = F.filter("cells", lambda c: strip(c) != "")
    rows = rows.filter(~F.forall(filled, lambda c: strip(c).rlike(r"^:?-{2,}:?$")))
    labels = F.transform("texts", lambda c: F.regexp_replace(F.lower(c), r"^[ *:]+|[ *:]+$", ""))
    rows = rows.withColumn("_header", _header(labels)).withColumn("_table", F.when(F.col("_header").isNotNull(), F.col("ord")))
    rows = carry_last(carry_last(rows, "_header", ["doc"], "ord", "cols"), "_table", ["doc"], "ord", "table")
    rows = rows.filter(F.col("_header").isNull() & F.col("cols").isNotNull())
    cell = lambda f, of="texts": F.when(F.col("cols")[f] > 0, F.coalesce(F.try_element_at(of, F.col("cols")[f]), F.lit(""))).otherwise("")
    own = demark(cell("company"))
    rows = rows.withColumn("_own", F.when((own != "") & ~own.startswith("↳"), own))
    rows = carry_last(rows, "_own", ["doc", "table"], "ord", "company").withColumn("company", F.coalesce("company", F.lit("")))
    rows = rows.withColumn("title", demark(cell("title"))).withColumn("flags", legend_flags(F.array_join("cells", " ")))
    rows = rows.filter(
        (F.col("title") != "")
        & ~row_flag_skip(F.col("flags"), skip_closed, skip_no_sponsorship, skip_citizenship, skip_advanced_degree)
        & section_allowed(F.col("section"), include, exclude)
    )
    rows = rows.withColumn("url", pick_apply_url(cell("url", "cells"))).filter("url <> ''")
    for f in ("location", "salary", "posted"):
        rows = rows.withColumn(f, cell(f))
    rows = cap_rows(rows, max_jobs, ["doc"], "ord").join(docs.select("doc", "label"), "doc")
    made = synth_description(*[F.col(c) for c in ("title", "company", "location", "salary", "posted", "section", "flags", "label")], tags)
    return rows.withColumn("description", made).withColumn("source", F.concat(F.lit("github_list/"), "label")).select("doc", "ord", *POSTING)
