"""Raw board payloads (a table of JSON, RSS or text) to postings.

raw: source_type, slug, label, page, payload. Each normalizer takes the rows of its type
and gives the posting columns; ``NORMALIZERS`` is the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import MAX_CHARS, first_filled, html_to_text, join_place, remote_suffix, strip, tagged, text_or_empty
from millrace.schemas import POSTING
from millrace.session import stored


def _posting(df: DataFrame, **columns: Column) -> DataFrame:
    cols = {c: F.lit("") for c in POSTING} | columns
    return df.select(*[text_or_empty(cols[c]).alias(c) for c in POSTING])


def _items(raw: DataFrame, path: str, fields: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row an element of the array at ``path``, parsed as struct ``j``."""
    array = F.col("payload") if path == "$" else F.get_json_object("payload", path)
    each = F.explode(F.from_json(array, "array<string>"))
    rows = raw.select("slug", each.alias("_e"))
    return (rows.filter(keep(F.col("_e"))) if keep else rows).select("slug", F.from_json("_e", fields).alias("j"))


def _board(slug: str) -> Column:
    return F.concat(F.lit(slug + ":"), F.col("slug"))


def norm_remoteok(raw: DataFrame) -> DataFrame:
    """Elements without the key ``position`` are skipped."""
    fields = "position string, company string, location string, salary_min double, salary_max double, tags array<string>, description string, url string"
    has = lambda e: F.coalesce(F.array_contains(F.json_object_keys(e), "position"), F.lit(False))
    lo, hi = F.col("j.salary_min"), F.col("j.salary_max")
    pay = F.concat(F.lit("$"), F.format_number(lo, 0), F.lit(" - $"), F.format_number(hi, 0))
    return _posting(
        _items(raw, "$", fields, has),
        title=F.col("j.position"), company=F.col("j.company"), location=first_filled(F.col("j.location"), F.lit("Remote")),
        salary=F.when((lo != 0) & (hi != 0), pay), url=F.col("j.url"),
        description=tagged(F.col("j.tags"), html_to_text(F.col("j.description"))), source=F.lit("remoteok"),
    )


def norm_wwr_rss(raw: DataFrame) -> DataFrame:
    """N2: "Company: Title"; no title after the first colon means no colon."""
    items = F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), 1))
    rows = raw.select(items.alias("_i")).select(F.concat(F.lit("<item>"), "_i", F.lit("</item>")).alias("_x"))
    x = rows.select(F.from_xml("_x", "title string, region string, link string, description string").alias("j"))
    whole = strip(text_or_empty(F.col("j.title")))
    at = F.instr(whole, ":")
    right = F.expr("substring(t, c + 1)")
    split = x.withColumn("t", whole).withColumn("c", at).withColumn("r", right)
    named = (F.col("c") > 0) & (F.col("r") != "")
    return _posting(
        split,
        title=strip(F.when(named, F.col("r")).otherwise(F.col("t"))),
        company=strip(F.when(named, F.expr("substring(t, 1, c - 1)")).otherwise("")),
        location=first_filled(strip(text_or_empty(F.col("j.region"))), F.lit("Remote")),
        url=strip(text_or_empty(F.col("j.link"))), description=html_to_text(F.col("j.description")), source=F.lit("weworkremotely"),
    )


def norm_remotive(raw: DataFrame) -> DataFrame:
    """N3."""
    fields = "title string, company_name string, candidate_required_location string, salary string, tags array<string>, url string, description string"
    return _posting(
        _items(raw, "$.jobs", fields),
        title=F.col("j.title"), company=F.col("j.company_name"), location=first_filled(F.col("j.candidate_required_location"), F.lit("Remote")),
        salary=F.col("j.salary"), url=F.col("j.url"), description=tagged(F.col("j.tags"), html_to_text(F.col("j.description"))), source=F.lit("remotive"),
    )


def norm_arbeitnow(raw: DataFrame) -> DataFrame:
    """Every page is a row of the landing table."""
    fields = "title string, company_name string, location string, remote boolean, tags array<string>, job_types array<string>, url string, description string"
    none = F.array().cast("array<string>")
    tags = F.concat(F.coalesce("j.tags", none), F.coalesce("j.job_types", none))
    return _posting(
        _items(raw, "$.data", fields),
        title=F.col("j.title"), company=F.col("j.company_name"), location=remote_suffix(F.col("j.location"), F.col("j.remote")),
        url=F.col("j.url"), description=tagged(tags, html_to_text(F.col("j.description"))), source=F.lit("arbeitnow"),
    )


def hn_fields(text: Column) -> Column:
    """Struct (title, company, location) of a comment's first line."""
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    parts = F.transform(F.split(first, r"\|"), strip)
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    several = F.size(parts) >= 2
    return F.struct(
        F.left(F.when(several, part(2)).otherwise(F.left(first, F.lit(120))), F.lit(150)).alias("title"),
        F.left(F.when(several, part(1)).otherwise(""), F.lit(100)).alias("company"),
        F.left(F.when(several, part(3)).otherwise(""), F.lit(100)).alias("location"),
    )


def comment_tree(threads: DataFrame) -> DataFrame:
    """N5, the whole tree: threads (thread, payload) -> a row a comment at any depth: thread, id, parent_id (null at the top),
    depth (from 1), path (places from 0), n_children, text.

    A payload is parsed once, as a variant. Each level is the children of the one before, stored in the shared folder; no
    level shuffles, and there are as many jobs as the deepest thread has levels. Payloads that do not parse and children
    that are no list give nothing.
    """
    kids = F.expr("try_variant_get(v, '$.children', 'array<variant>')")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    level = threads.select("thread", F.lit(None).cast("string").alias("id"), F.array().cast("array<int>").alias("path"), F.try_parse_json("payload").alias("v"))
    found = []
    while True:
        below = level.select("thread", F.col("id").alias("parent_id"), F.col("path").alias("_above"), F.posexplode(kids).alias("_at", "v"))
        level = stored(below.select("thread", "parent_id", get("$.id").alias("id"), F.concat("_above", F.array("_at")).alias("path"), "v"), "comments")
        found.append(level.select("thread", "id", "parent_id", F.size("path").alias("depth"), "path", F.coalesce(F.size(kids), F.lit(0)).alias("n_children"), get("$.text").alias("text")))
        if level.filter(F.size(kids) > 0).isEmpty():
            return reduce(DataFrame.unionByName, found)


def norm_hn_hiring(raw: DataFrame) -> DataFrame:
    """Comments of 40 characters or more at the top of their thread; answers below them are no postings."""
    rows = _items(raw, "$.children", "id string, text string").withColumn("_t", html_to_text(F.col("j.text"))).filter(F.length("_t") >= 40)
    f = hn_fields(F.col("_t"))
    return _posting(
        rows, title=f["title"], company=f["company"], location=f["location"],
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), text_or_empty(F.col("j.id"))), description=F.col("_t"), source=F.lit("hn_hiring"),
    )


def norm_greenhouse(raw: DataFrame) -> DataFrame:
    """N7."""
    rows = _items(raw, "$.jobs", "title string, location struct<name: string>, absolute_url string, content string")
    return _posting(
        rows, title=F.col("j.title"), company=F.col("slug"), location=F.col("j.location.name"), url=F.col("j.absolute_url"),
        description=html_to_text(F.col("j.content")), source=_board("greenhouse"),
    )


def norm_lever(raw: DataFrame) -> DataFrame:
    """N8."""
    rows = _items(raw, "$", "text string, categories struct<team: string, commitment: string, location: string>, descriptionPlain string, description string, hostedUrl string")
    body = first_filled(F.col("j.descriptionPlain"), html_to_text(F.col("j.description")))
    extras = join_place(F.col("j.categories.team"), F.col("j.categories.commitment"))
    text = F.when(extras != "", F.concat(extras, F.lit("\n"), body)).otherwise(body)
    return _posting(
        rows, title=F.col("j.text"), company=F.col("slug"), location=F.col("j.categories.location"), url=F.col("j.hostedUrl"),
        description=F.left(text, F.lit(MAX_CHARS)), source=_board("lever"),
    )


def norm_ashby(raw: DataFrame) -> DataFrame:
    """N9."""
    rows = _items(raw, "$.jobs", "title string, location string, locationName string, isRemote boolean, jobUrl string, applyUrl string, descriptionHtml string, departmentName string")
    return _posting(
        rows, title=F.col("j.title"), company=F.col("slug"),
        location=remote_suffix(first_filled(F.col("j.location"), F.col("j.locationName")), F.col("j.isRemote")),
        url=first_filled(F.col("j.jobUrl"), F.col("j.applyUrl")),
        description=first_filled(html_to_text(F.col("j.descriptionHtml")), F.col("j.departmentName")), source=_board("ashby"),
    )


def norm_smartrecruiters(raw: DataFrame) -> DataFrame:
    """N10."""
    rows = _items(
        raw, "$.content",
        "id string, name string, location struct<city: string, region: string, country: string, remote: boolean>, "
        "jobAd struct<sections: struct<jobDescription: struct<text: string>>>",
    )
    place = join_place(F.col("j.location.city"), F.col("j.location.region"), F.col("j.location.country"))
    return _posting(
        rows, title=F.col("j.name"), company=F.col("slug"), location=remote_suffix(place, F.col("j.location.remote")),
        url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), text_or_empty(F.col("j.id"))),
        description=html_to_text(F.col("j.jobAd.sections.jobDescription.text")), source=_board("smartrecruiters"),
    )


def norm_workable(raw: DataFrame) -> DataFrame:
    """N11."""
    rows = _items(raw, "$.jobs", "title string, location struct<city: string, region: string, country: string, workplace: string>, remote boolean, url string, shortlink string, description string")
    place = join_place(F.col("j.location.city"), F.col("j.location.region"), F.col("j.location.country"))
    remote = F.coalesce("j.remote", F.lit(False)) | F.coalesce(F.col("j.location.workplace") == "remote", F.lit(False))
    return _posting(
        rows, title=F.col("j.title"), company=F.col("slug"), location=remote_suffix(place, remote), url=first_filled(F.col("j.url"), F.col("j.shortlink")),
        description=html_to_text(F.col("j.description")), source=_board("workable"),
    )


def norm_recruitee(raw: DataFrame) -> DataFrame:
    """N12."""
    rows = _items(raw, "$.offers", "title string, location string, city string, country_code string, careers_url string, url string, description string")
    return _posting(
        rows, title=F.col("j.title"), company=F.col("slug"), location=first_filled(F.col("j.location"), join_place(F.col("j.city"), F.col("j.country_code"))),
        url=first_filled(F.col("j.careers_url"), F.col("j.url")), description=html_to_text(F.col("j.description")), source=_board("recruitee"),
    )


PLACEHOLDER = r"(?im)^\d+\s+locations?$"


def norm_workday(raw: DataFrame) -> DataFrame:
    """N13: "3 Locations" is a count, no place: the location stays empty and ``detail_url`` says where the places are."""
    rows = _items(raw, "$.jobPostings", "title string, locationsText string, postedOn string, externalPath string")
    place = text_or_empty(F.col("j.locationsText"))
    several = place.rlike(r"(?iU)^\d+\s+locations?$")
    host, site = F.split_part(F.col("slug"), F.lit("/"), F.lit(1)), F.regexp_extract("slug", "/(.*)$", 1)
    path = text_or_empty(F.col("j.externalPath"))
    columns = dict(
        title=F.col("j.title"), company=F.col("slug"), location=F.when(several, "").otherwise(place),
        url=F.concat(F.lit("https://"), host, F.lit("/"), site, path),
        description=F.concat_ws("\n", F.nullif(place, F.lit("")), F.nullif(text_or_empty(F.col("j.postedOn")), F.lit(""))), source=_board("workday"),
    )
    detail = F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.split_part(host, F.lit("."), F.lit(1)), F.lit("/"), site, path)
    return rows.select(*[text_or_empty(({c: F.lit("") for c in POSTING} | columns)[c]).alias(c) for c in POSTING], F.when(several, detail).alias("detail_url"))


def fill_multi_location(postings: DataFrame, details: DataFrame) -> DataFrame:
    """F16: places of a detail record (detail_url, places array) for rows that only had a count, in the location and in
    the first such line of the description."""
    from millrace.functions.text import norm_ws, replace_first

    places = F.array_join(F.filter(F.transform("places", norm_ws), lambda p: p != ""), "; ")
    found = details.select(F.col("detail_url").alias("_d"), places.alias("_p"))
    joined = postings.join(found, F.col("detail_url") == F.col("_d"), "left")
    fill = F.coalesce(F.col("_p") != "", F.lit(False))
    return joined.select(
        *[c for c in postings.columns if c not in ("location", "description")],
        F.when(fill, F.col("_p")).otherwise(F.col("location")).alias("location"),
        F.when(fill, replace_first(F.col("description"), PLACEHOLDER, F.col("_p"))).otherwise(F.col("description")).alias("description"),
    )


def norm_oracle(raw: DataFrame) -> DataFrame:
    """N14."""
    rows = _items(raw, "$.items[0].requisitionList", "Id string, Title string, PrimaryLocation string, PostedDate string")
    host, site = F.split_part(F.col("slug"), F.lit("/"), F.lit(1)), F.regexp_extract("slug", "([^/]+)$", 1)
    return _posting(
        rows, title=F.col("j.Title"), company=F.col("slug"), location=F.col("j.PrimaryLocation"),
        url=F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), text_or_empty(F.col("j.Id"))),
        description=F.concat_ws("\n", F.nullif(F.col("j.PrimaryLocation"), F.lit("")), F.concat(F.lit("Posted "), F.nullif(F.col("j.PostedDate"), F.lit("")))),
        source=_board("oracle"),
    )


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "remoteok": norm_remoteok, "wwr_rss": norm_wwr_rss, "remotive": norm_remotive, "arbeitnow": norm_arbeitnow, "hn_hiring": norm_hn_hiring,
    "greenhouse": norm_greenhouse, "lever": norm_lever, "ashby": norm_ashby, "smartrecruiters": norm_smartrecruiters, "workable": norm_workable,
    "recruitee": norm_recruitee, "workday": norm_workday, "oracle": norm_oracle,
}


def split_bad_payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON payloads that parse go on; the others are counted by source."""
    kind = F.get_json_object(F.concat(F.lit('{"a":'), F.trim("payload"), F.lit("}")), "$.a")
    good = F.coalesce(F.trim("payload").rlike(r"^[\[{]") & kind.isNotNull(), F.lit(False))
    marked = raw.withColumn("_good", good | (F.col("source_type") == "wwr_rss"))
    return marked.filter("_good").drop("_good"), marked.filter("not _good").groupBy("source_type").agg(F.count(F.lit(1)).alias("bad"))
