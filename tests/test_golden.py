"""Golden rows worked out by hand from the rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import dates, keys, patterns, text, urls
from millrace.operators import filters, prune, scoring, tracker
from millrace.schemas import TRACKER_TYPES, with_columns_of
from millrace.sources import files, lists, normalize


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("url", "title", "company", "k1", "k2", "k3"),
    [
        ("https://Acme.io/1", "Dev", "Acme", "https://acme.io/1", "5bacefa0b952ff21", "https://acme.io/1"),
        ("  https://acme.io/1 ", "Dev", "Acme", "  https://acme.io/1 ", "5bacefa0b952ff21", "https://acme.io/1"),
        ("", "Dev", "Acme", "dev|acme", "bc60d75ba57b5e1f", "dev|acme"),
        (None, "Dev", "Acme", "dev|acme", "bc60d75ba57b5e1f", "dev|acme"),
        ("  ", "Dev", "Acme", "  ", "e3b0c44298fc1c14", "dev|acme"),
        ("", "Ingénieur", "Éclair", "ingénieur|éclair", "e4f76266cc56412e", "ingénieur|éclair"),
    ],
)
def test_keys(spark, url, title, company, k1, k2, k3):
    df = spark.createDataFrame([(url, title, company)], "url string, title string, company string")
    c = [F.col(x) for x in ("url", "title", "company")]
    assert tuple(df.select(keys.dedupe_key(*c), keys.fingerprint(*c), keys.row_key(*c)).first()) == (k1, k2, k3)


@pytest.mark.parametrize(
    ("location", "kept"),
    [
        ("London, United Kingdom; New York, NY", True), ("New York, London", False), ("Remote (Canada)", False), ("United Kingdom, Remote", False),
        ("Paris", False), ("", True), (None, True), (" ; ", False),
    ],
)
def test_places(spark, location, kept):
    ok = lambda c: filters.place_ok(c, ["new york", "remote"], ["london", "canada", "united kingdom"])
    assert one(spark, location, ok) is kept


@pytest.mark.parametrize(("phrase", "words", "hit"), [("AI", "AI / ML", True), ("AI", "maintain", False), ("new grad", "new   grad", True), ("C++", "c++ dev", True), ("ML", "html", False)])
def test_keywords(spark, phrase, words, hit):
    assert one(spark, words, lambda c: c.rlike(patterns.keywords([phrase]))) is hit


@pytest.mark.parametrize(
    ("source", "title", "location", "rule", "detail"),
    [
        ("hn_hiring", "Engineer", "", "source", "hn_hiring"), ("ashby:x", "Sr. Software Engineer", "NYC", "senior", "Sr"),
        ("ashby:x", "Sales Engineer Intern", "NYC", "non_technical", "Sales"), ("ashby:x", "Software Engineer III", "NYC", "senior", "Engineer III"),
        ("ashby:x", "Software Engineer, New Grad 2026", "NYC", "wrong_cohort", "New Grad 2026"),
        ("ashby:x", "Software Engineer", "Mountain View, CA / New York, NY", None, None), ("ashby:x", "Software Engineer", "Austin, TX", "location", "Austin"),
        ("ashby:x", "Software Engineer", "United States", None, None), ("ashby:x", "Nursery Engineer", "", "non_technical", "Nurse"),
        ("ashby:x", "International Payments Engineer", "", None, None), (None, None, None, None, None),
    ],
)
def test_gate(spark, source, title, location, rule, detail):
    g = filters.gate(spark.createDataFrame([(source, title, location)], "source string, title string, location string")).first().gate
    assert (g.rule if g else None, g.detail if g else None) == (rule, detail)


@pytest.mark.parametrize(
    ("family", "seniority", "years", "start", "place", "skills", "score", "suitable"),
    [
        ("security", "new_grad", 0, "2027_or_later", "NYC", 3, 10, True), ("software_engineering", "unclear", 0, "unclear", "", 0, 6, False),
        ("software_engineering", "junior", 1, "unclear", "NYC", 0, 7, True), ("data", "mid", 0, "unclear", "", 0, 1, False),
        ("security", "new_grad", 2, "unclear", "NYC", 5, 1, False), ("non_technical", "intern", 0, "2026_or_earlier", "", 0, 1, False),
    ],
)
def test_score(spark, family, seniority, years, start, place, skills, score, suitable):
    row = (family, seniority, years, start, place, ["s"] * skills, False, False, None)
    df = spark.createDataFrame([row], "role_family string, seniority string, min_years_experience int, start_timing string, location string, matched_skills array<string>, clearance_required boolean, advanced_degree_required boolean, evidence string")
    r = scoring.score(df).first()
    assert (r.score, r.suitable) == (score, suitable)
    if years == 2:
        assert r.concerns == ["requires 2+ years experience"]
    if family == "non_technical":
        assert len(r.concerns) == 3


def test_match_scores(spark):
    values = ["7.9", "-0.5", "10.9", "11", "abc", "nan", "inf", "", None]
    df = spark.createDataFrame([(v, "t", "") for v in values] + [("5", "", " ")], "score string, title string, url string")
    assert sorted(r.score for r in files.valid_matches(df).collect()) == [0, 0, 0, 7, 10]


@pytest.mark.parametrize(("title", "yes"), [("Software Engineer, New Grad", True), ("Summer Intern 2027", False), ("Engineer 2027", True), ("Internal Tools Engineer", False), ("Entry-Level Analyst", True), (None, False)])
def test_new_grad(spark, title, yes):
    assert one(spark, title, filters.is_new_grad) is yes


def test_urls(spark):
    assert one(spark, "https://x.io/j?utm_source=a&id=1&ref=b", urls.clean_url) == "https://x.io/j?id=1"
    assert one(spark, "https://x.io/j?id=1&source=k#top", urls.clean_url) == "https://x.io/j?id=1&source=k#top"
    assert tuple(one(spark, "https://github.com/a/b/blob/dev/x/R.md?plain=1", urls.canonical_list_url)) == ("https://raw.githubusercontent.com/a/b/dev/x/R.md", "a/b")
    assert tuple(one(spark, "https://github.com/a/b", urls.canonical_list_url)) == ("https://raw.githubusercontent.com/a/b/main/README.md", "a/b")
    assert tuple(one(spark, "https://example.com/l.md", urls.canonical_list_url)) == ("https://example.com/l.md", "")
    assert one(spark, '<a href="https://imgur.com/x">i</a> <a href="https://e.io/?ref=q">Apply now</a>', urls.pick_apply_url) == "https://e.io/"
    assert tuple(one(spark, "https://b.wd1.x.com/Site/", urls.parse_workday_slug)) == ("b.wd1.x.com", "b", "Site")
    assert one(spark, "nohost", urls.parse_workday_slug) is None


@pytest.mark.parametrize(("name", "slugs"), [("Acme Corp", ["acme"]), ("Weights and Biases", ["weightsandbiases", "weights-and-biases"]), ("8am", ["8am"])])
def test_slugs(spark, name, slugs):
    assert one(spark, name, text.slug_variants) == slugs


def test_html(spark):
    page = "<head><title>x</title></head><p>a &amp; b<br>c</p><script>no</script><li>d<b>e</li><!-- n --> f"
    assert one(spark, page, text.html_to_text) == "a & b\nc\nde\nf"
    assert one(spark, None, text.html_to_text) == ""


def test_dates(spark):
    today = datetime.date(2024, 6, 15)
    full = lambda c: dates.infer_full_date(c, today)
    assert [one(spark, v, full) for v in ("Jun 15", "Jun 16", "2023-02-03", "soon", None)] == ["2024-06-15 00:00", "2023-06-16 00:00", "2023-02-03 00:00", "", ""]
    assert [one(spark, v, dates.month_day) for v in ("2024-07-03 10:00", "whenever it is", None)] == ["Jul 3", "whenever i", ""]


def test_percent_and_first_replacement(spark):
    assert spark.range(1).select(text.pct(F.lit(1), F.lit(8)), text.pct(F.lit(1), F.lit(0)), text.pct(F.lit(5), F.lit(1000))).first()[:] == (12, 0, 0)
    fill = lambda c: text.replace_first(c, normalize.PLACEHOLDER, F.lit("A; B"))
    assert one(spark, "2 Locations\nPosted\n2 Locations", fill) == "A; B\nPosted\n2 Locations"


def test_prune_example(spark):
    rows = [
        ("a", "Security Engineer", "NYC", 7), ("b", "ML Engineer", "Boston", 9), ("c", "Backend Engineer", "NYC", 10),
        ("d", "Senior Security Engineer", "NYC", 10), ("e", "Sales Engineer", "NYC", 9),
    ]
    t = with_columns_of(spark.createDataFrame([(*r, "Acme") for r in rows], "key string, title string, location string, score int, company string"), TRACKER_TYPES)
    assert {r.key for r in prune.plan_prunes(t).collect()} == {"c", "d", "e"}
    kept = t.withColumn("notes", F.when(F.col("key") == "e", "mine"))
    assert {r.key for r in prune.plan_prunes(kept).collect()} == {"c", "d"}


def test_list_documents(spark):
    doc = """# Intro
## SWE
| Company | Role | Location | Application | Date Posted |
|---|---|---|---|---|
| **[Acme](https://acme.io)** | Engineer \U0001f6c2 | NYC</br>Boston | <a href="https://e.io/1?utm_source=x"><img alt="Apply"></a> | Aug 05 |
| ↳ | Developer | Remote | [Apply](https://e.io/2) | Aug 04 |
| Shut | Engineer | NYC | \U0001f512 | Aug 03 |
## Quant
<table>
<tr><th>Company</th><th>Role</th><th>Location</th><th>Link</th></tr>
<tr>
<td>Fund</td>
<td>Trader</td><td>NYC</td>
<td><a href="https://e.io/3">Apply</a></td></tr>
</table>"""
    docs = spark.createDataFrame([(1, doc, "x/y")], "doc int, text string, label string")
    rows = [(r.company, r.title, r.location, r.url) for r in lists.norm_list(docs).orderBy("ord").collect()]
    assert rows == [
        ("Acme", "Engineer", "NYC / Boston", "https://e.io/1"), ("Acme", "Developer", "Remote", "https://e.io/2"), ("Fund", "Trader", "NYC", "https://e.io/3"),
    ]
    first = lists.norm_list(docs, exclude=["quant"], skip_no_sponsorship=True).collect()
    assert [r.title for r in first] == ["Developer"]
    assert "Category: SWE" in first[0].description and first[0].source == "github_list/x/y"


def test_tracker_rules(spark):
    base = with_columns_of(spark.createDataFrame([("a", 5, None), ("b", None, "t0")], "key string, score int, deleted_at string"), TRACKER_TYPES)
    edits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("zz", "q", 1)], "key string, notes string, ord int")
    assert {r.key: r.notes for r in tracker.update_user_fields(base, edits, "t1").collect()} == {"a": "y", "b": None}
    with pytest.raises(ValueError):
        tracker.update_user_fields(base, edits.withColumn("score", F.lit(1)), "t1")
    keys_ = spark.createDataFrame([("a",), ("b",)], "key string")
    gone = tracker.soft_delete(base, keys_, "user", "t2")
    assert {r.key: r.deleted_at for r in gone.collect()} == {"a": "t2", "b": "t0"}
    again = tracker.soft_delete(gone, keys_, "user", "t3")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, gone.collect()), key=str)
    back = tracker.restore(gone, keys_.filter("key = 'a'"), "t4")
    assert {r.key: r.deleted_at for r in back.collect()} == {"a": None, "b": "t0"}
    with pytest.raises(ValueError):
        tracker.soft_delete(base, keys_, "mood", "t2")


def test_store_is_insert_only(spark, tmp_path):
    store = tracker.TrackerStore(spark, f"file://{tmp_path}/t")
    empty = with_columns_of(spark.createDataFrame([("https://a.io", 3)], "key string, score int"), TRACKER_TYPES)
    with pytest.raises(ValueError):
        store.read()
    store.bootstrap(empty)
    with pytest.raises(ValueError):
        store.bootstrap(empty)
    cols = "url string, title string, company string, location string, salary string, source string, score string, suitable string, matched_skills string, concerns string, reason string, date_processed string, ord int"
    rows = [("https://A.io ", "t", "c", "", "", "", "9.9", "True", "", "", "", "", 1), ("https://b.io", "t", "c", "", "", "", "7.9", "False", "", "", "", "", 2), ("https://b.io", "u", "c", "", "", "", "1", "", "", "", "", "", 3)]
    assert store.store_matches(spark.createDataFrame(rows, cols), "now") == (1, 3)
    assert {r.key: (r.score, r.title) for r in store.read().collect()} == {"https://a.io": (3, None), "https://b.io": (7, "t")}
    assert store.store_matches(spark.createDataFrame(rows, cols), "later") == (0, 3)


def test_search_escapes(spark):
    t = with_columns_of(spark.createDataFrame([("a", "50% off"), ("b", "a\\b"), ("c", None)], "key string, title string"), TRACKER_TYPES)
    find = lambda q: sorted(r.key for r in tracker.search(t, q=q).collect())
    assert find("0%o") == ["a"] and find("a\\b") == ["b"] and find("_\\") == ["b"] and find("OFF") == ["a"]


def test_rules_are_whole():
    assert len(set(rules.LOCATION_DENY)) == len(rules.LOCATION_DENY)
    assert [len(v) for v in rules.TITLE_REJECT.values()] == [18, 3, 3, 6, 3, 6]
    assert len(rules.EXPORT_COLUMNS) == 19


def test_references_and_queries(spark):
    for raw, want in [
        ("a&#8217;b &#x2013; &ccedil; &amp;#39; &#38;lt; &lt;b&gt; &#150;", "a’b – ç &#39; &lt; <b> –"),
        ("&#0; &#xD800; &#99999999999; &nosuchname; & x &AMP; &hearts;&#65", "\ufffd \ufffd \ufffd &nosuchname; & x & ♥A"),
    ]:
        assert one(spark, raw, text.unescape) == want
    assert one(spark, "https://x.io/j?a=b+c&k&utm_x=1", urls.clean_url) == "https://x.io/j?a=b%20c&k="
    assert one(spark, "https://x.io/j?%75tm_source=1&id=2", urls.clean_url) == "https://x.io/j?id=2"
    assert one(spark, "https://x.io/j?q=1+2&k", urls.clean_url) == "https://x.io/j?q=1+2&k"
