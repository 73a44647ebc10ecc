"""Text as Column expressions: HTML to text, cells of lists, locations, labels."""

from __future__ import annotations

import html
import json
import zlib
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MAX_CHARS = 4000
CLOSED, NO_SPONSOR, CITIZENSHIP, ADVANCED = "\U0001f512", "\U0001f6c2", "\U0001f1fa\U0001f1f8", "\U0001f393"
MARKS = (CLOSED, NO_SPONSOR, CITIZENSHIP, ADVANCED, "\U0001f1fa", "\U0001f1f8", "\U0001f525", "⭐", "\U0001f195", "❗")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) for an f that looks at its argument often: ``c`` stands in the plan, and is evaluated, once."""
    return F.get(F.transform(F.array(c), f), 0)


#: Unicode white space, what (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trims all Unicode white space; looks at the ends only."""
    return F.btrim(c, F.lit(WHITE))


def norm_ws(c: Column) -> Column:
    """runs of white space become one space; trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


#: References that most pages use alone; a text with no other reference is decoded by plain replacements, the ampersand last.
USUAL = ("nbsp", "lt", "gt", "quot", "apos", "ndash", "mdash", "rsquo", "lsquo", "ldquo", "rdquo", "hellip", "bull", "#39", "#x27", "amp")
#: Named references are looked up in this many small maps, by the CRC-32 of the name.
SLOTS = 1024


@cache
def _named() -> str:
    """JSON of ``SLOTS`` maps, each of the names (without semicolon) whose CRC-32 falls on it."""
    slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
    for name, value in html5.items():
        if name.endswith(";"):
            slots[zlib.crc32(name[:-1].encode()) % SLOTS][name[:-1]] = value
    return json.dumps(slots)


@cache
def _numbered() -> str:
    """JSON of the numbers that pages mean otherwise: nothing, line ends and Windows-1252."""
    return json.dumps({str(i): html.unescape(f"&#{i};") for i in (0, 13, *range(128, 160))})


@cache
def _open_names() -> str:
    """A pattern of the names that need no semicolon, the longest first."""
    return "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def _decoded(piece: Column) -> Column:
    """A piece that begins with "&", with the reference there decoded: a whole name with its semicolon, else the
    longest name that needs none; numbers that stand for no character vanish."""
    get = lambda pattern: F.regexp_extract(piece, pattern, 1)
    table = F.from_json(F.lit(_named()), "array<map<string,string>>")
    look = lambda name: F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % SLOTS).cast("int")), name)
    rest = lambda pattern: F.regexp_replace(piece, pattern, "")
    hexed, digits = get(r"^&#[xX]0*([0-9a-fA-F]*)"), get(r"^&#0*([0-9]*)")
    number = F.when(piece.rlike("^&#[xX]"), F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10))).otherwise(F.when(F.length(digits) <= 7, digits))
    number = F.when(number == "", "0").otherwise(number).try_cast("long")
    wrong = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    void = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | ((number % 0x10000) >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    meant = F.try_element_at(F.from_json(F.lit(_numbered()), "map<string,string>"), number.cast("string"))
    made = F.when(wrong, "\ufffd").when(void, "").otherwise(F.coalesce(meant, char))
    closed = F.concat(look(get("^&([A-Za-z][A-Za-z0-9]*);")), rest("^&[A-Za-z0-9]*;"))
    opened = F.concat(look(get(_open_names())), rest(_open_names()))
    return F.when(piece.startswith("&#"), F.concat(made, rest(r"^&#([xX][0-9a-fA-F]+|[0-9]+);?"))).otherwise(F.coalesce(closed, opened, piece))


def unescape(c: Column) -> Column:
    """Character references, by number or by name, with or without semicolon, decoded once."""
    return once(c, _unescaped)


def _unescaped(c: Column) -> Column:
    usual = "|".join(USUAL)
    plain = c
    for name in USUAL:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    start = r"&(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"
    pieces = F.split(c, f"(?={start})")
    decoded = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{start}"), _decoded(p)).otherwise(p)), "")
    return F.when(c.rlike(f"(?!&(?:{usual});){start}"), decoded).when(c.contains("&"), plain).otherwise(c)


def squeezed_lines(c: Column) -> Column:
    """White space collapsed in each line, blank lines dropped."""
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), norm_ws)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_to_text(c: Column, limit: int = MAX_CHARS) -> Column:
    """contents of script, style and head dropped; line breaks where br and hr open and p, li, div, tr
    and headings close; other tags and comments dropped; all character references decoded. The regex form is
    the contract for malformed input."""
    c = text_or_empty(c)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|head)\b[^>]*>.*?(</\1\s*>|$)", "")
    c = F.regexp_replace(c, r"(?i)<(br|hr)\b[^>]*>|</(p|li|div|tr|h[1-6])\s*>", "\n")
    c = F.regexp_replace(c, r"<[/!?]?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    return F.left(squeezed_lines(unescape(c)), F.lit(limit))


#: What F8 changes in a cell: markup, references, line ends, marks, and white space that is not single spaces between words.
_CELL_SIGNS = r"(?U)[<&\[*`]|^ | $|  |[^\S ]"


def cell_text(c: Column) -> Column:
    """F8: a table cell as plain text; br becomes " / ", links keep their label. Plain cells, which most are, take one look."""
    c = text_or_empty(c)
    return F.when(c.rlike(_CELL_SIGNS) | (F.length(c) > MAX_CHARS), _cell_text(c)).otherwise(c)


def _cell_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<summary\b[^>]*>.*?</summary>", " ")
    c = F.regexp_replace(c, r"(?i)</?br\s*/?>", " / ")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")
    c = F.regexp_replace(c, r"(?<!!)\[([^\]]*)\]\([^)]*\)", "$1")
    c = html_to_text(c)
    return norm_ws(F.regexp_replace(c, r"\*\*|`", ""))


def demark(c: Column) -> Column:
    """legend marks and decorations out, dashes and bars at the ends stripped."""
    for mark in MARKS:
        c = F.replace(c, F.lit(mark), F.lit(" "))
    return F.regexp_replace(norm_ws(c), r"^[ \-–—|]+|[ \-–—|]+$", "")


def legend_flags(row_text: Column) -> Column:
    """closed, no_sponsor, citizenship, advanced."""
    return F.struct(
        row_text.contains(CLOSED).alias("closed"),
        row_text.contains(NO_SPONSOR).alias("no_sponsor"),
        row_text.contains(CITIZENSHIP).alias("citizenship"),
        row_text.contains(ADVANCED).alias("advanced"),
    )


def synth_description(title, company, location, salary, posted, section, flags, label, tags: tuple[str, ...]) -> Column:
    """a description made of a list row's fields; empty ones leave no line."""
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    notes = F.concat_ws(
        "; ",
        F.when(flags["no_sponsor"], "does NOT offer visa sponsorship"),
        F.when(flags["citizenship"], "requires U.S. citizenship"),
        F.when(flags["advanced"], "requires an advanced degree (Master's/PhD/MBA)"),
    )
    made = F.concat_ws(
        "\n",
        F.lit("TAGS: " + ", ".join(tags)) if tags else F.lit(None).cast("string"),
        F.concat(title, F.lit(" at "), first_filled(company, F.lit("unknown company"))),
        line("Location: ", location),
        line("Salary: ", salary),
        line("Posted: ", posted),
        line("Category: ", section),
        line("Notes: ", notes),
        F.concat(F.lit("Listed by "), label, F.lit(" (curated new-grad job list). Full description is on the linked application page.")),
    )
    return F.left(made, F.lit(MAX_CHARS))


def tagged(tags: Column, text: Column) -> Column:
    """``TAGS: a, b`` before the text if there are tags."""
    joined = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    return F.when(joined != "", F.concat(F.lit("TAGS: "), joined, F.lit("\n"), text)).otherwise(text)


def remote_suffix(place: Column, remote: Column) -> Column:
    """"place (Remote)", or "Remote" where the place is empty."""
    place = text_or_empty(place)
    return F.when(F.coalesce(remote, F.lit(False)), F.when(place != "", F.concat(place, F.lit(" (Remote)"))).otherwise("Remote")).otherwise(place)


def join_place(*parts: Column) -> Column:
    """the non-empty parts joined by a comma."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def split_places(location: Column) -> Column:
    """the places of a location, lower case, split at semicolons only; the whole if all are blank."""
    low = F.lower(text_or_empty(location))
    places = F.filter(F.transform(F.split(low, ";"), strip), lambda p: p != "")
    return F.when(F.size(places) == 0, F.array(strip(low))).otherwise(places)


def simplify_location(location: Column) -> Column:
    """buckets by case-sensitive words in order; else the first 35 characters."""
    c = strip(text_or_empty(location))
    has = lambda *words: F.greatest(*[c.contains(w) for w in words], F.lit(False))
    return (
        F.when(c == "", "Unknown")
        .when(has("Remote"), "Remote (US)")
        .when(has("New York", "NYC"), "New York, NY")
        .when(has("San Francisco", "SF"), "San Francisco, CA")
        .when(has("Boston"), "Boston, MA")
        .when(has("Austin"), "Austin, TX")
        .when(has("Seattle"), "Seattle, WA")
        .when(has("Switzerland", "Zurich"), "Switzerland")
        .otherwise(F.left(c, F.lit(35)))
    )


def source_group(source: Column) -> Column:
    """boards of one platform count together."""
    return F.when(source.contains(":"), F.concat(F.lit("watchlist ("), F.split_part(source, F.lit(":"), F.lit(1)), F.lit(")"))).otherwise(source)


def pct(part: Column, total: Column) -> Column:
    """whole percent, halves to even; 0 of 0 is 0."""
    return F.when(total == 0, 0).otherwise(F.bround(100.0 * part / total, 0)).cast("int")


def clean_cell(c: Column) -> Column:
    """null is empty, trimmed, a lone dot counts as empty."""
    v = strip(text_or_empty(c))
    return F.when(v == ".", "").otherwise(v)


def slug_variants(name: Column) -> Column:
    """likely board slugs: without one trailing corporate word, joined and hyphenated."""
    base = F.lower(strip(text_or_empty(name)))
    base = strip(F.regexp_replace(base, r"(?U)\b(inc|llc|ltd|corp|co|company|technologies|labs)\.?$", ""))
    joined = F.regexp_replace(base, "[^a-z0-9]", "")
    hyphen = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.array_distinct(F.filter(F.array(joined, hyphen), lambda v: v != ""))


def replace_first(text: Column, pattern: str, by: Column) -> Column:
    """The first match only."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.overlay(text, by, at, F.length(F.regexp_substr(text, F.lit(pattern))))).otherwise(text)
