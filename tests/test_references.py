"""Character references against the standard library's decoder."""

import html
import random
from html.entities import html5

from millrace.functions import text


def test_all_names_with_and_without_semicolon(spark):
    names = sorted({n.rstrip(";") for n in html5})
    raws = [f"a&{n};b" for n in names] + [f"a&{n} b" for n in names] + [f"?x=1&{n}=2" for n in names] + [f"&{n}zz;&{n}" for n in names]
    raws += [f"&#{i};x" for i in [*range(0, 300), 0xD7FF, 0xD800, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**12]]
    raws += [f"&#x{i:x}x" for i in (0, 13, 0x41, 0x80, 0x9F, 0x2028, 0x1F600)] + [f"&#0000{i}" for i in (38, 60, 65)]
    check(spark, raws)


def test_nothing_is_decoded_twice(spark):
    check(spark, ["&&#108;t;", "&&#35;39;", "&l&#116;;", "&amp;lt;", "&amp;amp;lt;", "&amp&lt", "&notit;", "&copy 2020", "&#38;#39;", "", "&", "&;", "&#;", "&#x;", "&&&", "é&é;", None])


def test_random_texts(spark):
    draw = random.Random(5)
    parts = ["&", ";", "#", "x", "amp", "lt", "not", "in", "38", "41", " ", "&lt;", "&amp;", "&copy", "&#", "é", "=", "\n", "&nbsp;"]
    check(spark, ["".join(draw.choice(parts) for _ in range(12)) for _ in range(3000)])


def check(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [(r.raw, r.out) for r in df.select("raw", text.unescape(df.raw).alias("out")).collect()]
    assert [g for g in got if g[0] is not None and g[1] != html.unescape(g[0])] == []
    assert len(got) == len(raws) and all(o is None for r, o in got if r is None)


def test_plain_cells_as_all_steps_leave_them(spark):
    """The one look that plain cells take and the whole chain agree, also where the cut at 4,000 characters leaves a space."""
    from pyspark.sql import functions as F

    odd = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a b", " a", "a\nb", "a\r\n\r\n b", "a\n", "*a*", "**a** b", "`a`", "a & b", "&amp;lt;", "a<br>b",
           "<b>a</b>", "[x](y)", "![x](y) z", "[x", "a > b", "|", "↳", "x" * 3999 + " y", "x" * 4001, None]
    rows = spark.createDataFrame([(x,) for x in odd], "c string").select("c", text.cell_text(F.col("c")).alias("a"), text._cell_text(text.text_or_empty(F.col("c"))).alias("b")).collect()
    assert len(rows) == len(odd) and all(r.a == r.b for r in rows), [r for r in rows if r.a != r.b]
