"""Patterns and trims rewritten for speed find what the plain ones find."""

import random

from pyspark.sql import functions as F

from millrace import rules
from millrace.functions import patterns as P
from millrace.functions.text import strip
from millrace.operators.scoring import rule_classifier
from millrace.plans import cycle


def test_strip_is_the_pattern_on_every_character(spark):
    rows = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    made = rows.select(F.explode(F.array("c", F.concat("c", F.lit("a"), "c", F.lit("b\n"), "c"), F.concat(F.lit("\r "), "c", F.lit(" \n")))).alias("t"))
    assert made.filter(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert spark.range(1).select(strip(F.lit(None).cast("string")).alias("t")).first().t is None


def test_alternations_find_the_same(spark):
    lists = [*rules.TITLE_REJECT.values(), rules.LOCATION_ALLOW, rules.LOCATION_DENY, [r"\ba|b", r"\bc", r"\b[|(]x", r"(\bd|e)", r"\b?f"], ["(?-i)A", r"\bB", r"\bC"]]
    assert P.alternation([r"\ba", r"\bb", "c"]) == P.FLAGS + r"\b(?:a|b)|c"
    assert P.branches(r"a\|b|[|]c|(d|e)|f") == [r"a\|b", "[|]c", "(d|e)", "f"]
    draw = random.Random(4)
    pieces = [w for ps in lists for p in ps for w in p.replace("\\b", "").replace("\\s", " ").split("|")] + ["account executive", "nurse", "sr.", "new grad 2025", " ", "-", "é", "É", "_", "x", "\n", "ſales", "co-op"]
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", ", ", "x"]) for _ in range(draw.randint(1, 6))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for ps in lists:
        plain, new = P.FLAGS + "|".join(ps), P.alternation(ps)
        at = lambda p: F.struct(F.regexp_instr("t", F.lit(p)), F.regexp_extract("t", p, 0))
        assert df.filter(at(plain) != at(new)).count() == 0
        assert df.filter(F.col("t").rlike(new)).count() > 0


def test_a_text_is_lowered_once_for_all_skills(spark):
    df = spark.createDataFrame([("PYTHON", "uses JavaScript and c#"), (None, None), ("x", "")], "title string, description string")
    out = rule_classifier(df)
    assert [r.matched_skills for r in out.collect()] == [["Python", "Java", "JavaScript", "C#"], [], []]
    assert rule_classifier(df, ()).first().matched_skills == []
    plan = out.select("matched_skills")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws") == 1 and "transform(array(lower" in plan


def test_survivors_are_worked_out_once(spark):
    rows = [(f"Software Engineer {i % 5}", "c", "NYC", "", "", "d", "ashby:x", i) for i in range(20)] + [("Sales Lead", "c", "NYC", "", "", "d", "s", 20)]
    posts = spark.createDataFrame(rows, "title string, company string, location string, salary string, url string, description string, source string, ord long")
    matches, decided = cycle.cycle(posts, spark.createDataFrame([], "fp string"), "now", cycle.CycleOptions(all_rows=True))
    assert matches.count() == decided.count() == 6
    for df in (matches, decided):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
