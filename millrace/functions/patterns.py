"""Patterns built once from lists of phrases or rules; every list becomes one Java regex."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iU)"
NEVER = r"(?!)"


def keyword_pattern(phrase: str) -> str:
    """the phrase as whole words, any white space between them."""
    words = [re.sub(r"([^\w\s])", r"\\\1", w) for w in phrase.lower().split()]
    return r"(?<!\w)" + r"\s+".join(words) + r"(?!\w)"


def keywords(phrases: Iterable[str]) -> str | None:
    """One alternation, or None for an empty list."""
    parts = [keyword_pattern(p) for p in phrases if p.strip()]
    return FLAGS + "|".join(parts) if parts else None


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand in no group, in order; one where it quotes, nests classes or sets flags."""
    if re.search(r"\\Q|\(\?[\w-]*\)|\[[^\]]*\[", pattern):
        return [pattern]
    out, depth, begin, inside = [], 0, 0, False
    for m in re.finditer(r"\\.|[\[\]()|]", pattern, re.DOTALL):
        c = m.group()
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
        elif not inside and c == "|" and not depth:
            out.append(pattern[begin : m.start()])
            begin = m.end()
    return [*out, pattern[begin:]]


def word_first(pattern: str) -> str:
    r"""The same pattern with ``\b`` taken out before neighbouring alternatives that all begin with it, so that it is looked
    at once at a place and not once for each of them."""
    out: list[str] = []
    for at_word, group in groupby(branches(pattern), lambda p: bool(re.match(r"\\b(?![?*+{])", p))):
        parts = list(group)
        out += [r"\b(?:" + "|".join(p[2:] for p in parts) + ")"] if at_word and len(parts) > 1 else parts
    return "|".join(out)


def alternation(patterns: Iterable[str]) -> str:
    """rules in order as one pattern, each as it is written; an empty list matches nothing."""
    parts = list(patterns)
    return FLAGS + word_first("|".join(parts)) if parts else NEVER


def rule_groups(rules: dict[str, list[str]]) -> dict[str, str]:
    """Named rules in order; names that begin with an underscore are notes."""
    return {name: alternation(p) for name, p in rules.items() if not name.startswith("_")}


def hit(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))
