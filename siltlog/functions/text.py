"""Tokens of text: maximal runs of letters, digits and underscores, in lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \W is ASCII only, so the classes are spelt out; this splits as Python's \W+ does.
SEPARATORS = r"[^\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    """array<string>, in order, with repeats. Null for null."""
    return F.array_remove(F.split(F.lower(c), SEPARATORS), "")


def tokenize(value: str) -> list[str]:
    """The same for a Python string, at compile time."""
    return [t for t in re.split(r"\W+", value.lower()) if t]


def padded(toks: Column) -> Column:
    """Tokens between single spaces, with one at either end: a phrase is in it exactly if its own padded form is a substring."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def has_term(c: Column, term: str, toks: Column | None = None) -> Column:
    """Whether a token is ``term``."""
    return has_phrase(c, [term]) if toks is None else F.array_contains(toks, term)


def has_phrase(c: Column, terms: list[str], toks: Column | None = None) -> Column:
    """Whether the terms stand at consecutive places. Without stored tokens the text is searched as it is, by one pattern: the terms with separators between them
    and no letter, digit or underscore beside them. The substring test is cheap and spares most rows the pattern."""
    if toks is not None:
        return padded(toks).contains(f" {' '.join(terms)} ")
    inside = SEPARATORS.replace("[^", "[", 1).removesuffix("+")
    pattern = f"(?<!{inside}){SEPARATORS.join(re.escape(t) for t in terms)}(?!{inside})"
    low = F.lower(c)
    return low.contains(max(terms, key=len)) & low.rlike(pattern)
