"""Boolean search: a query becomes one condition, made once on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import in_categories, in_range, of_age, of_gender
from ..functions.text import given


def parsed(query: str, brackets: bool = True) -> tuple:
    """A query as nested tuples: ("term", text), ("not", x), ("and", ...) and ("or", ...); an empty "and" holds always.

    OR binds least, then AND, which stands between terms by itself; NOT negates one term, and at the end is a word
    like any other. "..." is a phrase. Parentheses group; without brackets they are part of their term.
    """
    found = re.findall(r'"([^"]*)"|([()])|([^\s()"]+)' if brackets else r'"([^"]*)"|(\0)|([^\s"]+)', query)
    tokens = [("term", q) if q else ("mark", b) if b else ("word", w) for q, b, w in found]
    place = 0

    def word(name):
        return place < len(tokens) and tokens[place][0] == "word" and tokens[place][1].upper() == name

    def term() -> tuple:
        nonlocal place
        kind, value = tokens[place]
        place += 1
        if kind == "word" and value.upper() == "NOT" and place < len(tokens) and tokens[place] != ("mark", ")"):
            return "not", term()
        if (kind, value) == ("mark", "("):
            inside = either()
            place += tokens[place : place + 1] == [("mark", ")")]
            return inside
        return "term", value.lower()

    def every() -> tuple:
        nonlocal place
        parts = []
        while place < len(tokens) and tokens[place] != ("mark", ")") and not word("OR"):
            if word("AND"):
                place += 1
            else:
                parts.append(term())
        return "and", *parts

    def either() -> tuple:
        nonlocal place
        parts = [every()]
        while word("OR"):
            place += 1
            parts.append(every())
        return "or", *parts

    out = [either()]
    while place < len(tokens):  # a bracket that closes nothing
        place += 1
        out.append(every())
    return "and", *out


def evaluated(tree: tuple, term: Callable[[str], object], negated: Callable[[object], object], yes: object):
    """A parsed query by what each term is worth, with & and | for and and or; yes is what always holds."""
    kind, *parts = tree
    if kind == "term":
        return term(parts[0])
    values = [evaluated(p, term, negated, yes) for p in parts]
    if kind == "not":
        return negated(values[0])
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), values) if values else yes


def condition(query: str, text: Column, brackets: bool = True) -> Column:
    """Whether a lower-case text satisfies a query: terms are substrings, in any case, and parsed() tells how they are joined."""
    return evaluated(parsed(query, brackets), lambda t: F.contains(text, F.lit(t)), lambda x: ~x, F.lit(True))


def searchable(case_name=None, injuries=None, comments=None, summary=None) -> Column:
    """The chosen fields joined by spaces, in lower case."""
    parts = [given(c) for c in (case_name,) if c is not None] + [c for c in (injuries,) if c is not None]
    parts += [given(c) for c in (comments, summary) if c is not None]
    return F.lower(F.concat_ws(" ", *parts))


def boolean_search(
    cases: DataFrame, query: str, text: Column, *, regions: Column | None = None, selected: list[str] | None = None, sex: Column | None = None,
    gender: str | None = None, age: Column | None = None, wanted_age: int | None = None, age_range: int = 5, damages: Column | None = None,
    min_damages: float | None = None, max_damages: float | None = None, year: Column | None = None, min_year: int | None = None,
    max_year: int | None = None, brackets: bool = True,
) -> DataFrame:
    """The cases that pass the filters and satisfy the query; none for a blank query. Cheap conditions come first."""
    if not query or not query.strip():
        return cases.limit(0)
    tests = []
    if year is not None:
        tests.append(in_range(year, min_year, max_year))
    if damages is not None:
        tests.append(in_range(damages, min_damages, max_damages))
    if regions is not None:
        tests.append(in_categories(regions, selected or []))
    if sex is not None:
        tests.append(of_gender(sex, gender))
    if age is not None:
        tests.append(of_age(age, wanted_age, age_range))
    return cases.where(reduce(lambda a, b: a & b, [*tests, condition(query, text, brackets)]))
