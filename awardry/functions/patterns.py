"""Extraction by many regular expressions at once: texts are searched for literals first.

From each expression follow literals of which every match holds one, and how far a match reaches before and behind them at most.
One pass of an automaton over a text finds the literals of all expressions; an expression then runs only on the windows about
its own, cut at full stops where its matches hold none. The result is that of running each expression on the whole
text. Expressions are those of Python's re, with \\w, \\s, \\d and \\b for ASCII alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parsed form of expressions isn't a public module; its names are those of Python 3.11 and later
    from re import _constants as c
    from re import _parser as parser
except ImportError:
    import sre_constants as c
    import sre_parse as parser

#: A width without bound.
ANY = 1 << 30
#: Literals of fewer characters stand in too many texts to be of use.
LEAST = 3


class Need(NamedTuple):
    """Literals of which each match holds one, with at most so many characters of the match before and behind it."""

    literals: frozenset[str]
    before: int
    after: int

    def worth(self) -> tuple:
        return min(map(len, self.literals)) >= LEAST, self.before < ANY, self.after < ANY, min(map(len, self.literals)), -len(self.literals)


def _add(*widths: int) -> int:
    return min(ANY, sum(widths))


def _widths(items) -> tuple[int, int]:
    """Least and greatest number of characters that a parsed sequence takes."""
    low, high = items.getwidth()
    return min(low, ANY), min(high, ANY)


def _width(op, arg) -> int:
    """Greatest number of characters of one item."""
    if op in (c.ASSERT, c.ASSERT_NOT, c.AT):
        return 0
    if op is c.SUBPATTERN:
        return _widths(arg[3])[1]
    if op is c.BRANCH:
        return max(_widths(b)[1] for b in arg[1])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, getattr(c, "POSSESSIVE_REPEAT", None)):
        most = _widths(arg[2])[1]
        return ANY if arg[1] is c.MAXREPEAT and most else min(ANY, most * arg[1]) if most else 0
    return 1 if op in (c.LITERAL, c.NOT_LITERAL, c.IN, c.ANY) else ANY


def _need(items) -> Need | None:
    """The most useful Need of a parsed sequence."""
    return max(_needs(items), key=Need.worth, default=None)


def _needs(items) -> list[Need]:
    """What follows from each part of a parsed sequence."""
    items, found = list(items), []
    run, begun = "", 0

    def close(upto: int) -> None:
        if run:
            found.append(Need(frozenset([run]), _add(*[_width(*x) for x in items[:begun]]), _add(*[_width(*x) for x in items[upto:]])))

    for i, (op, arg) in enumerate([*items, (None, None)]):
        if op is c.LITERAL:
            begun = begun if run else i
            run += chr(arg)
            continue
        close(i)
        ahead, run = run, ""
        if op is None:
            break
        before, after = _add(*[_width(*x) for x in items[:i]]), _add(*[_width(*x) for x in items[i + 1 :]])
        inners: list[Need] = []
        if op is c.SUBPATTERN and not (arg[1] or arg[2]):
            inners = _needs(arg[3])
        elif op is c.BRANCH:
            each = [_need(b) for b in arg[1]]
            if all(each):
                inners = [Need(frozenset().union(*[n.literals for n in each]), max(n.before for n in each), max(n.after for n in each))]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
            others = 0 if arg[1] == 1 else _width(op, arg)
            inners = [Need(n.literals, _add(n.before, others), _add(n.after, others)) for n in _needs(arg[2])]
        for inner in inners:
            found.append(Need(inner.literals, _add(before, inner.before), _add(after, inner.after)))
            if ahead and not inner.before:  # its literals stand at its start: what stands before belongs to them
                found.append(Need(frozenset(ahead + x for x in inner.literals), before - len(ahead) if before < ANY else ANY, _add(after, inner.after)))
    return found


def _all_items(items) -> Iterable[tuple]:
    for op, arg in items:
        yield op, arg
        if op is c.SUBPATTERN:
            yield from _all_items(arg[3])
        elif op is c.BRANCH:
            for b in arg[1]:
                yield from _all_items(b)
        elif op in (c.ASSERT, c.ASSERT_NOT):
            yield from _all_items(arg[1])
        elif isinstance(arg, tuple) and len(arg) == 3 and hasattr(arg[2], "getwidth"):
            yield from _all_items(arg[2])


def _takes_stop(op, arg) -> bool:
    """Whether an item can take a full stop."""
    stop = ord(".")
    if op is c.LITERAL:
        return arg == stop
    if op is c.NOT_LITERAL:
        return arg != stop
    if op is c.IN:
        held = False
        for kind, value in arg:
            if kind is c.LITERAL:
                held |= value == stop
            elif kind is c.RANGE:
                held |= value[0] <= stop <= value[1]
            elif kind is c.CATEGORY:
                held |= value in (c.CATEGORY_NOT_WORD, c.CATEGORY_NOT_SPACE, c.CATEGORY_NOT_DIGIT)
        return held != (arg[0][0] is c.NEGATE)
    return op not in (c.SUBPATTERN, c.BRANCH, c.MAX_REPEAT, c.MIN_REPEAT, c.AT)


class Expression:
    """An expression with what its matches need."""

    def __init__(self, pattern: str):
        self.compiled = re.compile(pattern, re.ASCII)
        self.group = min(1, self.compiled.groups)
        parsed = parser.parse(pattern, re.ASCII)
        items = list(_all_items(parsed))
        ops = {op for op, _ in items}
        places = {arg for op, arg in items if op is c.AT}
        odd = ops & {c.GROUPREF, c.GROUPREF_EXISTS} or places - {c.AT_BOUNDARY, c.AT_NON_BOUNDARY}
        needs = [] if odd or self.compiled.flags & (re.IGNORECASE | re.MULTILINE) else _needs(parsed)
        needs = [n for n in needs if len(min(n.literals, key=len)) >= LEAST]
        need = max(needs, key=Need.worth, default=None)
        # what looks about itself sees one character for \b, else as many as it looks at
        around = max([1, *(_widths(arg[1])[1] for op, arg in items if op in (c.ASSERT, c.ASSERT_NOT))])
        self.literals = sorted(need.literals) if need else None
        self.before, self.after = (_add(need.before, around), _add(need.after, around)) if need else (ANY, ANY)
        # a second set, with a bound behind it where the first has none
        ends = [n for n in needs if n.after < ANY] if self.after == ANY else []
        second = max(ends, key=Need.worth, default=None)
        self.last_literals = sorted(second.literals) if second else None
        self.behind_last = second.after + around if second else ANY
        self.inside_sentences = not ops & {c.ASSERT, c.ASSERT_NOT} and not any(_takes_stop(op, arg) for op, arg in items)

    def windows(self, text: str, places: list[tuple[int, int]], lasts: list[tuple[int, int]] | None = None) -> Iterable[tuple[int, int]]:
        """Disjoint stretches of the text, in order, that hold all matches; places are those of the literals, by start.

        lasts are the places of a second set of literals, if the expression has one: a match holds one of each.
        """
        begun = ended = None
        stops = [e for _, e in sorted(lasts)] if lasts is not None else []
        for start, end in places:
            a, b = max(0, start - self.before), min(len(text), end + self.after)
            if self.inside_sentences:
                a = max(a, text.rfind(".", a, start) + 1)
                stop = text.find(".", end, b)
                b = b if stop < 0 else stop
            if lasts is not None:  # up to the last of the second set that stands there
                i = bisect_right(stops, b)
                if not i or stops[i - 1] + self.behind_last < end:
                    continue
                b = min(b, stops[i - 1] + self.behind_last)
            if begun is not None and a <= ended:
                ended = max(ended, b)
                continue
            if begun is not None:
                yield begun, ended
            begun, ended = a, b
        if begun is not None:
            yield begun, ended

    def found(self, text: str, places: list[tuple[int, int]], lasts: list[tuple[int, int]] | None = None) -> Iterable[str]:
        """Group 1 (or the match) of all matches, given the literals' places."""
        stretches = [(0, len(text))] if self.literals is None else self.windows(text, sorted(places), lasts)
        for a, b in stretches:
            for m in self.compiled.finditer(text[a:b]):
                yield m[self.group] or ""


class Extractor:
    """Lists of expressions, with one automaton over the literals of all."""

    def __init__(self, lists: tuple[tuple[str, ...], ...]):
        import ahocorasick

        self.lists = [[Expression(p) for p in patterns] for patterns in lists]
        self.all = [e for expressions in self.lists for e in expressions]
        of: dict[str, list[int]] = {}
        for i, e in enumerate(self.all):
            for literal in e.literals or ():
                of.setdefault(literal, []).append(2 * i)
            for literal in e.last_literals or ():
                of.setdefault(literal, []).append(2 * i + 1)
        self.automaton = ahocorasick.Automaton()
        for literal, users in of.items():
            self.automaton.add_word(literal, (len(literal), users))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[list[str]]:
        places: dict[int, list[tuple[int, int]]] = {}
        if len(self.automaton):
            for last, (size, users) in self.automaton.iter(text):
                for i in users:
                    places.setdefault(i, []).append((last + 1 - size, last + 1))
        out, i = [], 0
        for expressions in self.lists:
            found: list[str] = []
            for e in expressions:
                if e.literals is None or 2 * i in places:
                    lasts = places.get(2 * i + 1, []) if e.last_literals else None
                    found.extend(x.strip(" ") for x in e.found(text, places.get(2 * i, []), lasts))
                i += 1
            out.append(found)
        return out


@lru_cache(32)
def extractor(lists: tuple[tuple[str, ...], ...]) -> Extractor:
    """One for each worker and set of expressions."""
    return Extractor(lists)


def all_matches(text: Column, **lists: list[str]) -> Column:
    """A struct with an array for each list of expressions: group 1 of all matches, expression after expression, trimmed; null for a null text."""
    names, patterns = list(lists), tuple(map(tuple, lists.values()))

    @F.arrow_udf(", ".join(f"{n} array<string>" for n in names))
    def run(texts: pa.Array) -> pa.Array:
        find = extractor(patterns)
        none = [None] * len(names)
        found = [none if (t := x.as_py()) is None else find(t) for x in texts]  # of a batch's texts one at a time is a Python string
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], pa.list_(pa.string())) for i in range(len(names))], names)

    return run(text)
