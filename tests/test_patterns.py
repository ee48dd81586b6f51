"""Extraction with literals against running each expression on the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from awardry.functions import fixed
from awardry.functions.patterns import Expression, Extractor, all_matches

OWN = [
    r"\b(ab+c (?:x|yy)?def)\b", r"(?<![a-z])(token \w+)", r"(\w+ of the)", r"(colou?r[s]?)\s", r"([^.]{2,9}?(?:pain|loss))", r"(loss)(?=\.)", r"(foo.bar)", r"(?i)(Pain)", r"(\d+)",
    r"(?:(?:re)?lapse){1,3}", r"^(pain)", r"(pain|x)", r"(no[^x]*pain)", r"((?:abc|abd)+)",
]
LISTS = [fixed.COMMENT_INJURIES, fixed.REPORT_INJURIES, fixed.REPORT_SEQUELAE, OWN]


def plain(text, patterns):
    return [(m[1] if m.re.groups else m[0]).strip(" ") for p in patterns for m in re.finditer(p, text, re.ASCII)]


def texts(n):
    rng = random.Random(9)
    bits = sorted({w for p in sum(LISTS, []) for w in re.findall(r"[a-z]{2,}", p)})
    other = ["", ".", ". ", ", ", "; ", "\n", "  ", "-", "é", "s", "x", "ed ", "of the ", "0", "abbc def", "token a", "foo.bar", "colors "]
    for _ in range(n):
        yield "".join(rng.choice(bits if rng.random() < 0.5 else other) + rng.choice([" ", " ", "", "."]) for _ in range(rng.randrange(0, 80)))


def test_no_match_is_lost_on_random_texts():
    find = Extractor(tuple(map(tuple, LISTS)))
    n = 0
    for t in texts(4000):
        want = [plain(t, p) for p in LISTS]
        assert find(t) == want
        n += sum(map(len, want))
    assert n > 20_000


@pytest.mark.parametrize("pattern, literals", [
    (r"\b(torn \w+)", ["torn "]), (r"\b(\w+ fracture)", [" fracture"]), (r"\b(traumatic brain injury|tbi)", ["tbi", "traumatic brain injury"]),
    (r"\b(herniated (?:disc|disk))", ["herniated dis"]), (r"(\d+)", None), (r"(?i)(pain)", None), (r"(ab)", None), (r"(?:lapse)?x", None),
])
def test_literals(pattern, literals):
    assert Expression(pattern).literals == literals


def test_all_given_expressions_have_literals():
    assert all(Expression(p).literals and Expression(p).inside_sentences for p in sum(LISTS[:3], []))


def test_windows_are_those_of_the_literals():
    """A long text costs the windows about its literals alone."""
    e = Expression(fixed.REPORT_INJURIES[1])
    t = "a b c " * 50_000 + "of the lumbar disc herniation and more " + "a b c " * 50_000
    places = [(m.start(), m.end()) for w in e.literals for m in re.finditer(w, t)]
    lasts = [(m.start(), m.end()) for w in e.last_literals for m in re.finditer(w, t)]
    assert sum(b - a for a, b in e.windows(t, sorted(places), lasts)) < 300
    assert list(e.found(t, places, lasts)) == plain(t, [fixed.REPORT_INJURIES[1]])


def test_columns(spark):
    rows = [(1, "sustained a knee injury. torn ligament, torn ligament"), (2, ""), (3, None), (4, "chronic pain " * 3)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", all_matches(F.col("t"), a=fixed.COMMENT_INJURIES, b=[]).alias("m")).select("i", "m.*")
    got = {r.i: (r.a, r.b) for r in df.collect()}
    assert got == {i: (None, None) if t is None else (plain(t, fixed.COMMENT_INJURIES), []) for i, t in rows}
    assert spark.createDataFrame([], "t string").select(all_matches(F.col("t"), a=["x"])).count() == 0
