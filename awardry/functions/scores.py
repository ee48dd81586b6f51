"""Scores of cases against a query: columns of a column and of plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import count_of, folded, given


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; a zero vector has similarity 0 with all."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (norm(a) * norm(b))


def age_proximity(age: Column, wanted: Column) -> Column:
    gap = F.abs(age - wanted)
    return F.when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap <= 5, 0.85).when(gap <= 10, 0.7).when(gap <= 20, 0.5).otherwise(0.3)


def gender_match(sex: Column, wanted: Column, literal: bool = False) -> Column:
    """By the first letter, so that ``male`` matches ``M``; literal compares whole texts."""
    form = lambda c: F.lower(F.trim(c)) if literal else F.substring(F.lower(F.trim(c)), 1, 1)
    return F.when(given(F.trim(wanted)).isNull() | given(F.trim(sex)).isNull(), 0.5).when(form(sex) == form(wanted), 1.0).otherwise(0.0)


def injury_overlap(injuries: Column, wanted: Column) -> Column:
    """The share of the wanted injuries that a case has."""
    own, want = folded(injuries), folded(wanted)
    shared = F.size(F.array_intersect(own, want)) / F.nullif(F.size(want), F.lit(0))
    return F.when(F.coalesce(F.size(want), F.lit(0)) == 0, 0.5).when(F.coalesce(F.size(own), F.lit(0)) == 0, 0.0).otherwise(shared)


def injury_list_match(injuries: Column, wanted: Column) -> Column:
    """The share of the wanted phrases that equal, contain or are contained in an injury of the case."""
    own, want = folded(injuries), folded(wanted)
    hit = F.filter(want, lambda p: F.exists(own, lambda i: F.contains(i, p) | F.contains(p, i)))
    return F.when(F.coalesce(F.size(want), F.lit(0)) == 0, 0.5).when(F.coalesce(F.size(own), F.lit(0)) == 0, 0.0).otherwise(F.size(hit) / F.size(want))


def count_in(array: Column, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value)).cast("double")


def bm25(document: Column, query: list[str], mean_length: float = 100.0) -> Column:
    """Saturated counts of the query's tokens in a document's tokens, without document frequencies.

    Repeated query tokens add up, and the sum is divided by the number of different ones. document is array<string>.
    """
    if not query:
        return F.lit(0.0)
    length = F.size(document)
    total = F.lit(0.0)
    for token in dict.fromkeys(query):
        tf = count_in(document, token)
        total = total + query.count(token) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))
    return F.when(length > 0, total / len(set(query))).otherwise(0.0)


def keyword_score(document: Column, query: list[str]) -> Column:
    return F.least(bm25(document, query) / 10.0, F.lit(1.0))


def severity(text: Column, low: Column | None = None) -> Column:
    """The severity of a text; low is a column that has it in lower case already."""
    low = F.lower(text) if low is None else low
    severe, mild = count_of(low, fixed.SEVERE), count_of(low, fixed.MILD)
    return (
        F.when(given(F.trim(text)).isNull(), 0.5)
        .when(count_of(low, fixed.CATASTROPHIC) > 0, 1.0)
        .when(severe > 0, F.least(0.7 + severe * 0.05, F.lit(0.9)))
        .when(count_of(low, fixed.MODERATE) > 0, 0.5)
        .when(mild > 0, F.greatest(F.lit(0.1), 0.3 - mild * 0.05))
        .otherwise(0.5)
    )


def severity_proximity(a: Column, b: Column) -> Column:
    return F.exp(F.abs(a - b) * -3.0)


def meta_score(injuries: Column, comments: Column, sex: Column, age: Column, wanted: Column, gender: Column, wanted_age: Column, query_text: Column, low: Column | None = None) -> Column:
    """0.6 injury overlap + 0.2 severity proximity + 0.1 gender + 0.1 age, within 0 and 1.

    low is a column that has injuries and comments, joined, in lower case already.
    """
    text = F.concat_ws(" ", injuries, given(comments)) if low is None else low
    near = F.when(given(query_text).isNull(), 0.5).otherwise(severity_proximity(severity(text, low), severity(query_text)))
    score = injury_overlap(injuries, wanted) * 0.6 + near * 0.2 + gender_match(sex, gender) * 0.1 + age_proximity(age, wanted_age) * 0.1
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


#: Weights of the parts of a search, the default and two others.
WEIGHTS = {"semantic": 0.15, "injury": 0.40, "keyword": 0.35, "meta": 0.10}
PRESETS = {
    "balanced": WEIGHTS,
    "medical": {"semantic": 0.10, "injury": 0.65, "keyword": 0.20, "meta": 0.05},
    "impact": {"semantic": 0.15, "injury": 0.15, "keyword": 0.60, "meta": 0.10},
}


def weights(with_categories: bool, given_weights: dict[str, float] | None = None, normalise: bool = False) -> dict[str, float]:
    """The weights of a search; without a category selection the meta weight goes to the injuries."""
    w = dict(given_weights or WEIGHTS)
    if normalise:
        w = {k: v / (sum(w.values()) or 1.0) for k, v in w.items()}
    if not with_categories:
        w |= {"injury": w["injury"] + w["meta"], "meta": 0.0}
    return w
