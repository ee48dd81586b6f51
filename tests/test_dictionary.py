"""Dictionary terms in texts against looking for each."""

import random

import pytest

from awardry.operators import anatomy
from awardry.operators.dictionary import found_terms


def plain(texts, terms, context):
    out = []
    for i, t in texts:
        for k, w in terms:
            if t is not None and w is not None and w in t:
                at = t.index(w)
                out.append((i, k, at + 1, t[max(0, at - context) : at + len(w) + context]))
    return sorted(out)


@pytest.mark.parametrize("block_chars", [2_000_000, 30])
def test_nested_overlapping_and_repeated_terms(spark, block_chars):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, n)))
    terms = [(i, word(6)) for i in range(60)] + [(60, "ab"), (61, "ab"), (62, None), (63, ""), (64, "a" * 50)]
    texts = [(f"t{i}", word(60)) for i in range(80)] + [("null", None), ("empty", ""), ("long", "ab" * 20_000), ("t1", "again ab")]
    t, d = spark.createDataFrame(texts, "k string, x string"), spark.createDataFrame(terms, "ord int, term string")
    got = found_terms(t, d, "k", "x", "ord", "term", context=4, block_chars=block_chars)
    assert got.dtypes == [("k", "string"), ("ord", "int"), ("at", "int"), ("near", "string")]
    assert sorted(map(tuple, got.collect())) == plain(texts, terms, 4)
    assert found_terms(t, d.limit(0), "k", "x", "ord", "term").count() == 0 and found_terms(t.limit(0), d, "k", "x", "ord", "term").count() == 0


def test_a_million_terms(spark):
    terms = spark.range(1_000_000).selectExpr("id as ord", "concat('term ', id, '.') as term")
    texts = spark.createDataFrame([(i, f"a term {i * 997}. and term {i}x") for i in range(1000)], "k long, x string")
    got = found_terms(texts, terms, "k", "x", "ord", "term").select("k", "ord", "at").collect()
    assert sorted(map(tuple, got)) == [(i, i * 997, 3) for i in range(1000)]


def plain_regions(terms, dictionary):
    """Before the side: the equal key, else the first that contains the term or is in it."""
    for t in terms:
        low = None if t is None else t.strip(" ").lower()
        hits = [d for d in dictionary if low is not None and (low in d[1] or d[1] in low)]
        yield next((d[2] for d in hits if d[1] == low), hits[0][2] if hits else [])


def test_term_regions(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    dictionary = [(i, word(7), [f"r{i}"]) for i in range(50)]
    terms = [word(8) for _ in range(200)] + [None, "", "  AB ", "ab"]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(terms)], "i int, term string, context string")
    got = anatomy.term_regions(rows, spark.createDataFrame(dictionary, "ord int, term string, regions array<string>"))
    assert got.columns == ["i", "term", "context", "regions"]
    assert [r.regions for r in got.sort("i").collect()] == list(plain_regions(terms, dictionary))
