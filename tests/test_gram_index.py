"""Boolean search from the index against the condition on every text."""

import random
import time

from pyspark.sql import functions as F

from awardry.operators import gram_index
from awardry.operators.boolean_query import condition


def test_random_queries(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(400)] + [(400, None), (401, ""), (402, "ab"), (403, "abc " * 9000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    path = str(tmp_path / "index")
    gram_index.write_gram_index(df, path, block=64)
    index = gram_index.read_gram_index(spark, path)
    assert index.agg(F.max("n")).first()[0] < 130

    def query(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([word(), word(), f'"{word()} {word()}"', f"NOT {word()}"])
        return rng.choice(["({} OR {})", "{} AND {}", "{} {}", "NOT ({} {})", "{} OR {}"]).format(query(depth - 1), query(depth - 1))

    fewer = 0
    for q in [query(2) for _ in range(12)] + ["abc", "ab", "abcab OR caba", "NOT abc", "abca AND NOT b", "()", "", "zzzz"]:
        want = sorted(r.id for r in df.where(condition(q, F.col("text"))).collect()) if q.strip() else []
        assert sorted(r.id for r in gram_index.indexed_boolean_search(df, index, q, F.col("text")).collect()) == want, q
        left = gram_index.candidates(index, q) if q else None
        fewer += left is not None and left.count() < 300
    assert fewer >= 4
    assert gram_index.candidates(index, "zzzz").count() == 0 and gram_index.candidates(index, "NOT abc") is None


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    gram_index.write_gram_index(df, str(tmp_path / "index"))
    index = gram_index.read_gram_index(spark, str(tmp_path / "index"))
    assert gram_index.indexed_boolean_search(df, index, "abc", F.col("text")).count() == 0


def test_a_long_text_takes_one_pass(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh é😀", k=500_000))
    df = spark.createDataFrame([(1, long + "xyz😀yz"), (2, "short"), (3, "xyz 😀yz")], "id long, text string")
    began = time.perf_counter()
    gram_index.write_gram_index(df, str(tmp_path / "index"))
    assert time.perf_counter() - began < 30  # by places in the text it took minutes
    index = gram_index.read_gram_index(spark, str(tmp_path / "index"))
    for q, want in (("xyz", [1, 3]), ("xyz😀yz", [1]), ("😀yz", [1, 3])):
        assert sorted(r.id for r in gram_index.indexed_boolean_search(df, index, q, F.col("text")).collect()) == want
