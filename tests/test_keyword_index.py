"""The inverted index against scoring every document."""

import random

from pyspark.sql import functions as F

from awardry.operators import keyword_index, search


def scored_all(docs, queries, n):
    found = search.keyword_scores(docs, queries).withColumn("s", F.round("keyword", 9))
    return sorted((r.query_id, r.id, r.s, r["rank"]) for r in search.top_of_each(found, "query_id", n, "s", "id").collect())


def test_exact_and_skipping(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        size = int(rng.lognormvariate(3.5, 1.2))
        words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(size)]
        if i % 400 == 7:
            words += ["rare", "w1", "w1"] * 5
        rows.append((i, words))
    rows += [(3000, []), (3001, None), (3002, ["w1"] * 5), (3003, ["w1"] * 5)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["w1", "w2", "w1"]), (2, ["rare", "w5"]), (3, ["absent"]), (4, []), (5, ["w1"]), (6, [f"w{i}" for i in range(40)])], "query_id int, tokens array<string>")
    path = str(tmp_path / "index")
    keyword_index.write_index(docs, path, block=64)
    index = keyword_index.read_index(spark, path)
    assert index.selectExpr("max(size(postings)) as m").first().m < 64 * 2  # a token that most documents have is many rows
    for n in (1, 10, 5000):
        best, blocks = keyword_index.indexed_top(index, queries, n)
        assert sorted((r.query_id, r.id, r.keyword, r["rank"]) for r in best.collect()) == scored_all(docs, queries, n)
        seen = {(r.query_id, r["round"]): r.n for r in blocks.groupBy("query_id", "round").agg(F.count("*").alias("n")).collect()}
        if n == 10:
            for q in (1, 5):  # words of most documents: most blocks can't hold one of the best
                assert seen[q, 0] > seen[q, 1] + seen.get((q, 2), 0)
        if n == 5000:
            assert not any(r == 0 for _, r in seen)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    keyword_index.write_index(spark.createDataFrame([], "id long, tokens array<string>"), path)
    index = keyword_index.read_index(spark, path)
    best, blocks = keyword_index.indexed_top(index, spark.createDataFrame([(1, ["a"])], "query_id int, tokens array<string>"), 5)
    assert best.count() == 0 and blocks.count() == 0
