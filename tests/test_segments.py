"""Running values over slots against a plain pass, with a group of a third of all rows."""

import random

from pyspark.sql import functions as F

from awardry.functions import fixed
from awardry.operators import consolidate, ingest
from awardry.operators.segments import SLOT, running, slotted


def table(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "big", "big", "big"]), i, rng.choice([None, None, None, "x", "y"]), rng.choice([None, 0, 1, 5])) for i in range(1500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, o int, t string, n int")


def test_running_values(spark):
    rows, df = table(spark)
    cut = slotted(df, ["g"], ["o"], slots=12)
    spread = {r.g: r.n for r in cut.groupBy("g").agg(F.countDistinct(SLOT).alias("n")).collect()}
    assert spread["big"] >= 5 and cut.groupBy(SLOT).count().agg(F.max("count")).first()[0] < 400  # no slot has the large group
    got = {r.o: (r.total, r.last) for r in running(cut, ["g"], ["o"], total=("sum", F.col("n")), last=("last", F.col("t"))).collect()}
    total, last = {}, {}
    for g, o, t, n in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + (n or 0)
        last[g] = t or last.get(g)
        assert got[o] == (total[g], last[g])
    assert running(slotted(df.limit(0), ["g"], ["o"]), ["g"], ["o"], total=("sum", F.col("n"))).count() == 0


def test_sections_and_records_of_a_large_document(spark):
    rng = random.Random(5)
    pages = [(d, p, rng.choice([None, "General", "ARMS", "spine", "Elbow"])) for d, n in ((1, 300), (2, 20), (3, 1)) for p in range(n)]
    df = spark.createDataFrame(pages, "doc_id int, page int, section string").repartition(3)
    for forward in (False, True):
        got = {(r.doc_id, r.page): r.section for r in ingest.filled_sections(df, forward, slots=8).collect()}
        parent, before = {}, {}
        for d, p, s in pages:
            up = s and s.upper()
            if up and any(m in up for m in fixed.MAIN_SECTIONS):
                parent[d] = up
            elif up and "GENERAL" in up and d in parent:
                up = f"{parent[d]} - {up}"
            before[d] = up or (before.get(d) if forward else None)
            assert got[d, p] == (before[d] or "UNKNOWN")
    rows = [(d, p, rng.random() < 0.6) for d, n in ((1, 300), (2, 20)) for p in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, page int, more boolean").repartition(3)
    got = {(r.doc_id, r.page): r.record for r in ingest.record_numbers(df, ["doc_id"], ["page"], F.col("more"), slots=8).collect()}
    seen = {1: 0, 2: 0}
    for d, p, more in rows:
        seen[d] += not more
        assert got[d, p] == seen[d]


def test_numbers_with_skewed_and_equal_orders(spark):
    rng = random.Random(3)
    rows = [(7, i) for i in range(700)] + [(rng.randrange(-5, 50) ** 3, 1000 + i) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ord long, k int").repartition(3)
    got = {r.k: r.id for r in consolidate.numbered(df, "ord", ["k"], slots=9).collect()}
    assert got == {k: f"case_{i + 1:04d}" for i, (_, k) in enumerate(sorted(rows))}
    assert slotted(df, [], ["ord", "k"], slots=9).groupBy(SLOT).count().agg(F.max("count")).first()[0] < 400  # ties are split by k
    assert consolidate.numbered(df.limit(0), "ord").count() == 0
