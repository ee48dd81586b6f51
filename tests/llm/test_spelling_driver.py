"""What op12's driver holds doesn't grow with the vocabulary."""

from awardry.llm import spelling


def test_only_few_rows_are_broadcast(spark, monkeypatch):
    """A table's compressed files are small; whether it is broadcast goes by its rows."""
    words = [(f"{a}{b}word{c}", 1 + 7 ** (i % 4)) for i, (a, b, c) in enumerate((a, b, c) for a in "abcd" for b in "efgh" for c in ("", "s", "y"))]
    df = spark.createDataFrame([*words, ("single", 5), ("élèves", 5), ("élèvés", 40)], "word string, n long")
    whole = sorted(map(tuple, spelling.spelling_variants(df, most=9).collect()))
    plans, store = [], spelling.stored

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(spelling, "stored", kept)
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 1)
    cut = spelling.spelling_variants(df, most=9)
    plans.append(cut._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    assert sorted(map(tuple, cut.collect())) == whole and any(r[1] for r in whole)
