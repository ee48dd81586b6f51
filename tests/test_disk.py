"""What keeps a query's disk in proportion to its input: files that go when they have been read, compressed ones, rows moved once."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from awardry import working
from awardry.streaming import keyed

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle")}


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path):
    before = shuffle_files(spark)
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    dealt = working.stored(rows.repartition(5, "x"), "dealt")
    keyed.put(rows.groupBy("x").agg(F.count("*").alias("n")), str(tmp_path / "r"), 0)
    written = {f for f in shuffle_files(spark) - before if f.endswith(".data")}
    for _ in range(50):  # they go beside what runs next
        if not written & shuffle_files(spark):
            break
        time.sleep(0.2)
    assert not written & shuffle_files(spark) and dealt.count() == 1000
    assert spark.conf.get(working.CLEANUP) == "false"


def test_streamed_files_and_state_are_compressed(spark, monkeypatch, tmp_path):
    from awardry.plans import record_queries as R

    seen, run = {}, R.ingest_stream
    monkeypatch.setattr(R, "new_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(R, "ingest_stream", lambda spark, *a: seen.update({k: spark.conf.get(k) for k in R.STATE_STORE}) or run(spark, *a))
    before = {k: spark.conf.get(k, None) for k in R.STATE_STORE}
    sent = R.streaming_ingest(spark, SF)
    assert sent.count() > 0 and seen == R.STATE_STORE and {k: spark.conf.get(k, None) for k in R.STATE_STORE} == before
    files = [f.name for f in Path(tmp_path / "ingest" / "in").glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_the_last_version_sends_what_is_wanted_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2], "long"), (None, [3], "text")], "k string, v array<int>, t string")
    keyed.put(rows, str(tmp_path / "r"), 0)
    keyed.put(rows.where("k = 'a'").withColumn("v", F.array(F.lit(9))), str(tmp_path / "r"), 1)
    last = keyed.latest(spark, str(tmp_path / "r"), ["k"], [F.size("v").alias("n")])
    aggregate = last._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "n#" in aggregate and "t#" not in aggregate and "v#" not in aggregate
    assert {tuple(r) for r in last.collect()} == {("a", 1), (None, 1)}


def test_records_are_merged_where_their_rows_are(spark):
    """Rows that are dealt by document are numbered and merged with their plaintiffs without another shuffle, and parsed once."""
    from awardry.operators import ingest

    person = '{"plaintiff_id": "P%d", "plaintiff_name": "%s", "age": %d, "injuries": ["i%d"], "comments": "%s", "non_pecuniary_damages": %d}'
    rows = [
        (1, 0, '{"case_name": "A", "year": 2001, "comments": "x", "injuries": ["a"], "non_pecuniary_damages": 5, "plaintiffs": [%s, {"plaintiff_name": "Z"}]}' % (person % (1, "N", 30, 1, "m", 7))),
        (1, 1, '{"is_continuation": true, "year": 2002, "comments": "", "injuries": ["b", "a"], "non_pecuniary_damages": 9, "plaintiffs": [%s, {"plaintiff_name": "Y"}]}' % (person % (1, "M", 40, 2, "n", 3))),
        (1, 2, '{"is_continuation": true, "other_damages": [{"type": "t", "amount": 2}], "plaintiffs": []}'),
        (1, 3, '{"case_name": "B"}'), (2, 0, '{"is_continuation": true, "comments": "lost"}'), (2, 1, '{"case_name": "C", "plaintiffs": [%s]}' % (person % (2, "", 1, 3, "", 1))),
    ]
    order = ["page", "table_no", "row_no"]
    df = spark.createDataFrame([(d, p, 0, 0, x) for d, p, x in rows], "doc_id long, page int, table_no int, row_no int, payload string").repartition(3, "doc_id")
    numbered = ingest.record_numbers(ingest.decoded_rows(df), ["doc_id"], order, F.col("is_continuation"), sizes=df)
    merged = ingest.merged_records(numbered, order)
    assert "Join" not in optimized(merged)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the rows' own
    assert "numbered" not in "".join(ingest.ingest(df).inputFiles())
    got = {r.case_name: r for r in merged.collect()}
    a = got["A"]
    assert (a.year, a.page, a.comments, a.injuries, a.non_pecuniary_damages) == (2001, 0, "x", ["a", "b"], 9.0)
    assert [(p.plaintiff_id, p.plaintiff_name, p.age, p.injuries, p.comments, p.non_pecuniary_damages) for p in a.plaintiffs] == [
        ("P1", "N", 30, ["i1", "i2"], "m | n", 7.0), (None, "Z", None, [], None, None), (None, "Y", None, [], None, None)]
    assert [x.amount for x in a.other_damages] == [2.0]
    assert got["B"].plaintiffs is None and [p.plaintiff_id for p in got["C"].plaintiffs] == ["P2"] and len(got) == 3
    slots = ingest.record_numbers(ingest.decoded_rows(df), ["doc_id"], order, F.col("is_continuation"), slots=2)
    assert {r.case_name: r for r in ingest.merged_records(slots, order).select(merged.columns).collect()} == got
    cases, counts = ingest.counted_ingest(df)
    assert tuple(counts.first()) == (6, 3, 3, 3) and cases.count() == 3


def test_lines_are_dealt_to_bounded_tasks(spark, monkeypatch):
    from awardry.plans import adapters as A
    from awardry.plans import record_tables as R

    monkeypatch.setattr(working, "TASK_ROWS", 100)
    assert R.lines(spark, SF).rdd.getNumPartitions() == A.table(spark, SF, "lineitem").count() // 100 + 1
