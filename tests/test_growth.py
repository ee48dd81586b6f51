"""What keeps a query's work in proportion to its input: expressions that are evaluated once, and rows that are moved once."""

from pyspark.sql import functions as F

from awardry.functions import text
from awardry.operators import ingest, search
from awardry.operators.segments import few_each


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_query_are_split_once(spark):
    q = spark.createDataFrame([(1, "Bad hip, .whiplash;"), (2, None), (3, "")], "query_id long, text string")
    e = spark.createDataFrame([("hip", ["femur"]), ("whiplash", ["neck strain"])], "term string, related array<string>")
    terms = search.expand_queries(q, e)
    assert optimized(terms).count("split(trim(") == 1
    assert {(r.query_id, r.term) for r in terms.collect()} == {(1, "bad hip, .whiplash;"), (1, "hip"), (1, "femur"), (1, "whiplash"), (1, "neck strain"), (2, None), (3, "")}


def test_expanded_texts_of_marks_and_blanks(spark):
    q = spark.createDataFrame([(1, "Hip; pain"), (2, "")], "query_id long, text string")
    e = spark.createDataFrame([("hip", ["femur"])], "term string, related array<string>")
    told = {r.query_id: r.expanded for r in search.expanded_texts(q, e).collect()}
    assert told == {k: search.expanded_text(x, {"hip": ["femur"]}) for k, x in ((1, "Hip; pain"), (2, ""))}


ROWS = [(1, 0, '{"case_name": "A", "judge": "Lee J.", "is_continuation": false}'), (1, 1, '{"comments": "x", "is_continuation": true}'), (2, 0, "{not"), (2, 1, None), (2, 2, '{"year": 2001}')]


def test_payloads_are_parsed_once(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, page int, payload string")
    decoded = ingest.decoded_rows(rows)
    assert optimized(decoded).count("from_json(") <= 2  # of the payload, and of a judge that may be a list
    assert sorted((r.doc_id, r.page, r.judge) for r in decoded.collect()) == [(1, 0, ["Lee"]), (1, 1, None), (2, 2, None)]


def test_small_documents_are_numbered_without_slots(spark):
    rows = spark.range(60).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("page"), (F.col("id") % 3 != 0).alias("goes_on"))
    whole = ingest.record_numbers(rows, ["doc_id"], ["page"], F.col("goes_on"))
    assert "slotted" not in "".join(whole.inputFiles())
    dealt = ingest.record_numbers(rows, ["doc_id"], ["page"], F.col("goes_on"), slots=5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.select(whole.columns).collect()))
    assert few_each(rows, ["doc_id"], 9) and not few_each(rows, ["doc_id"], 8) and not few_each(rows, [], 99)


def test_judges_are_named_once_each(spark):
    names = text.judge_names(F.col("a"))
    df = spark.createDataFrame([(["A. Smith, J.", "The Hon. B. JONES J.A.", " J."],), ([],), (None,)], "a array<string>").select(names.alias("n"))
    assert optimized(df).count("regexp_extract_all(") == 1
    assert [r.n for r in df.collect()][:2] == [["Smith", "Jones", "J"], None]


def test_sections_are_read_in_one_pass_over_the_cells(spark):
    cells = spark.createDataFrame(
        [(1, 1, 0, 0, 0, "Knee - $5"), (1, 1, 0, 1, 0, "x"), (1, 2, 0, 1, 0, "left ANKLE"), (1, 2, 1, 0, 0, "a"), (1, 3, 0, 0, 0, "HEAD"), (1, 3, 1, 0, 0, "b"), (1, 4, 0, None, 0, "KNEE")],
        "doc_id long, page long, table_no int, row_no int, col_no int, text string",
    )
    pages = ingest.page_sections(cells)
    assert "Join" not in optimized(pages)
    assert sorted(map(tuple, pages.collect())) == [(1, 1, "Knee"), (1, 2, "ANKLE"), (1, 3, "HEAD")]


def test_headings_are_put_in_upper_case_once(spark):
    df = spark.createDataFrame([(" Knee - $1,000 ",), ("$5 knee",), ("Total knee",)], "t string").select(ingest.section_header(F.col("t")).alias("s"))
    assert optimized(df).count("upper(") == 1


def test_row_texts_need_no_join_of_cells_with_headers(spark):
    cells = spark.createDataFrame(
        [(1, 1, 0, 0, 0, "Plaintiff"), (1, 1, 0, 0, 1, "Year"), (1, 1, 0, 1, 0, " A"), (1, 1, 0, 1, 1, "nan"), (1, 1, 0, 2, 0, ""), (1, 1, 0, 2, 1, "2001"), (1, 2, 0, 0, 0, "x"), (1, 2, 0, 1, 0, "y")],
        "doc_id long, page long, table_no int, row_no int, col_no int, text string",
    )
    whole = ingest.row_texts(cells)
    assert "Join" not in optimized(whole)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, ingest.row_texts(cells, ingest.table_headers(cells)).collect())) == [(1, 1, 0, 1, "Plaintiff: A"), (1, 1, 0, 2, "Year: 2001")]


def test_json_cases_are_compressed_and_read_again(spark, tmp_path):
    from awardry.sources import cases

    df = spark.range(2000).select(F.concat(F.lit("case "), "id").alias("case_name"), F.array(F.lit("an injury of some length")).alias("injuries"), F.array().cast("array<string>").alias("plaintiffs"))
    cases.write_cases(df, str(tmp_path / "c"), "json")
    size = sum(f.stat().st_size for f in (tmp_path / "c").glob("part-*"))
    assert size < 40_000
    back = cases.read_cases(spark, str(tmp_path / "c"), "parsed", lines=True)
    assert sorted(r.ord for r in back.collect()) == list(range(2000)) and back.select("case_name").distinct().count() == 2000


def test_records_of_a_case_are_sent_as_rows(spark):
    from awardry.operators import consolidate
    from awardry.schemas import PARSED_CASE

    fields = {"case_name": "A", "year": 2001, "court": None, "injuries": ["x"], "is_continuation": False}
    rows = spark.createDataFrame([{**fields, "injuries": None}, {**fields, "comments": "c"}], PARSED_CASE).withColumn("ord", F.monotonically_increasing_id())
    merged = consolidate.consolidate(rows)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("collect_list") < plan.index("Exchange hashpartitioning")  # above it
    assert "partial_collect_list" not in plan[plan.index("Exchange hashpartitioning"):]
    got = merged.first()
    assert (got.n_records, got.injuries, len(got.plaintiffs)) == (2, ["x"], 2)


def test_reports_are_sent_to_python_once_for_their_expressions(spark):
    from awardry.operators import reports

    texts = [(1, "He was diagnosed with a cervical sprain injury. A minor pain."), (2, None), (3, " "), (4, "This causes difficulty with lifting boxes")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found, rejects = reports.analysed(rows)
    assert optimized(found.select("comment_injuries", "injuries", "sequelae")).count("run(") == 1
    own = {r.doc_id: r.c for r in rows.select("doc_id", text.comment_injuries(F.col("text")).alias("c")).collect()}
    assert {r.doc_id: r.comment_injuries for r in found.collect()} == {k: own[k] for k in (1, 4)}
    assert {r.doc_id for r in rejects.collect()} == {2, 3}


def test_texts_come_to_expressions_as_arrow(spark):
    df = spark.createDataFrame([("a knee injury of the left leg",), (None,)], "t string").select(text.matches(F.col("t"), [r"(\w+) injury"]).alias("m"))
    assert "ArrowEvalPython" in optimized(df) and "], 200" not in optimized(df)  # 200: a function of pandas series
    assert [r.m for r in df.collect()] == [["knee"], None]


def test_index_parts_texts_once(spark, tmp_path):
    from awardry.operators import keyword_index

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def parted(x):
        calls.add(1)
        return x.split()

    docs = spark.createDataFrame([(i, "a b a") for i in range(20)], "id long, x string").select("id", parted("x").alias("tokens"))
    keyword_index.write_index(docs, str(tmp_path / "index"))
    assert calls.value <= 40  # at most for the length and for the tokens, in one job
    index = keyword_index.read_index(spark, str(tmp_path / "index"))
    assert {(r.token, len(r.postings)) for r in index.collect()} == {("a", 20), ("b", 20)}


def test_lines_of_orders_are_dealt_to_bounded_tasks(spark, monkeypatch):
    """Claims, judges and a judge's first cases come in tasks whose number grows with the lines, whatever the session's is."""
    from awardry import working
    from awardry.operators import entities
    from awardry.plans import adapters as A

    data = "/root/testdata/sf0.001"
    whole = {r.id: r for r in A.claimed_cases(spark, data).collect()}
    first = {tuple(r) for r in entities.judge_cases(A.judged_cases(spark, data)).select("judge", "id").collect()}
    monkeypatch.setattr(working, "TASK_ROWS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    n = A.table(spark, data, "lineitem").count() // 100 + 1
    claimed, judged = A.claimed_cases(spark, data), A.judged_cases(spark, data)
    of_judges = entities.judge_cases(judged, tasks=A.line_tasks(spark, data))
    assert [df.rdd.getNumPartitions() for df in (claimed, judged, of_judges)] == [n] * 3
    assert {r.id: r for r in claimed.collect()} == whole
    assert {tuple(r) for r in of_judges.select("judge", "id").collect()} == first
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_search_without_outliers_scores_each_case_once(spark):
    from awardry.operators import search

    rows = [(i, i, f"n{i}", ["arm"], "pain", None, None, None, ["a"], None, i % 7 * 10.0) for i in range(100)]
    kind = "id long, ord long, case_name string, injuries array<string>, comments string, summary_text string, sex string, age int, regions array<string>, vec array<float>, damages double"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cases = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    got = search.search_without_outliers(cases, search.Query("arm", ["arm"], ["arm"]), "damages", 10, threshold=0.2).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and got
    assert seen.value == 100


def test_quantiles_of_small_groups_need_no_join(spark, monkeypatch):
    import numpy as np

    from awardry.operators import statistics

    rows = [(None if i % 4 == 0 else i % 4, float(i * i % 37) if i % 11 else None, i / 7) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    wanted = {"a": {"a1": 0.25, "a2": 0.5}, "b": {"b2": 0.5}}
    cut = {r.g: r for r in statistics.all_quantiles(df, ["g"], wanted, most=5).collect()}  # by buckets that are cut
    monkeypatch.setattr(statistics, "_inside", None)
    got = {r.g: r for r in statistics.all_quantiles(df, ["g"], wanted).collect()}
    assert got == cut and len(got) == 4
    for g, r in got.items():
        a, b = [x[1] for x in rows if x[0] == g and x[1] is not None], [x[2] for x in rows if x[0] == g]
        assert np.allclose([r.a1, r.a2, r.b2], [np.quantile(a, 0.25), np.median(a), np.median(b)])
