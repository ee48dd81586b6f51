"""Operators on the small fixtures that were worked out by hand."""

import json
import random

import numpy as np
import pytest
from awardry.functions import predicates, scores, text
from awardry.operators import anatomy, boolean_query, consolidate, entities, inflation, ingest, outliers, reports, search, statistics
from awardry.schemas import PARSED_CASE, PARSED_ROW
from awardry.sources import cases as S
from awardry.sources import cpi as C
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def column_of(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_section_headers(spark):
    good = ["GENERAL", "HEAD", "BRAIN & SKULL", "MISCELLANEOUS", "MOST SEVERE INJURIES", "FATAL INJURIES", "ELBOW", "WHIPLASH", "EARS/HEARING", "SKIN", "BURNS", "PARAPLEGIA", "ARMS", "LEGS", "BODY", "SPINE"]
    assert column_of(spark, ingest.section_header, good) == good
    bad = ["GENERAL DAMAGES", "NON-PECUNIARY", "$85,000", "Defendant's motion", "P11: FEMALE", "", None]
    assert column_of(spark, ingest.section_header, bad) == [None] * 7
    assert column_of(spark, ingest.section_header, ["SISTER - $8,000.00", "DAUGHTER -"]) == ["SISTER", "DAUGHTER"]


def test_inflation(spark, tmp_path):
    rows = [(75000.0, 2010, 105596.74), (95000.0, 2015, 123082.17), (125000.0, 2020, 149662.31), (85000.0, 2023, 88717.76)]
    means = {2010: 116.4667, 2015: 126.5667, 2020: 136.9583, 2023: 157.1083, 2025: 163.98}
    exact = {2010: 1397.6 / 12, 2015: 1518.8 / 12, 2020: 1643.5 / 12, 2023: 1885.3 / 12, 2025: 163.98}
    assert all(abs(exact[y] - m) < 1e-4 for y, m in means.items())
    cpi = spark.createDataFrame(list(exact.items()), "year int, cpi double")
    got = inflation.adjust(spark.createDataFrame([r[:2] for r in rows], "amount double, year int"), cpi).collect()
    assert sorted((r.amount, r.year, r.adjusted) for r in got) == sorted(rows)
    missing = inflation.adjust(spark.createDataFrame([(1.0, 1900), (1.0, None)], "amount double, year int"), cpi)
    assert [r.adjusted for r in missing.collect()] == [None, None]
    rates = inflation.rate(spark.createDataFrame([(2010, 2024), (2020, 2024)], "start_year int, end_year int"), C.built_in_cpi(spark))
    assert sorted(r.rate for r in rates.collect()) == [pytest.approx(17.44, 0.01), pytest.approx(38.11, 0.01)]
    lines = ["CANSIM,v1", "2025-01,10R", "2025-02, 20", "bad,1", "2024-13x,5", "2024-01,x"]
    (tmp_path / "cpi.csv").write_text("\n".join(lines))
    assert [tuple(r) for r in C.read_cpi(spark, str(tmp_path / "cpi.csv"), least_years=0).collect()] == [(2025, 15.0)]
    assert C.read_cpi(spark, str(tmp_path / "cpi.csv")).count() == 112
    C.write_cpi(C.built_in_cpi(spark), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 112
    assert tuple(C.cpi_info(C.built_in_cpi(spark)).first()) == (1914, 2025, 112, "Fallback data (112 years: 1914-2025)")


def test_text_functions(spark):
    assert column_of(spark, text.title_case, ["harrison-young", "O'BRIEN", "mackinnon"]) == ["Harrison-Young", "O'Brien", "Mackinnon"]
    assert column_of(spark, text.judge_name, ["Smith J.", "A. Smith J.A.", "Hon. John Smith J.", "Smith, J.", "", "The Honourable B. O'BRIEN C.J.O."]) == ["Smith"] * 4 + [None, "O'Brien"]
    assert column_of(spark, lambda c: text.judge_names(text.as_list(c)), ['["Smith J.","Jones J.A."]', "Smith J.", None]) == [["Smith", "Jones"], ["Smith"], None]
    assert column_of(spark, text.tokens, ["café zoë c5 x_y ab"]) == [["ab"]]
    got = column_of(spark, text.comment_injuries, ["He had a tbi, chronic pain. hip fracture"])[0]
    assert "chronic pain" in got and "hip fracture" in got and "tbi" not in got
    assert column_of(spark, text.type_label, ["future_loss_of_income"]) == ["Future Loss Of Income"]
    assert column_of(spark, text.phrases, [" A, ,b "]) == [["a", "b"]]
    assert one(spark, text.distinct_folded(F.col("a")), a=["Neck", " neck", "Hip"]) == ["Neck", "Hip"]
    assert column_of(spark, lambda c: text.shortened(c, 3), ["abcd", "abc"]) == ["abc...", "abc"]


def test_scores(spark):
    diffs = [0, 5, 10, 20, 21]
    assert [one(spark, scores.age_proximity(F.lit(30 + d), F.lit(30))) for d in diffs] == [1.0, 0.85, 0.7, 0.5, 0.3]
    assert one(spark, scores.age_proximity(F.lit(None).cast("int"), F.lit(1))) == 0.5
    terms = ["quadriplegia", "chronic pain", "mild traumatic brain injury", "whiplash", "ongoing", ""]
    assert column_of(spark, scores.severity, terms) == [pytest.approx(x) for x in (1.0, 0.75, 0.75, 0.25, 0.5, 0.5)]
    assert one(spark, scores.severity_proximity(F.lit(0.75), F.lit(0.25))) == pytest.approx(0.223130, abs=1e-6)
    doc = F.concat(F.array(F.lit("hip")), F.array_repeat(F.lit("x"), 99))
    assert one(spark, scores.bm25(doc, ["hip"])) == pytest.approx(1.0) and one(spark, scores.keyword_score(doc, ["hip"])) == pytest.approx(0.1)
    assert one(spark, scores.injury_overlap(F.col("c"), F.col("q")), c=["A ", "c"], q=["a", "b"]) == 0.5
    assert one(spark, scores.injury_list_match(F.col("c"), F.col("q")), c=["hip fracture"], q=["hip", "neck"]) == 0.5
    assert one(spark, scores.gender_match(F.lit("M"), F.lit("male"))) == 1.0 and one(spark, scores.gender_match(F.lit("M"), F.lit("male"), literal=True)) == 0.0
    w = scores.weights(False)
    assert w == {"semantic": 0.15, "injury": pytest.approx(0.5), "keyword": 0.35, "meta": 0.0}


def test_boolean(spark):
    body = "c5 disc herniation, no surgery"
    cases = {"disc AND herniation": True, "neck OR disc": True, "disc NOT surgery": False, '"disc herniation"': True, "disc herniation": True, "AND": True,
             "disc not": False, "(neck OR disc) no": True, "NOT (neck disc)": True, "neck OR (disc": True, "disc) neck": False, "no NOT": False}
    for q, want in cases.items():
        assert column_of(spark, lambda c: boolean_query.condition(q, F.lower(c)), [body]) == [want], q
    assert column_of(spark, lambda c: boolean_query.condition("(neck", F.lower(c), brackets=False), [body]) == [False]
    df = spark.createDataFrame([(1, "a b", "en", 2000, 5.0)], "id int, t string, r string, y int, d double")
    assert boolean_query.boolean_search(df, " ", F.col("t")).count() == 0
    assert boolean_query.boolean_search(df, "b", F.col("t"), year=F.col("y"), min_year=2001).count() == 0


def test_boolean_against_a_model(spark):
    import random

    rng = random.Random(1)
    words = ["aa", "bb", "cc", "dd"]
    docs = [" ".join(w for w in words if rng.random() < 0.5) for _ in range(16)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    for _ in range(25):
        parts, py = [], []
        for k in range(rng.randrange(1, 5)):
            ands = [(rng.random() < 0.3, rng.choice(words)) for _ in range(rng.randrange(1, 4))]
            parts.append(rng.choice([" ", " and "]).join(("NOT " if n else "") + w for n, w in ands))
            py.append(ands)
        got = {r.i for r in df.where(boolean_query.condition(" or ".join(parts), F.col("t"))).collect()}
        assert got == {i for i, d in enumerate(docs) if any(all((w in d) != n for n, w in ands) for ands in py)}


def test_outliers(spark):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in (10, 11, 12, 13, 100, None, 0)], "v double")
    assert sorted(r.v for r in outliers.without_outliers(df, "v").where("v > 0").collect()) == [10, 11, 12, 13]
    assert outliers.without_outliers(df, "v").count() == 6
    assert outliers.without_outliers(spark.createDataFrame([(1.0,), (2.0,), (1000.0,)], "v double"), "v").count() == 3
    counts = [outliers.without_outliers(df, "v", threshold=t).count() for t in (0.1, 0.5, 1.5, 100)]
    assert counts == sorted(counts)
    g = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 99)] + [(None, 5.0)], "g string, v double")
    assert outliers.without_outliers(g, "v", ["g"]).count() == 5


def test_cap_and_report(spark):
    df = spark.createDataFrame([(100000.0,), (200000.0,), (400000.0,)], "a double")
    got = {r.measure: (round(r.percent, 1), r.band) for r in statistics.cap_comparison(df, "a").collect()}
    assert got == {"min": (23.0, "low"), "median": (46.1, "moderate"), "max": (92.2, "very high")}
    assert statistics.cap_comparison(df.limit(1), "a").count() == 0
    r = spark.createDataFrame([(i + 1, "c", 2000, "SCJ", d, 0.92, "s" * 500) for i, d in enumerate((75000.0, 80000.0, 65000.0))], "rank int, case_name string, year int, court string, damages double, combined double, summary_text string")
    s, top = reports.damages_report(r)
    assert tuple(s.first()) == (75000.0, pytest.approx(73333.33, abs=0.01), 65000.0, 80000.0, 3)
    assert top.first().match_percent == 92.0 and len(top.first().summary_text) == 403


def test_damages_value(spark):
    assert one(spark, predicates.damages_value(F.lit(0), F.lit(5.0))) == 5.0
    assert one(spark, predicates.total_award(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, predicates.total_award(F.lit(0.0), F.lit(0.0), old_rule=True)) == 0.0


HEADERS = ["Plaintiff", "Defendant", "Sex", "Non-Pecuniary", "Comments", "Age", "General", "Damages"]


def test_tables(spark):
    assert one(spark, ingest.mapped_headers(F.col("h"), F.lit(5)), h=HEADERS) == ["Plaintiff", "Defendant", "Sex/Age", "Non-Pecuniary Damages", "Comments"]
    assert one(spark, ingest.mapped_headers(F.col("h"), F.lit(3)), h=["Year"]) == ["Year", "Col_1", "Col_2"]
    cells = [("d", 1, 0, 0, 0, "Plaintiff"), ("d", 1, 0, 0, 1, "Year"), ("d", 1, 0, 1, 0, "A"), ("d", 1, 0, 1, 1, "2001"), ("d", 1, 0, 2, 0, " "), ("d", 1, 0, 2, 1, ""),
             ("d", 2, 0, 0, 0, "HEAD - $5"), ("d", 2, 0, 1, 0, "Case\nYear"), ("d", 2, 0, 1, 1, ""), ("d", 2, 0, 2, 0, "B"), ("d", 2, 0, 2, 1, "2002"),
             ("d", 3, 0, 0, 0, "GENERAL"), ("d", 3, 0, 1, 0, "x")]
    df = spark.createDataFrame(cells, "doc_id string, page int, table_no int, row_no int, col_no int, text string")
    heads = ingest.table_headers(df)
    assert {(r.page, tuple(r.headers), r.data_start_row) for r in heads.collect()} == {(1, ("Plaintiff", "Year"), 1), (2, ("Case", "Year"), 2)}
    assert {r.row_text for r in ingest.row_texts(df, heads).collect()} == {"Plaintiff: A\nYear: 2001", "Case: B\nYear: 2002"}
    sections = ingest.filled_sections(ingest.page_sections(df))
    assert {r.page: r.section for r in sections.collect()} == {1: "UNKNOWN", 2: "HEAD", 3: "HEAD - GENERAL"}


def test_ingest(spark):
    rows = [
        (0, {"case_name": "A", "judge": ["Smith J."], "non_pecuniary_damages": 100, "comments": "x", "injuries": ["a"], "plaintiffs": [{"plaintiff_id": "P1", "injuries": ["k"], "comments": "m"}]}),
        (1, {"is_continuation": True, "non_pecuniary_damages": 150, "comments": "y", "injuries": ["b", "a"], "plaintiffs": [{"plaintiff_id": "P1", "non_pecuniary_damages": 3, "comments": "n"}, {"plaintiff_name": "Z"}]}),
        (2, {"case_name": "B", "judge": "Jones J.A.", "non_pecuniary_damages": 50}),
        (3, {"case_name": " "}),
    ]
    payload = [("d", 1, 0, i, json.dumps(r)) for i, r in rows] + [("d", 1, 0, 9, "not json"), ("e", 1, 0, 0, json.dumps({"is_continuation": True, "comments": "lost"}))]
    df = spark.createDataFrame(payload, "doc_id string, page int, table_no int, row_no int, payload string").repartition(3)
    got = {r.case_name: r for r in ingest.ingest(df).collect()}
    assert sorted(got) == ["A", "B"]
    a = got["A"]
    assert (a.non_pecuniary_damages, a.comments, a.judge) == (150.0, "x | y", ["Smith"]) and set(a.injuries) == {"a", "b", "k"}
    assert [(p.plaintiff_id, p.plaintiff_name, p.non_pecuniary_damages, p.comments) for p in a.plaintiffs] == [("P1", None, 3.0, "m | n"), (None, "Z", None, None)]
    assert got["B"].judge == ["Jones"] and got["B"].plaintiffs is None
    decoded = ingest.decoded_rows(df)
    assert tuple(ingest.ingest_counts(decoded, ingest.ingest(df)).first()) == (5, 3, 2, 2)
    assert len(PARSED_ROW) > 100


def parsed(spark, records):
    full = [{**{"case_name": "X", "year": 2000, "court": "SCJ", "ord": i}, **r} for i, r in enumerate(records)]
    return spark.createDataFrame([json.dumps(r) for r in full], "string").select(F.from_json("value", PARSED_CASE + ", ord long").alias("r")).select("r.*")


def test_consolidation(spark):
    df = parsed(spark, [
        {"non_pecuniary_damages": 100, "category": "KNEE", "comments": "one", "injuries": ["b"], "other_damages": [{"type": "t", "amount": 7}]},
        {"non_pecuniary_damages": 100, "category": "HIP", "comments": "two", "injuries": ["a"]},
        {"case_name": None, "year": None, "court": None, "plaintiffs": [{"plaintiff_id": "P2", "age": 3}, {"plaintiff_name": "n"}, {"plaintiff_id": "P2"}], "region": '["UNKNOWN"]'},
        {"case_name": "", "year": None, "court": None, "category": "UNKNOWN"},
    ])
    for parts in (1, 4):
        got = {r.case_name: r for r in consolidate.dashboard(consolidate.consolidate(df.repartition(parts))).collect()}
        x, u = got["X"], got["Unknown"]
        assert x.extended_data.categories == ["HIP", "KNEE"] and x.category == "HIP" and x.damages == 200.0
        assert (x.pecuniary_damages, x.total_award, x.comments, x.id, x.extended_data.num_plaintiffs) == (7.0, 207.0, "one", "case_0001", 2)
        assert x.summary_text == "Injuries: a, b | Categories: HIP, KNEE | Comments: one"
        assert [p.plaintiff_id for p in u.extended_data.plaintiffs] == ["P2", "P3"] or [p.plaintiff_id for p in u.extended_data.plaintiffs][0] == "P2"
        assert u.region == "UNKNOWN" and u.id == "case_0002"
    first = consolidate.dashboard(consolidate.consolidate(df, anonymous="first", carry_other_damages=False)).where("case_name = 'X'").first()
    assert first.damages == 100.0 and first.total_award == 100.0
    assert S.detect_format(df) == "ai_parsed"
    cover = consolidate.coverage(df, consolidate.consolidate(df)).first()
    assert (cover.rows_before, cover.rows_after, cover.mismatch) == (4, 2, False)
    old = consolidate.per_plaintiff(df).orderBy("id").collect()
    assert len(old) == 6 and old[0].id == "case_0001" and old[0].region == "KNEE"


def test_claims_and_judges(spark):
    claims = [("r", 10.0, None, True, None), ("r", 20.0, None, False, None), ("r", 0.0, None, True, None), ("r", None, None, True, None), ("s", 30.0, None, None, None)]
    kind = "array<struct<relationship: string, amount: double, description: string, is_fla_award: boolean, category: string>>"
    df = spark.createDataFrame([(1, "c", 2000, claims, ["ann lee", "ANN LEE", ""], [" knee", "Bad"])], f"ord int, case_name string, year int, claims {kind}, judges array<string>, regions array<string>")
    assert sorted(r.amount for r in entities.awards(df).collect()) == [10.0, 30.0]
    assert {(r.category, r.amount) for r in entities.by_claim_category(df).collect()} == {("FLA: r", 10.0), ("FLA: s", 30.0)}
    assert [r.judge for r in entities.judge_cases(df).collect()] == ["Ann Lee"]
    valid = spark.createDataFrame([("KNEE",)], "category string")
    assert {r.category for r in entities.all_categories(df, valid).collect()} == {"KNEE", "FLA: r", "FLA: s"}
    assert entities.by_category(df, valid.limit(0)).count() == 2
    with pytest.raises(ValueError):
        entities.selected(df, "case_name", [str(i) for i in range(9)])


ANATOMY = [(0, "rotator cuff", ["shoulder_left", "shoulder_right"]), (1, "tibia", ["lower_leg_left", "lower_leg_right"]), (2, "c5-c6", ["cervical_spine"]), (3, "acl", ["knee_left", "knee_right"])]


def test_anatomy(spark):
    d = spark.createDataFrame(ANATOMY, "ord int, term string, regions array<string>")
    rows = [
        ("comminuted tibial fracture", "The patient sustained a comminuted left tibial fracture in the MVA", ["lower_leg_left"]),
        ("rotator cuff tear", "MRI reveals a full-thickness right rotator cuff tear", ["shoulder_right"]),
        ("C5-C6 disc herniation", "Cervical spine imaging shows C5-C6 disc herniation with cord compression", ["cervical_spine"]),
        ("ACL tear", "Examination reveals bilateral ACL tears", ["knee_left", "knee_right"]), ("zzz", None, []),
    ]
    df = spark.createDataFrame(rows, "term string, context string, want array<string>")
    assert all(r.regions == r.want for r in anatomy.term_regions(df, d).collect())
    texts = spark.createDataFrame([(1, rows[1][1]), (2, "nothing"), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in anatomy.text_regions(texts, d).collect()] == [(1, "shoulder_right")]
    found, rejected = reports.analysed(spark.createDataFrame([(1, "Diagnosed with severe left rotator cuff tear. Unable to lift weights."), (2, " ")], "doc_id int, text string"), dictionary=d)
    r = found.first()
    assert r.severity == "severe" and r.injured_regions == ["shoulder_left"] and r.injuries and rejected.count() == 1


def test_search_helpers(spark):
    related = {"whiplash": ["neck strain", "cervical sprain"], "hip": ["femur"]}
    assert search.expanded_terms("Whiplash", related) == ["cervical sprain", "neck strain", "whiplash"]
    q = spark.createDataFrame([(1, "bad hip, whiplash")], "query_id int, text string")
    e = spark.createDataFrame(list(related.items()), "term string, related array<string>")
    assert {r.term for r in search.expand_queries(q, e).collect()} == {"hip", "femur", "bad hip, whiplash", "whiplash", "neck strain", "cervical sprain"}
    rows = spark.createDataFrame([(1, "A ", 0.5), (2, "a", 0.5), (3, " ", 0.9), (4, "b", 0.7)], "ord int, case_name string, combined double")
    assert [(r.ord, r["rank"]) for r in search.top(search.deduplicated(rows), 5).collect()] == [(4, 1), (1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "regions.json").write_text(json.dumps({"knee": {"label": "Knee", "compendium_terms": ["ACL", "MCL"]}, "hip": {"label": "Hip", "compendium_terms": []}}))
    assert {tuple(r) for r in S.read_region_terms(spark, str(tmp_path / "regions.json")).collect()} == {("knee", "Knee", "ACL"), ("knee", "Knee", "MCL"), ("hip", "Hip", None)}
    (tmp_path / "tree.json").write_text(json.dumps({"injury_categories": {"a": {"label": "A", "subcategories": [" knee ", "Hip"]}}, "status_filters": {}}))
    tree = S.read_category_tree(spark, str(tmp_path / "tree.json"))
    assert {r.category for r in S.valid_categories(tree).collect()} == {"KNEE", "HIP"}
    (tmp_path / "cases.json").write_text(json.dumps([{"case_name": "A", "judge": ["x", "y"], "region": "r", "plaintiffs": []}, {"case_name": "B", "judge": "z"}]))
    got = S.read_cases(spark, str(tmp_path / "cases.json"), "parsed").orderBy("ord").collect()
    assert [(r.ord, r.case_name, r.judge, r.region) for r in got] == [(0, "A", ["x", "y"], ["r"]), (1, "B", ["z"], None)]
    out = S.convert_cases(S.read_cases(spark, str(tmp_path / "cases.json"), "parsed"), str(tmp_path / "dash"))
    assert out.count() == 2 and S.detect_format(out) == "unknown"
    S.write_vectors(spark.createDataFrame([("i", [3.0, 4.0])], "case_id string, vec array<float>"), str(tmp_path / "vec"))
    assert spark.read.parquet(str(tmp_path / "vec")).first().vec_norm == 5.0


def test_streams(spark, tmp_path):
    from awardry.streaming.ingest import ingest_stream, latest_version

    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    args = [str(tmp_path / d) for d in ("in", "records", "store", "checkpoint")]
    put("1.json", [{"ord": 0, "case_name": "A", "year": 1, "court": "x", "category": "K"}, {"ord": 1, "case_name": "B", "year": 1, "court": "x"}])
    ingest_stream(spark, *args).awaitTermination()
    put("2.json", [{"ord": 2, "case_name": "A", "year": 1, "court": "x", "category": "H"}])
    ingest_stream(spark, *args).awaitTermination()
    got = {r.case_name: r for r in latest_version(spark, args[2]).collect()}
    assert got["A"].n_records == 2 and got["A"].categories == ["H", "K"] and got["B"].n_records == 1


def test_vectors(spark):
    from awardry.operators.embedding import similarities, with_vectors

    df = with_vectors(spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string"), "t")
    q = df.where("i = 1").first().vec
    got = {r.i: r.similarity for r in similarities(df, q).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0


class Picky:
    """A model that fails on a text."""

    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[len(t), 1.0] for t in texts]


def test_a_bad_text_costs_its_own_vector_alone(spark):
    from awardry.operators.embedding import encoded, with_vectors

    rows, failed = encoded(Picky(), ["a", "bad", "ccc", "bad", "e" * 5, "", "gg"], 2)
    assert failed == 2 and [r.tolist() for r in rows] == [[1, 1], [0, 0], [3, 1], [0, 0], [5, 1], [0, 1], [2, 1]]
    failures = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "bad" if i in (17, 400) else "x" * i) for i in range(1000)] + [(1000, None)], "i int, t string").coalesce(1)
    got = {r.i: list(r.vec) for r in with_vectors(df, "t", model=Picky, dimensions=2, failures=failures).collect()}
    assert got == {i: [0, 0] if i in (17, 400) else [i % 1000, 1] for i in range(1001)}
    assert failures.value == 2


def test_reloaded_index_may_have_few_years(spark, tmp_path):
    from awardry.sources import cpi

    for name, values in (("old", (1, 2)), ("new", (3, 5))):
        (tmp_path / f"{name}.csv").write_text("month,value\n" + "".join(f"{y}-{m:02d},{v}\n" for y, v in zip((2001, 2002), values) for m in (1, 2)))
    old = cpi.read_cpi(spark, str(tmp_path / "old.csv"), least_years=1).persist()
    assert old.count() == 2
    got = {r.year: r.cpi for r in cpi.reload_cpi(spark, old, str(tmp_path / "new.csv"), least_years=1).collect()}
    assert got == {2001: 3.0, 2002: 5.0} and not old.is_cached
    assert cpi.reload_cpi(spark, old, str(tmp_path / "new.csv")).count() > 10  # too few years: the built-in index


def test_quantiles_by_brute_force(spark):
    """Exact quantiles of groups of all sizes, with repeated, negative, zero and missing values and a missing group."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 0.0, -3.5, round(rng.lognormvariate(8, 2), 2)])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {"q0": 0.0, "q10": 0.1, "mid": 0.5, "q75": 0.75, "q100": 1.0}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    got = {r.g: r for r in statistics.quantiles(df, ["g"], "v", at).collect()}
    assert got.keys() == {g for g, v in groups.items() if v}
    for g, r in got.items():
        assert np.allclose([r[k] for k in at], np.quantile(groups[g], list(at.values())))
    every = [v for _, v in rows if v is not None]
    assert np.allclose(list(statistics.quantiles(df, [], "v", at).first()), np.quantile(every, list(at.values())))
    assert statistics.quantiles(df.limit(0), ["g"], "v", at).count() == 0
    plan = statistics.award_statistics(df.selectExpr("g", "v as amount", "v as adjusted", "1990 as year"), ["g"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_quantiles_of_close_values_are_cut_until_they_are_few(spark, monkeypatch):
    """Values within 2 % of one another, negative, tiny and huge ones: no task looks through more than most different values."""
    rng = random.Random(6)
    rows = [("close", 1000 + i / 100_000, -float(i)) for i in range(2000)] + [("wide", rng.lognormvariate(0, 30), None) for _ in range(1500)] + [("same", 5.0, 5.0)] * 500
    rows += [("two", v, 1.0) for v in [1e-300] * 300 + [1e300] * 301] + [("nan", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    wanted = {"v": {"v10": 0.1, "v50": 0.5, "v99": 0.99}, "w": {"w25": 0.25, "w100": 1.0}}
    monkeypatch.setattr(statistics, "CUTS", 4)
    seen, inside = [], statistics._inside
    monkeypatch.setattr(statistics, "_inside", lambda c, b, k: seen.append(b.collect()) or inside(c, b, k))
    got = {r.g: r for r in statistics.all_quantiles(df, ["g"], wanted, most=50).collect()}
    assert len(seen) > 2
    for g in ("close", "wide", "same", "two", "nan"):
        for c, at in (("v", wanted["v"]), ("w", wanted["w"])):
            values = [x for h, v, w in rows for x in [v if c == "v" else w] if h == g and x is not None and x == x]
            for name, q in at.items():
                assert (got[g][name] is None) if not values else np.isclose(got[g][name], np.quantile(values, q), rtol=1e-12), (g, name)
    last = spark.createDataFrame(seen[-1], "g string, m int, ranks array<struct<q:string,end:string,r:bigint,part:double>>, base long, d long, lo double, hi double")
    assert last.where("d > 50 and lo < hi").isEmpty()


def test_statistics_read_their_source_once(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 2000), ("a", 3.0, 4.0, 2001)], "g string, amount double, adjusted double, year int")
    once = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (once.add(1), r)[1]).toDF(df.schema)
    assert statistics.award_statistics(counted, ["g"]).collect()[0].median_adjusted == 3.0
    assert once.value == 2


def test_parts_of_files_are_numbered_in_order(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 7).selectExpr("concat('n', id) as case_name", "id as year")
    rows.write.json(f"{tmp_path}/c")
    got = S.read_cases(spark, f"{tmp_path}/c", "flat", lines=True).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(3000)) and [r.year for r in got] == sorted(r.year for r in got)


def test_category_by_name_and_its_points(spark):
    schema = "case_name string, year int, damages double, adjusted double, region string, regions array<string>, claims array<struct<relationship: string, amount: double, is_fla_award: boolean, description: string>>"
    claim = lambda r, a, ok: (r, a, ok, None)
    rows = [
        ("a", 2000, 10.0, 12.0, "Knee", ["hip"], [claim(" Spouse", 5.0, None), claim("child", 1.0, False)]), ("b", 2001, None, None, None, ["KNEE"], [claim("child", 3.0, True)]),
        ("c", None, 5.0, None, "x", None, None), ("d", 2003, 8.0, None, "x", [], [claim("SPOUSE ", 0.0, True)]),
    ]
    df = spark.createDataFrame(rows, schema)
    names = lambda n: sorted(r.case_name for r in entities.category_cases(df, n).collect())
    assert names("knee") == ["a", "b"] and names("FLA: spouse ") == ["a", "d"] and names("FLA: Child") == ["b"] and names("y") == []
    points = lambda **k: sorted((r.case_name, r.award, r.adjusted) for r in entities.category_points(df, "FLA: spouse", **k).collect())
    assert points() == [("a", 10.0, 12.0), ("d", 8.0, 8.0)] and points(claim_amounts=True) == [("a", 5.0, 5.0)]


def test_judges_keep_a_bare_initial(spark):
    assert column_of(spark, text.judge_name, ["John J", "John J.", "Roe, C.J."]) == ["J", "John", "Roe"]
