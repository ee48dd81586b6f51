"""Queries do the whole job: all queries, whole texts, all languages."""

import re

import pytest
from awardry.functions import fixed
from awardry.plans import queries as Q

from tests.test_queries import SF, duck, rows_of  # noqa: F401


def test_hybrid_search_multi_takes_every_twentieth_row(spark, duck):  # noqa: F811
    got = Q.QUERIES["hybrid_search_multi"](spark, SF).toPandas()
    assert got["query_id"].nunique() == duck.sql("select count(*) from embeddings where vec_id % 20 = 0").fetchall()[0][0]
    assert rows_of(got) == rows_of(duck.sql(Q.MANY_SQL).df())


@pytest.mark.parametrize("most", [1, 7])
def test_search_many_in_several_blocks(spark, most):
    cases = Q.A.text_cases(spark, SF).limit(40).cache()
    queries = cases.where("id % 4 = 0").selectExpr("id as query_id", "vec").limit(3 * most).cache()
    rows = lambda **k: rows_of(Q.search.search_many(cases, queries, Q.QUERY, 3, **k).toPandas().round(6))
    assert rows(most=most) == rows()


@pytest.mark.parametrize("name", ["meta_score", "hybrid_search", "report_top_cases", "report_summary"])
def test_injuries_of_whole_texts(spark, duck, name):  # noqa: F811
    assert "left(text" not in Q.ORACLE_SQL[name] and "left(text" not in Q.INJURIES_SQL
    assert rows_of(Q.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(Q.ORACLE_SQL[name]).df())


def test_an_injury_after_the_first_characters_counts(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 60 + "thion", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Q.QUERIES["meta_score"](spark, str(tmp_path)).first()["overlap"] == 0.25


def found(text, patterns, cut=80, least=0):
    all_of = [m.group(1).strip(" ") for p in patterns for m in re.finditer(p, (text or "").lower(), re.ASCII)]
    return "|".join(list(dict.fromkeys(x[:cut] for x in all_of if len(x) >= least))[:10])


def test_terms_of_all_languages(spark, duck):  # noqa: F811
    got = Q.QUERIES["extract_terms_regex"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.sql(Q.ORACLE_SQL["extract_terms_regex"]).df())
    assert len(got) == duck.sql("select count(*) from documents").fetchall()[0][0]
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    for r in got.itertuples():
        t = texts[r.doc_id]
        assert (r.injuries, r.findings, r.sequelae) == (found(t, fixed.COMMENT_INJURIES, None, 4), found(t, fixed.REPORT_INJURIES), found(t, fixed.REPORT_SEQUELAE))


def test_terms_beside_other_letters(spark, tmp_path):
    text = "éidiot of the clown. He suffered a hip fracture and was diagnosed with a lumbar disc herniation, causes severe pain."
    spark.createDataFrame([(1, text, "fr", "web"), (2, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = Q.QUERIES["extract_terms_regex"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a["terms"], a["severity"]) == ("idiot of the|idiot|clown", "severe")
    assert (a["injuries"], a["findings"], a["sequelae"]) == (found(text, fixed.COMMENT_INJURIES, None, 4), found(text, fixed.REPORT_INJURIES), found(text, fixed.REPORT_SEQUELAE))
    assert "hip fracture" in a["injuries"] and a["findings"] and a["sequelae"]
    assert b[1:] == ("", "moderate", "", "", "")
