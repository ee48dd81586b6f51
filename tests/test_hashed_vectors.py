"""Hashed vectors of long texts hold the counts of their words exactly."""

import duckdb

from awardry.plans.catalogue import ORACLE_SQL, QUERIES


def test_hashed_vectors_of_long_texts(spark, tmp_path):
    """Values of some millions of thousandths, and words held together by other than plain spaces."""
    texts = [(i, "a " * n + "b\n" * least + "c d\x0be") for i, (n, least) in enumerate([(2600 + 97 * i, 1 + i % 13) for i in range(150)])]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i, _ in texts], "vec_id long").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {i: (n, v) for i, n, v in c.sql(ORACLE_SQL["hashed_vectors"]).fetchall()}
    assert {r.id: (r.norm, r.vector) for r in QUERIES["hashed_vectors"](spark, str(tmp_path)).collect()} == want
