import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) with other columns made up, one of them with a name that results use."""
    full = [(i, t, "en" if i is None or i % 2 else None, "s", len(t or ""), "x") for i, t in rows]
    return spark.createDataFrame(full, DOC + ", kept string")


def prose(rng: random.Random, n: int, words: int = 4000) -> list[str]:
    return ["w" + str(rng.randrange(words)) for _ in range(n)]


def oracle(sf_dir, sql):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c.sql(sql).df()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    whole = [c for c in frame if frame[c].dtype == float and (frame[c].dropna() % 1 == 0).all()]  # whole numbers with nulls
    frame = frame.astype({c: "Int64" for c in whole}).astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))
