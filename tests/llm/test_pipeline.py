"""The pipeline against plain Python, stage after stage."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from awardry.llm import pieces, quality

from .helpers import DOC, oracle, prose
from .test_near_dup import brute
from .test_secrets import brute as secret_spans
from .test_text_operators import brute_contained


def tables(spark, folder):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, 20))) for i in range(5)]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randrange(55, 150))
        if i % 10 == 3:
            words[10:10] = items[i % 5][1].split()
        if i % 10 == 4:
            words[5:5] = ["token", "=", "abcdef0123456789" * 2]
        rows.append((i, " ".join(words), ["en", "fr", None][i % 3], "s", 0))
    for i in range(60, 80):  # near copies
        words = rows[i - 60][1].split()
        words[-1] = "changed"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(80, rows[0][1], "en", "s", 0), (81, "short", "en", None, 5), (82, None, "en", "s", None), (83, " ".join(w + "%%%" for w in prose(rng, 80)), "en", "s", 0), (84, "a b c " * 60, "fr", "s", 0)]
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{folder}/d")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/b")
    import glob
    import os

    for short, name in (("d", "documents"), ("b", "benchmark")):
        os.rename(glob.glob(f"{folder}/{short}/part*")[0], f"{folder}/{name}.parquet")
    return rows, items


def redact(text):
    out, at = "", 0
    for start, _, _, end in secret_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, tmp_path):
    import sentencepiece

    rows, items = tables(spark, tmp_path)
    texts = {r[0]: r[1] for r in rows}
    kept = oracle(tmp_path, quality.quality_sql(tail="select doc_id from judged where kept"))["doc_id"].tolist()
    assert not {81, 82, 83, 84} & set(kept) and len(kept) > 70
    component = brute([(i, texts[i]) for i in kept], 5, 80)
    kept = [i for i in kept if component[i][1] == i]
    assert 80 not in kept and 60 not in kept
    leaks = {d for d, *_ in brute_contained([(i, texts[i]) for i in kept], items)}
    kept = [i for i in kept if i not in leaks]
    want = {i: redact(texts[i]) for i in kept}
    assert any("[SECRET]" in t for t in want.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())

    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "pieces"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text for r in docs.collect()} == want
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.piece_ids for i, r in got.items()} == {i: sp.encode(t) for i, t in want.items()}
    assert all(r.same and r.n_pieces == len(r.piece_ids) for r in got.values())


def test_empty_and_odd_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(None, "x y z " * 30, None, None, None), (1, None, None, None, None), (1, "é" * 100_000, "en", "s", 1), (1, "é" * 100_000, "en", "s", 1)], DOC)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert stage(spark, odd, str(tmp_path)).count() <= 4
    kept = corpus_pipeline.near_dedup(spark, odd, str(tmp_path)).select("doc_id").collect()
    assert None in [r[0] for r in kept]


def test_extra_and_missing_columns(spark, tmp_path):
    """Columns with the names of results and inner columns are dropped; missing ones are null."""
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 12")
    names = ["kept", "base_failed", "n_words", "secrets", "text_hash", "piece_ids", "decoded", "component", "id", "__kinds"]
    more = docs.withColumns({c: F.lit("clash") for c in names})
    less = docs.select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect())
        for table in (more, less):
            got = stage(spark, table, str(tmp_path))
            assert got.columns == corpus_pipeline.COLUMNS, name
            assert table is less or sorted(r.doc_id for r in got.collect()) == want, name
    assert corpus_pipeline.pieces(spark, more, str(tmp_path)).columns == corpus_pipeline.pieces(spark, less, str(tmp_path)).columns
    assert corpus_pipeline.quality(spark, less, str(tmp_path)).count() > 0
