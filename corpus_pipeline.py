"""A corpus pipeline of the training-data operators: each stage reads what the one before wrote.

For all stages: a null doc_id, text, lang, source or n_chars is allowed, as are empty and very long texts,
repeated rows and an empty table, which gives an empty one. A column of documents that is missing is null.
Other columns are dropped, so that none can clash; the last stage says which it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardry.llm.common import stored
from awardry.llm.decontaminate import contained_items
from awardry.llm.near_dup import near_duplicates
from awardry.llm.pieces import round_trip
from awardry.llm.quality import quality_rules
from awardry.llm.secrets import redacted, scan_secrets

#: The columns of documents, which all stages but the last return.
SCHEMA = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = list(SCHEMA)
#: Ids to broadcast at most.
BROADCAST_ROWS = 200_000
#: Documents that go to a Python worker at once: ten thousand, the usual, are tens of MB in it and as many in the executor.
BATCH_ROWS = 1000


def documents(docs: DataFrame) -> DataFrame:
    """docs with the columns of documents alone, null where one is missing."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in SCHEMA.items()])


def small_batches(spark: SparkSession) -> None:
    """Spark reads this setting when a table is run, so it stays set; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose values in the columns of ids aren't among the ids; a null id stays."""
    ids = stored(ids.distinct(), "pipeline_ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ids.columns, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts among them. Repeated rows are judged alike."""
    return quality_rules(documents(docs)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of five-word shingles the document with the least id stays.

    Rows of one id are judged each by its own text: a copy goes, another text of its id stays. Rows that share
    the least id of their group all stay, repeated rows among them. Rows without id or without words stay.
    """
    small_batches(spark)
    docs = documents(docs)
    found = near_duplicates(docs, words=5, percent=80).where("id <> component")
    gone = found.select(F.col("id").alias("doc_id"), "text_hash")
    return without(docs.withColumn("text_hash", F.xxhash64("text")), gone).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold 80 % or more of a benchmark item's five-word shingles, with all rows of their id; rows without id stay.

    Texts are searched whole. An item without words is in no document; one of fewer words is found wherever they stand in a row.
    """
    small_batches(spark)
    docs = documents(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, contained_items(docs, items, words=5, percent=80).select("doc_id")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, overlapping ones by one; all rows stay. n_chars follows where a text changes; a null text stays null."""
    found = scan_secrets(documents(docs))
    changed = F.size("secrets") > 0
    text = redacted(F.col("text"), F.col("secrets"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, piece_ids, n_pieces, and same: whether the ids decode to the text. All rows stay; a null text counts as empty."""
    small_batches(spark)
    return round_trip(documents(docs), decoded=False).select("doc_id", "lang", "source", "n_chars", "piece_ids", "n_pieces", "same")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]
#: SQL can't express the last stage; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
