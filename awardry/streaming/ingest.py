"""Incremental ingest: new files of parsed rows into a store of consolidated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import given
from ..operators.consolidate import consolidate
from ..schemas import PARSED_CASE
from ..working import stored
from .keyed import latest, put

KEYS = ["case_name", "year", "court"]
RECORD = PARSED_CASE + ", ord long"


def ingest_stream(spark: SparkSession, incoming: str, records: str, store: str, checkpoint: str, **options) -> StreamingQuery:
    """Run over all new JSON-lines files of incoming, then stop; a restart goes on where the checkpoint ends.

    The records of each case are the state of an aggregate in update mode, each with its batch's time. A batch gets, for the cases that
    it touches and no others, their earlier records from the state; these cases are consolidated anew and put into the
    store as the batch's changes, so that what is read and written grows with the batch and not with the store. New
    records, those of the latest time, are appended below records. A batch that is run again has the same time and replaces what it
    wrote. For many cases, set RocksDB as the session's state store.
    """
    rows = spark.readStream.schema(RECORD).json(incoming)
    names = rows.columns
    name = F.coalesce(given(F.col("case_name")), F.lit("Unknown"))  # as cases are told apart
    rows = rows.select(name.alias("__key"), *KEYS[1:], F.current_timestamp().alias("at"), F.struct(*names).alias("r"))
    touched = rows.groupBy("__key", *KEYS[1:]).agg(F.collect_list(F.struct("at", "r")).alias("all"))

    def batch(df: DataFrame, number: int) -> None:
        last = F.aggregate("all", F.lit(None).cast("timestamp"), lambda t, x: F.greatest(t, x["at"]))
        each = df.withColumn("last", last).select("last", F.explode("all").alias("x"))
        found = stored(each.select((F.col("x.at") == F.col("last")).alias("fresh"), "x.r"), "touched")
        put(found.where("fresh").select("r.*"), records, number)
        put(consolidate(found.select("r.*"), **options), store, number)

    return touched.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, store: str, values: list[Column] | None = None) -> DataFrame:
    """The consolidated cases of all batches so far; with values, these beside name, year and court."""
    return latest(spark, store, KEYS, values)
