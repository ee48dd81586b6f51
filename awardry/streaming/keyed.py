"""Keyed results of streams: each batch adds what it changed; readers see the last change of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..working import shuffles_go


def put(changed: DataFrame, path: str, number: int) -> None:
    """The rows that a batch changed, as the batch's part of a result; run again, it replaces itself."""
    with shuffles_go(changed.sparkSession):
        changed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, keys: list[str], values: list[Column] | None = None) -> DataFrame:
    """Of each key the row of the last batch that changed it; keys may be null.

    values are what is wanted beside the keys, made of each row before rows are sent; without them the whole rows are.
    """
    rows = spark.read.parquet(path)
    if values is not None:
        rows = rows.select(*keys, *values, "batch")
    columns = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "batch").alias("__r"))
    return last.select(*keys, "__r.*").select(*columns)


def compacted(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """A result with the last row of each key alone, written to a new folder as its first batch: for a stream that then goes on there."""
    put(latest(spark, path, keys), to, 0)


def upserted(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregated stream in update mode over all that is there: each batch puts its changed groups alone."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda df, number: put(df, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
