"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..working import new_path, shared_dir, stored  # noqa: F401

#: Characters between words, as the inside of a regular expression's class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(df: DataFrame, name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, so that what a task makes of long texts at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def join_small(left: DataFrame, small: DataFrame, keys: list[str], bound: int, salts: int = 32) -> DataFrame:
    """Left join with null-safe equality to a table that is unique in its keys.

    The small side is broadcast if it has at most ``bound`` rows. Beyond that both sides are
    shuffled; every row of the small side is repeated for each of ``salts`` salts, so that a
    key which holds a third of the left rows is spread over that many tasks.
    """
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    if small.limit(bound + 1).count() <= bound:
        return left.join(F.broadcast(right), on, "left").drop(*[f"__{k}" for k in keys])
    left = left.withColumn("__salt", (F.rand(7) * salts).cast("int"))
    right = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    joined = left.join(right, [*on, left["__salt"] == right["__salt_r"]], "left")
    return joined.drop("__salt", "__salt_r", *[f"__{k}" for k in keys])


def salted(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Inner join with a table that is unique in key; left rows of one key are spread over the salts by the column ``by``."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")
