"""Running statistics of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a sketch for a doubling of the value: a bucket's middle is within 1 / ERROR of each of its values.
STEPS, ERROR = 32, 90


def running_statistics(stream: DataFrame, by: str, amount: str) -> DataFrame:
    """n, mean, min, max and population deviation by group, for update or complete mode. Medians come from running_sketches."""
    return stream.groupBy(by).agg(
        F.count(amount).alias("n"), F.avg(amount).alias("mean"), F.min(amount).alias("min"), F.max(amount).alias("max"), F.stddev_pop(amount).alias("std")
    )


def bucket(amount: Column) -> Column:
    """The sketch's bucket of a value: by the scale of its logarithm, apart for negative values, and 0 for zero."""
    size = F.floor(F.log2(F.abs(amount)) * STEPS).cast("long") + (1 << 20)
    return F.when(amount > 0, size).when(amount < 0, -size).when(amount == 0, 0)


def running_sketches(stream: DataFrame, by: str, amount: str) -> DataFrame:
    """The moments of each group's buckets, for update mode: state and changes grow with the buckets that a batch touches.

    Buckets merge by their moments, so a group's statistics follow from them in any order (statistics_of).
    """
    rows = stream.select(by, F.col(amount).cast("double").alias("__v")).where("__v is not null")
    return rows.groupBy(by, bucket(F.col("__v")).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("__v").alias("mean"), F.var_pop("__v").alias("variance"), F.min("__v").alias("min"), F.max("__v").alias("max")
    )


def statistics_of(sketches: DataFrame, by: str) -> DataFrame:
    """n, mean, min, max, std and median of each group from its sketch (the last version of each bucket).

    All are exact but the median, the middle of the bucket that holds it, which is within 1 / ERROR of the lower middle value.
    """
    group = Window.partitionBy(by)  # a row for each bucket: some thousands at most
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = sketches.withColumns({"__upto": upto, "__n": F.sum("n").over(group), "__mean": F.sum(F.col("mean") * F.col("n")).over(group) / F.sum("n").over(group)})
    holds = F.col("__upto") * 2 >= F.col("__n")
    return rows.groupBy(by).agg(
        F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sqrt(F.sum(F.col("n") * (F.col("variance") + (F.col("mean") - F.col("__mean")) ** 2)) / F.sum("n")).alias("std"),
        F.min_by((F.col("min") + F.col("max")) / 2, F.when(holds, F.col("bucket"))).alias("median"),
    )
