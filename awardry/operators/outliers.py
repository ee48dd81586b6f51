"""Outliers by interquartile range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..working import stored
from .statistics import with_quantiles


def without_outliers(df: DataFrame, value: str, by: list[str] | None = None, threshold: float = 1.5, broadcast_groups: int = 100_000) -> DataFrame:
    """df without rows whose positive value lies beyond threshold interquartile ranges of its group's quartiles.

    Groups of fewer than four positive values stay whole, as do rows without a positive value. The quartiles
    are exact; statistics.quantiles finds them without a group's values in one task.
    """
    by = by or []
    good = stored(df.where(F.col(value) > 0).select(*by, value), "positive")
    bounds = good.groupBy(*by).agg(F.count("*").alias("__n")).where("__n >= 4")
    bounds = with_quantiles(bounds, good, by, value, {"__q1": 0.25, "__q3": 0.75})
    gap = (F.col("__q3") - F.col("__q1")) * threshold
    bounds = bounds.select(*[F.col(b).alias(f"__{b}") for b in by], (F.col("__q1") - gap).alias("__lo"), (F.col("__q3") + gap).alias("__hi"))
    if not by:
        joined = df.join(F.broadcast(bounds), F.lit(True), "left")  # one row at most
    else:
        small = bounds.limit(broadcast_groups + 1).count() <= broadcast_groups
        on = [df[b].eqNullSafe(bounds[f"__{b}"]) for b in by]
        joined = df.join(F.broadcast(bounds) if small else bounds, on, "left")
    v = F.col(value)
    keep = F.coalesce(v <= 0, F.lit(True)) | F.col("__lo").isNull() | v.between(F.col("__lo"), F.col("__hi"))
    return joined.where(keep).drop("__lo", "__hi", *[f"__{b}" for b in by])
