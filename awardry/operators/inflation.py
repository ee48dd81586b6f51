"""Amounts in the money of another year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

#: The index has a row for each year; more rows than this aren't broadcast.
BROADCAST_ROWS = 10_000


def _small(cpi: DataFrame) -> DataFrame:
    return F.broadcast(cpi) if cpi.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cpi


def with_cpi(df: DataFrame, cpi: DataFrame, year: str = "year", target: int | Column = fixed.REFERENCE_YEAR) -> DataFrame:
    """df with cpi_from and cpi_to, null where a year has no index."""
    one = _small(cpi)
    from_ = one.select(F.col("year").alias("__y1"), F.col("cpi").alias("cpi_from"))
    to = one.select(F.col("year").alias("__y2"), F.col("cpi").alias("cpi_to"))
    target = F.lit(target) if isinstance(target, int) else target
    df = df.withColumn("__target", target)
    df = df.join(from_, F.col(year) == F.col("__y1"), "left").join(to, F.col("__target") == F.col("__y2"), "left")
    return df.drop("__y1", "__y2", "__target")


def adjust(df: DataFrame, cpi: DataFrame, amount: str = "amount", year: str = "year", target: int | Column = fixed.REFERENCE_YEAR, out: str = "adjusted") -> DataFrame:
    """df with out: the amount in the target year's money, two decimals; null where an index is missing."""
    df = with_cpi(df, cpi, year, target)
    return df.withColumn(out, F.round(F.col(amount) * F.col("cpi_to") / F.col("cpi_from"), 2)).drop("cpi_from", "cpi_to")


def rate(df: DataFrame, cpi: DataFrame, start: str = "start_year", end: str = "end_year", out: str = "rate") -> DataFrame:
    """df with out: the inflation between two years in per cent, two decimals."""
    df = with_cpi(df, cpi, start, F.col(end))
    return df.withColumn(out, F.round((F.col("cpi_to") - F.col("cpi_from")) / F.col("cpi_from") * 100, 2)).drop("cpi_from", "cpi_to")


def in_money(adjusted: Column, amount: Column) -> Column:
    """The adjusted amount where there is one, else the original."""
    return F.coalesce(F.nullif(adjusted, F.lit(0.0)), amount)


def change(adjusted: Column, amount: Column) -> tuple[Column, Column]:
    """Difference, and difference in per cent of the original."""
    return adjusted - amount, (adjusted - amount) / F.nullif(amount, F.lit(0.0)) * 100


def info(amount: Column, year: Column, adjusted: Column, target: int, inflation: Column) -> Column:
    """$a (y) -> $b (y2) [+r% inflation], or $a (y) where nothing is adjusted."""
    money = lambda c, y: F.concat(F.lit("$"), F.format_number(c, 0), F.lit(" ("), y.cast("string"), F.lit(")"))
    sign = F.when(inflation >= 0, "+").otherwise("")
    tail = F.concat(F.lit(" ["), sign, F.format_number(inflation, 1), F.lit("% inflation]"))
    full = F.concat(money(amount, year), F.lit(" → "), money(adjusted, F.lit(target)), F.coalesce(tail, F.lit("")))
    return F.when(adjusted.isNull() | (year == target), money(amount, year)).otherwise(full)
