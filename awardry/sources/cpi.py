"""The consumer price index as a dimension (year, cpi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import CPI


def built_in_cpi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fixed.CPI_FROM + i, v) for i, v in enumerate(fixed.CPI)], CPI)


def annual_cpi(months: DataFrame) -> DataFrame:
    """Annual means of (month YYYY-MM, value), where a value may end with the mark R of a revision."""
    good = months.where(F.col("month").rlike(r"^\d{4}-\d{2}$"))
    value = F.rtrim(F.trim(F.col("value").cast("string")), F.lit("R")).try_cast("double")
    good = good.select(F.substring("month", 1, 4).cast("int").alias("year"), value.alias("v")).where("v is not null")
    return good.groupBy("year").agg(F.avg("v").alias("cpi"))


def read_cpi(spark: SparkSession, path: str | None = None, least_years: int = 10) -> DataFrame:
    """The index of a monthly CSV file with a header, if it has more than least_years years; else the built-in one."""
    if path:
        cpi = annual_cpi(spark.read.schema("month string, value string").csv(path, header=True))
        if cpi.count() > least_years:
            return cpi
    return built_in_cpi(spark)


def reload_cpi(spark: SparkSession, old: DataFrame, path: str, least_years: int = 10) -> DataFrame:
    """The index of a new file in place of a cached one, by the rule of read_cpi."""
    old.unpersist()
    spark.catalog.refreshByPath(path)
    return read_cpi(spark, path, least_years)


def write_cpi(cpi: DataFrame, path: str) -> None:
    """Year,CPI by year with two decimals, as one CSV file (a year is a row)."""
    out = cpi.select(F.col("year").alias("Year"), F.round("cpi", 2).alias("CPI")).orderBy("Year")
    out.coalesce(1).write.mode("overwrite").csv(path, header=True)


def available_years(cpi: DataFrame) -> DataFrame:
    """The years that have an index, in order."""
    return cpi.select("year").distinct().orderBy("year")


def cpi_info(cpi: DataFrame, name: str = "Fallback data") -> DataFrame:
    """earliest, latest and number of years, and a line that names the source."""
    out = cpi.agg(F.min("year").alias("earliest"), F.max("year").alias("latest"), F.count("*").alias("years"))
    return out.withColumn("source", F.format_string(f"{name} (%d years: %d-%d)", "years", "earliest", "latest"))
