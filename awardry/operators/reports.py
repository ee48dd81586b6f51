"""Findings of expert reports, and the data of a damages report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.patterns import all_matches
from ..functions.text import as_findings, as_injuries, given, report_severity, shortened
from .anatomy import region_labels, text_regions
from .statistics import summary


def analysed(reports: DataFrame, text: str = "text", key: str = "doc_id", dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, rejects): injuries, comment_injuries, sequelae, severity and, with a dictionary, injured_regions of each report.

    Reports without text are rejected. A text is sent to Python once for all expressions.
    """
    blank = given(F.trim(F.coalesce(text, F.lit("")))).isNull()
    found = all_matches(F.lower(text), injuries=fixed.REPORT_INJURIES, sequelae=fixed.REPORT_SEQUELAE, comments=fixed.COMMENT_INJURIES)
    out = reports.where(~blank).withColumn("__found", found).withColumns(
        {"injuries": as_findings(F.col("__found.injuries")), "sequelae": as_findings(F.col("__found.sequelae")), "comment_injuries": as_injuries(F.col("__found.comments")), "severity": report_severity(F.col(text)), "extraction_method": F.lit("regex")}
    ).drop("__found")
    if dictionary is not None:
        found = text_regions(out, dictionary, text, key).groupBy(key).agg(F.array_sort(F.collect_set("region")).alias("injured_regions"))
        out = out.join(found, key, "left")
    return out, reports.where(blank).withColumn("error", F.lit("no text"))


def report_search_text(injuries: Column, sequelae: Column) -> Column:
    return F.concat_ws(" | ", given(F.array_join(injuries, "; ")), given(F.array_join(sequelae, "; ")))


def report_parameters(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, place, name, value): the search parameters of a report, in their order.

    queries: query_id, gender, age, regions, text. Gender and age appear where they are given; each region by its
    label (region_id, label), else by its id; the description always.
    """
    told = F.col("gender").isNotNull() & ~F.col("gender").isin("", "Not Specified")
    row = lambda place, name, value: F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    one = F.array_compact(F.array(F.when(told, row(0, "Gender", F.col("gender"))), F.when(F.col("age") != 0, row(1, "Age", F.col("age"))), row(10_000, "Injury Description", F.col("text"))))
    rows = queries.select("query_id", F.explode(one).alias("r")).select("query_id", "r.*")
    own = queries.select("query_id", F.posexplode("regions").alias("place", "region"))
    own = region_labels(own, labels).select("query_id", (F.col("place") + 2).alias("place"), F.lit("Injured Region").alias("name"), F.col("label").alias("value"))
    return rows.unionByName(own)


def damages_report(results: DataFrame, amount: str = "damages", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(summary of the amounts, the top cases with number, match in per cent and shortened summary)."""
    cases = results.where(F.col("rank") <= most).select(
        F.col("rank").alias("number"), "case_name", "year", "court", amount, F.round(F.col("combined") * 100, 1).alias("match_percent"),
        shortened(F.col("summary_text")).alias("summary_text"),
    )
    return summary(results.where(F.col(amount) > 0), amount), cases
