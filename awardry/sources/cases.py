"""Reading and writing cases, categories, regions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import as_list
from ..operators.consolidate import consolidate, dashboard
from ..schemas import DASHBOARD_CASE, FLAT_CASE, PARSED_CASE
from ..working import shuffles_go, stored

SCHEMAS = {"parsed": PARSED_CASE, "dashboard": DASHBOARD_CASE, "flat": FLAT_CASE}


def with_order(files: DataFrame, column: str = "ord", file: str | None = None) -> DataFrame:
    """A table of files with its rows numbered from 0 in input order: by file, place in the file and row; with the file's path by option.

    Rows are stored with their number inside their part of a file; only the parts, a row each, are put in order.
    """
    names = files.columns
    rows = files.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    rows = stored(rows, "ordered")
    parts = rows.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__file", "__start", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.join(parts, ["__file", "__start"])
    if file:
        rows = rows.withColumn(file, F.col("__file"))
        names = [*names, file]
    return rows.select(*names, (F.col("__before") + F.col("__at") - F.col("__first")).alias(column))


def read_cases(spark: SparkSession, path: str, kind: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Cases of a JSON file (an array, or a record a line) with ord; judges, regions and categories may be scalars or lists.

    split reads an array by many tasks, for large files; without it, a task reads a whole array.
    """
    if split and not lines:
        from .json_array import read_json_array

        df = read_json_array(spark, path, SCHEMAS[kind])
    else:
        df = with_order(spark.read.schema(SCHEMAS[kind]).option("multiLine", not lines).json(path))
    if kind == "parsed":
        df = df.withColumns({c: as_list(F.col(c)) for c in ("judge", "region")})
    return df


def detect_format(df: DataFrame) -> str:
    """ai_parsed, dashboard or unknown, by the columns that a table has."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if df.isEmpty():
        return "unknown"
    if isinstance(types.get("plaintiffs"), ArrayType):
        return "ai_parsed"
    return "dashboard" if {"embedding", "summary_text"} <= types.keys() else "unknown"


def convert_cases(df: DataFrame, to: str | None = None, **options) -> DataFrame:
    """Parsed cases (with ord) as dashboard cases, also written as Parquet if a path is given; others as they are."""
    if detect_format(df) != "ai_parsed":
        return df
    out = dashboard(consolidate(df, **options))
    if to:
        out.write.mode("overwrite").parquet(to)
        out = df.sparkSession.read.parquet(to)
    return out


def read_region_terms(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, label, term) of a JSON object of regions."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<label: string, compendium_terms: array<string>>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("region_id", "r"))
    return rows.select("region_id", "r.label", F.explode_outer("r.compendium_terms").alias("term"))


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, label, subcategory) of a JSON object with injury_categories."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<injury_categories: map<string, struct<label: string, subcategories: array<string>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)["injury_categories"]).alias("category_id", "c"))
    return rows.select("category_id", "c.label", F.explode_outer("c.subcategories").alias("subcategory"))


def valid_categories(tree: DataFrame) -> DataFrame:
    """The different subcategories, trimmed, in upper case. An empty table stands for "all"."""
    return tree.where("subcategory is not null").select(F.upper(F.trim("subcategory")).alias("category")).distinct()


def write_vectors(df: DataFrame, path: str, id_column: str = "case_id", vector: str = "vec") -> None:
    """(case_id, vec, vec_norm) as Parquet: vectors are found by key and not by position."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    df.select(F.col(id_column).alias("case_id"), F.col(vector).alias("vec"), F.sqrt(square).alias("vec_norm")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, cases: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """(case_id, vec, vec_norm) as written; with cases, these with vec and vec_norm of their id, null where there is none."""
    vectors = spark.read.schema("case_id long, vec array<float>, vec_norm double").parquet(path)
    return vectors if cases is None else cases.join(vectors.withColumnRenamed("case_id", id_column), id_column, "left")


#: Cases of a compressed JSON file at most: such a file is read by one task.
FILE_CASES = 200_000


def write_cases(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Cases as files; JSON is compressed, as its text repeats the fields' names with each case."""
    options = {"compression": "gzip", "maxRecordsPerFile": FILE_CASES} if form == "json" else {}
    with shuffles_go(df.sparkSession):
        df.write.mode(mode).format(form).options(**options).save(path)
