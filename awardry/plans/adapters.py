"""Test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import CLAIM
from ..sources.cpi import built_in_cpi
from ..working import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cpi(spark: SparkSession) -> DataFrame:
    return built_in_cpi(spark)


CPI_SQL = "cpi(year, cpi) as (values " + ", ".join(f"({fixed.CPI_FROM + i}, {v}::double)" for i, v in enumerate(fixed.CPI)) + ")"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: the customer's name, the year, the status as court, the priority as category, the total as award."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("c_name").alias("case_name"), F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("court"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("balance"),
    )


CASES_SQL = """cases as (select o_orderkey as id, o_orderkey as ord, c_name as case_name, year(o_orderdate)::int as year, o_orderstatus as court,
  o_orderpriority as category, o_totalprice as amount, c_acctbal as balance from orders join customer on o_custkey = c_custkey)"""


def adjusted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.inflation import adjust

    return adjust(cases(spark, sf_dir), cpi(spark))


ADJUSTED_SQL = f"""{CPI_SQL}, {CASES_SQL}, adj as (select cases.*, round((amount * t.cpi / f.cpi)::varchar::decimal(38, 12), 2)::double as adjusted
  from cases left join cpi f on f.year = cases.year left join cpi t on t.year = {fixed.REFERENCE_YEAR})"""


def by_order(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """lines dealt by order to tasks of bounded numbers of lines; what follows by order needs no shuffle."""
    return lines.repartition(line_tasks(spark, sf_dir), "l_orderkey")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())  # the files' footers tell


def judged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adjusted_cases with judges: the different suppliers of an order."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    names = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_name")
    judges = by_order(spark, sf_dir, names).groupBy("l_orderkey").agg(F.collect_set("s_name").alias("judges"))
    return adjusted_cases(spark, sf_dir).join(judges, F.col("id") == F.col("l_orderkey")).drop("l_orderkey")


#: jc: of each judge the first case of a name and year.
JUDGED_SQL = f"""{ADJUSTED_SQL}, jc as (select * from (select adj.*, s.judge, row_number() over (partition by s.judge, case_name, year order by ord) as k
  from adj join (select distinct l_orderkey, s_name as judge from lineitem join supplier on l_suppkey = s_suppkey) s on s.l_orderkey = adj.id) where k = 1)"""


def claimed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adjusted_cases with claims: the lines of an order, the return flag as relationship, finished lines being awards."""
    li = by_order(spark, sf_dir, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_linestatus"))
    claim = F.struct(
        "l_linenumber",
        F.struct(
            F.col("l_returnflag").alias("relationship"), F.round("l_extendedprice", 2).alias("amount"), F.lit("").alias("description"),
            (F.col("l_linestatus") == "F").alias("is_fla_award"), F.lit(None).cast("string").alias("category"),
        ).cast(CLAIM).alias("c"),
    )
    claims = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(claim)), lambda x: x["c"]).alias("claims"))
    base = adjusted_cases(spark, sf_dir).drop("amount")
    return base.join(claims, F.col("id") == F.col("l_orderkey")).drop("l_orderkey")


#: aw: the awards; fc: the first claim of each case and relationship.
CLAIMS_SQL = f"""{CASES_SQL}, aw as (select cases.id, case_name, year, l_returnflag as relationship, round(l_extendedprice, 2) as amount
  from lineitem join cases on l_orderkey = cases.id where l_linestatus = 'F' and round(l_extendedprice, 2) > 0)"""


def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed records: name of the customer, year, status; the parts' types of their lines as injuries."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    types = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("injuries"))
    c = cases(spark, sf_dir).join(types, F.col("id") == F.col("l_orderkey"), "left")
    null = lambda t: F.lit(None).cast(t)
    from ..schemas import AMOUNT, PLAINTIFF

    return c.select(
        "ord", "case_name", F.lit("x").alias("plaintiff_name"), null("string").alias("defendant_name"), "year", null("string").alias("citation"), "court",
        null("string").alias("judge"), null("string").alias("sex"), null("int").alias("age"), F.round("amount", 2).alias("non_pecuniary_damages"),
        F.lit(False).alias("is_provisional"), "injuries",
        F.array(F.struct(F.lit("other").alias("type"), F.lit(1.0).alias("amount"), F.lit("").alias("description"))).cast(f"array<struct<{AMOUNT}>>").alias("other_damages"),
        F.array().cast(f"array<{CLAIM}>").alias("family_law_act_claims"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("comments"),
        null(f"array<{PLAINTIFF}>").alias("plaintiffs"), F.lit(False).alias("is_continuation"), null("int").alias("source_page"),
        "category", F.concat(F.lit('["'), F.col("court"), F.lit('"]')).alias("region"),
    )


def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector, as cases for search: the source and language as name, the language as region, the different words as injuries."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    rows = d.join(e, F.col("doc_id") == F.col("vec_id"))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.char_length(w) > 1)
    return rows.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.concat_ws(" ", "source", "lang").alias("case_name"), F.array_distinct(words).alias("injuries"),
        F.col("text").alias("comments"), F.lit(None).cast("string").alias("summary_text"), F.when(F.col("doc_id") % 3 == 0, "F").when(F.col("doc_id") % 3 == 1, "M").alias("sex"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 80).cast("int")).alias("age"), F.array("lang").alias("regions"), "vec",
        (F.col("doc_id") % 7 + 2010).cast("int").alias("year"), F.col("source").alias("court"), (F.col("doc_id") * 100.0).alias("damages"),
    )
