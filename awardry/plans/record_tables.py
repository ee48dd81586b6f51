"""Table cells, parsed rows and cases with plaintiffs, made from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CLAIM, PLAINTIFF
from .adapters import by_order, cases, table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
LINES_SQL = f"lines as (select *, row_number() over (partition by l_orderkey order by {', '.join(_ORDER)}) as k from lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders with k, their number in the order (a few each), dealt by order to tasks of bounded numbers of lines."""
    return by_order(spark, sf_dir, table(spark, sf_dir, "lineitem")).withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


#: The first two rows of an order's table, by the order's key modulo their number: stacked headers, sections, headers in the second row, none.
HEADS = [
    (["Plaintiff", "Year", "Amount"], None),
    (["Plaintiff\nYear\nAmount", "", ""], None),
    (["HEAD - $1,000", "", ""], ["Case", "", "Year"]),
    (["KNEE", "", ""], ["Plaintiff\nSex\nAge\nNon-Pecuniary\nGeneral\nDamages", "", ""]),
    (["Foo", "Bar", ""], None),
    (["Plaintiff\nCase", "", ""], None),
    (["Injuries to the SHOULDER", "nan", ""], ["x", "", ""]),
]
#: What these rows say: the columns' names where one is known, and the section that the page names.
HEADERS = [["Plaintiff", "Year", "Amount"], ["Plaintiff", "Year", "Amount"], ["Case", "Col_1", "Year"], ["Plaintiff", "Sex/Age", "Non-Pecuniary Damages"], None, ["Plaintiff", "Case", "Col_2"], None]
SECTIONS = [None, None, "HEAD", "KNEE", "ANKLE", None, "Injuries to the SHOULDER"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, on a page of its customer's document: two or one rows of heads, then a row for each line."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % len(HEADS)).cast("int").alias("kind"))
    head = [(i, r, c, x) for i, rows in enumerate(HEADS) for r, row in enumerate(rows) if row for c, x in enumerate(row)]
    heads = o.join(F.broadcast(spark.createDataFrame(head, "kind int, row_no int, col_no int, text string")), "kind")
    first = F.element_at(F.array(*[F.lit(2 if rows[1] else 1) for rows in HEADS]), F.col("kind") + 1)
    rows = lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("page")).withColumn("row_no", (F.col("k") - 1 + first).cast("int"))
    texts = F.array(
        F.concat(F.lit(" P"), F.col("k").cast("string")), F.when(F.col("kind") == 4, "left ANKLE").otherwise(F.year("l_shipdate").cast("string")),
        F.when(F.col("l_linenumber") % 3 == 0, "nan").when(F.col("l_linenumber") % 3 == 1, F.round("l_quantity").cast("int").cast("string")).otherwise(""),
    )
    rows = rows.select("kind", "doc_id", "page", "row_no", F.posexplode(texts).alias("col_no", "text"))
    return heads.unionByName(rows).withColumn("table_no", F.lit(0)).drop("kind")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed row for each line as JSON; those of returnflag N go on with the record before, and some can't be read."""
    li = lines(spark, sf_dir)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    continues = F.col("l_returnflag") == "N"
    person = F.struct(
        text("P", F.col("l_suppkey") % 3).alias("plaintiff_id"), text("N", F.col("l_suppkey") % 3).alias("plaintiff_name"), F.lit("F").alias("sex"), F.col("k").alias("age"),
        F.col("l_extendedprice").alias("non_pecuniary_damages"), F.array(text("pi", F.col("l_partkey") % 2)).alias("injuries"), text("pc", F.col("k")).alias("comments"),
    )
    blank = F.struct(*[(F.lit("") if f == "plaintiff_name" else F.lit(None)).alias(f) for f in ("plaintiff_id", "plaintiff_name", "sex", "age", "non_pecuniary_damages", "injuries", "comments")])
    fields = {
        "case_name": F.when(~continues, F.when(F.col("l_suppkey") % 7 == 6, "").otherwise(text("Case ", F.col("l_suppkey") % 7))), "year": F.year("l_shipdate"),
        "comments": F.when(F.col("l_linenumber") != 2, text("c", F.col("k"))), "non_pecuniary_damages": F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")),
        "injuries": F.array(text("inj", F.col("l_partkey") % 5), text("inj", F.col("l_suppkey") % 3)), "is_continuation": continues,
        "other_damages": F.when(F.col("l_discount") > 0.05, F.array(F.struct(F.lit("future_loss").alias("type"), F.col("l_quantity").alias("amount"), text("d", F.col("k")).alias("description")))),
        "family_law_act_claims": F.array(F.struct(F.col("l_linestatus").alias("relationship"), F.col("l_quantity").alias("amount"), (F.col("l_quantity") > 10).alias("is_fla_award"))),
    }
    many = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], F.array(F.lit("A. Smith, J."), F.lit("The Hon. B. JONES J.A.")).alias("judge"), F.array(person).alias("plaintiffs")))
    two = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], F.lit("Lee C.J.").alias("judge"), F.array(person, blank).alias("plaintiffs")))
    payload = F.when(F.col("l_orderkey") % 50 == 3, "{not").when(F.col("l_partkey") % 2 == 0, many).otherwise(two)
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("k").alias("page"), F.lit(0).alias("table_no"), F.lit(1).alias("row_no"), payload.alias("payload"))


#: pr: the rows that can be read, with the number of their record.
RECORDS_SQL = f"""{LINES_SQL}, pr as (select *, l_orderkey as doc, sum(case when l_returnflag = 'N' then 0 else 1 end) over (partition by l_orderkey order by k rows unbounded preceding)::bigint as record
  from lines where l_orderkey % 50 <> 3)"""


def sued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed records with the plaintiffs and claims of their lines: some have an id that another of the case has too, some none."""
    li = lines(spark, sf_dir)
    id_ = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")))
    person = F.struct(
        id_.alias("plaintiff_id"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("plaintiff_name"), F.when(F.col("l_linenumber") % 2 == 0, "F").alias("sex"), (F.col("k") + 20).alias("age"),
        F.col("l_quantity").alias("non_pecuniary_damages"), F.array(F.concat(F.lit("i"), (F.col("l_partkey") % 6).cast("string"))).alias("injuries"), F.concat(F.lit("pc"), F.col("k").cast("string")).alias("comments"),
    ).cast(PLAINTIFF)
    claim = F.struct(F.col("l_returnflag").alias("relationship"), F.col("l_quantity").alias("amount"), F.lit("").alias("description"), (F.col("l_linestatus") == "F").alias("is_fla_award"), F.lit(None).cast("string").alias("category")).cast(CLAIM)
    people = F.transform(F.array_sort(F.collect_list(F.struct("k", person.alias("p"), claim.alias("c")))), lambda x: x)
    rows = li.groupBy("l_orderkey").agg(people.alias("a"))
    rows = rows.select("l_orderkey", F.transform("a", lambda x: x["p"]).alias("plaintiffs"), F.transform("a", lambda x: x["c"]).alias("family_law_act_claims"))
    c = cases(spark, sf_dir).join(rows, F.col("id") == F.col("l_orderkey"), "left")
    even = F.col("ord") % 2 == 0
    return c.select(
        "ord", "case_name", F.lit("own").alias("plaintiff_name"), F.lit(None).cast("string").alias("defendant_name"), "year",
        F.when(even, F.concat(F.lit('["A'), F.col("ord").cast("string"), F.lit('","B"]'))).alias("citation"), F.array(F.lit("C"), F.lit("D")).alias("citations"), "court",
        F.when(even, "Lee").alias("judge"), F.array(F.lit("Roe"), F.lit("Poe")).alias("judges"), F.lit("M").alias("sex"), F.lit(40).alias("age"), F.round("amount", 2).alias("non_pecuniary_damages"),
        F.lit(False).alias("is_provisional"), F.array(F.concat(F.lit("i"), (F.col("ord") % 6).cast("string"))).alias("injuries"),
        F.array(F.struct(F.lit("future_loss").alias("type"), (F.col("ord") % 9).cast("double").alias("amount"), F.lit("d").alias("description"))).alias("other_damages"), "family_law_act_claims",
        F.when(F.col("ord") % 3 != 0, F.concat(F.lit("c"), F.col("ord").cast("string"))).alias("comments"), "plaintiffs", F.lit(False).alias("is_continuation"),
        F.array((F.col("ord") % 90).cast("int"), F.lit(7)).alias("source_page"), "category", F.when(F.col("ord") % 5 != 0, F.concat(F.lit('["'), F.col("court"), F.lit('", "unknown"]'))).alias("region"),
    )


#: su: the cases; sl: their lines. A case without lines counts as a plaintiff of its own.
SUED_SQL = f"""{LINES_SQL}, su as (select o_orderkey as ord, c_name as case_name, year(o_orderdate)::int as year, o_orderstatus as court, o_orderpriority as category, round(o_totalprice, 2) as np
  from orders join customer on o_custkey = c_custkey),
sl as (select su.*, l.k, case when l_suppkey % 4 <> 0 then 'S' || (l_suppkey % 4) end as pid, l_quantity, l_partkey, l_linenumber, l_returnflag, l_linestatus from su join lines l on l.l_orderkey = su.ord)"""
