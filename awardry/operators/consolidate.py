"""One case out of the records of several tables, and its dashboard form.

Records come with ord, the order of input. Arrays that a case gathers are as long as its records are many:
a name, year and court with a large share of all records would make one large case, by what a case is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import total_award
from ..functions.text import as_list, dashboard_summary, given, some
from ..schemas import AMOUNT, CLAIM, PLAINTIFF
from .segments import SLOT, slotted

UNKNOWN = "UNKNOWN"


def _listed(df: DataFrame, c: str) -> Column:
    """A column that may be a scalar, a text of a JSON list or an array, as an array; null when missing or empty."""
    kind = dict(df.dtypes).get(c, "void")
    if kind.startswith("array"):
        return some(F.transform(F.col(c), lambda x: x.cast("string")))
    return some(as_list(F.col(c).cast("string"))) if kind != "void" else F.lit(None).cast("array<string>")


def _either(df: DataFrame, one: str, many: str) -> Column:
    return F.coalesce(_listed(df, one), _listed(df, many))


def _known(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: (F.trim(x) != "") & (F.upper(x) != UNKNOWN))))


def folded_plaintiffs(found: Column) -> Column:
    """Of the plaintiffs with one id the first; those without get P and one more than the number kept so far."""
    start = F.struct(F.array().cast(f"array<{PLAINTIFF}>").alias("kept"), F.array().cast("array<string>").alias("ids"))

    def step(acc, p):
        own = F.coalesce(given(p["plaintiff_id"]), F.concat(F.lit("P"), (F.size(acc["kept"]) + 1).cast("string")))
        entry = p.withField("plaintiff_id", own).cast(PLAINTIFF)
        new = F.struct(F.array_append(acc["kept"], entry).alias("kept"), F.array_append(acc["ids"], own).alias("ids"))
        return F.when(F.array_contains(acc["ids"], own), acc).otherwise(new)

    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def consolidate(records: DataFrame, carry_other_damages: bool = True, claims: str = "first", anonymous: str = "each") -> DataFrame:
    """A row for each (case_name, year, court), nulls being equal.

    claims: "first" keeps those of the first record, "union" all. anonymous: "each" record without plaintiffs is
    a plaintiff of its own; "first" counts only the first of them. ord of a case is that of its first record.
    judge, citation and source_page may be scalars or lists; where one is missing, a column judges, citations or
    source_pages stands for it. Citations are joined by "; ", and of several pages the first is the case's.
    """
    r = records.withColumn("case_name", F.coalesce(given(F.col("case_name")), F.lit("Unknown")))
    own = F.array(F.struct(
        F.lit(None).cast("string").alias("plaintiff_id"), F.col("plaintiff_name"), F.col("sex"), F.col("age"), F.col("non_pecuniary_damages"),
        F.coalesce("injuries", F.array().cast("array<string>")).alias("injuries"), F.col("comments"),
    ).cast(PLAINTIFF))
    r = r.withColumn("__p", F.coalesce(some(F.col("plaintiffs")), own)).withColumn("__bare", F.coalesce(F.size("plaintiffs"), F.lit(0)) < 1)
    r = r.withColumns(
        {
            "__region": _listed(r, "region"), "__category": _listed(r, "category"), "__judge": _either(r, "judge", "judges"),
            "__citation": F.array_join(_either(r, "citation", "citations"), "; "), "__page": _either(r, "source_page", "source_pages"),
        }
    )
    if anonymous == "first":
        first = r.where("__bare").groupBy("case_name", "year", "court").agg(F.min("ord").alias("__first"))
        keys = [r[c].eqNullSafe(first[c]) for c in ("case_name", "year", "court")]
        r = r.join(first, keys, "left").select(r["*"], "__first")
        r = r.withColumn("__p", F.when(~F.col("__bare") | (F.col("ord") == F.col("__first")), F.col("__p")).otherwise(F.array().cast(f"array<{PLAINTIFF}>")))
    # a case's records come to one task as rows, and are gathered there once, in order: gathered before the shuffle, each of
    # their fields would be sent with an order of its own
    gathered = {"__p": "__found", "__category": "__categories", "__region": "__regions", "injuries": "__injuries"}
    gathered |= {"other_damages": "other_damages"} if carry_other_damages else {}
    gathered |= {"family_law_act_claims": "claims"} if claims != "first" else {}
    of_first = {"__judge": "judges", "__citation": "citation", "__page": "__page", "comments": "comments"}
    of_first |= {"family_law_act_claims": "claims"} if claims == "first" else {}
    r = r.select("case_name", "year", "court", "ord", F.struct(*of_first).alias("__one"), F.struct("ord", *gathered).alias("__all"))
    g = r.repartition("case_name", "year", "court").groupBy("case_name", "year", "court").agg(
        F.min("ord").alias("ord"), F.count("*").alias("n_records"), F.min_by("__one", "ord").alias("__first"), F.array_sort(F.collect_list("__all")).alias("__rows")
    )
    # null lists count as empty ones
    listed = lambda c: F.flatten(F.filter(F.transform("__rows", lambda x: x[c]), lambda x: x.isNotNull())).alias(gathered[c])
    g = g.select("case_name", "year", "court", "ord", "n_records", *[F.col(f"__first.{c}").alias(k) for c, k in of_first.items()], *[listed(c) for c in gathered])
    if not carry_other_damages:
        g = g.withColumn("other_damages", F.array().cast(f"array<struct<{AMOUNT}>>"))
    g = g.withColumns({"source_page": F.get("__page", F.lit(0)).cast("int"), "categories": _known(F.col("__categories")), "regions": _known(F.col("__regions"))})
    g = g.withColumn("plaintiffs", folded_plaintiffs(F.col("__found")))
    injuries = F.concat(F.flatten(F.transform("plaintiffs", lambda p: F.coalesce(p["injuries"], F.array().cast("array<string>")))), F.col("__injuries"))
    unknown = lambda c: F.coalesce(some(F.col(c)), F.array(F.lit(UNKNOWN)))
    return g.withColumns(
        {
            "injuries": F.array_sort(F.array_distinct(F.filter(injuries, lambda x: F.coalesce(x != "", F.lit(False))))),
            "categories": unknown("categories"), "regions": unknown("regions"),
            "claims": F.coalesce("claims", F.array().cast(f"array<{CLAIM}>")),
        }
    ).select("case_name", "year", "court", "ord", "n_records", "judges", "citation", "source_page", "comments", "claims", "other_damages", "categories", "regions", "plaintiffs", "injuries")


def numbered(df: DataFrame, order: str = "ord", then: list[str] | None = None, out: str = "id", prefix: str = "case_", slots: int | None = None) -> DataFrame:
    """df with out: case_0001 and so on by a numeric order, equal ones by the columns of then.

    Rows are dealt out by ranges of the order and then, as many as the data need, numbered inside their range, and
    moved by the number of rows in the ranges before. What makes them runs once.
    """
    keys = [order, *(then or [])]
    rows = slotted(df, [], keys, slots)
    before = F.coalesce(F.sum("count").over(Window.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = rows.groupBy(SLOT).count().select(SLOT, before.alias("__before"))
    n = F.row_number().over(Window.partitionBy(SLOT).orderBy(*keys)) + F.col("__before")
    return rows.join(F.broadcast(ranges), SLOT).withColumn(out, F.format_string(f"{prefix}%04d", n)).drop(SLOT, "__before")


def _sum(a: Column, field: str) -> Column:
    return F.aggregate(F.transform(a, lambda x: F.coalesce(x[field], F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def dashboard(cases: DataFrame, ids: bool = True) -> DataFrame:
    """Consolidated cases in the dashboard's nested form, without vectors."""
    np_, pec = _sum(F.col("plaintiffs"), "non_pecuniary_damages"), _sum(F.coalesce("other_damages", F.array().cast(f"array<struct<{AMOUNT}>>")), "amount")
    first = F.get(F.col("plaintiffs"), F.lit(0))
    cases = cases.withColumns({"__np": np_, "__pec": pec})
    primary = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(UNKNOWN))
    extended = F.struct(
        F.col("injuries"), F.col("regions"), F.col("categories"), first["sex"].alias("sex"), first["age"].alias("age"), F.col("other_damages"),
        F.size("plaintiffs").alias("num_plaintiffs"), F.col("plaintiffs"), F.col("comments"), F.col("judges"), F.col("claims").alias("family_law_act_claims"),
    )
    known = F.filter("categories", lambda c: c != UNKNOWN)
    out = cases.select(
        "ord", "case_name", "year", "court", F.coalesce("judges", F.array().cast("array<string>")).alias("judge"), "citation", "source_page",
        primary("categories").alias("category"), primary("regions").alias("region"),
        F.nullif(F.col("__np"), F.lit(0.0)).alias("damages"), F.col("__np").alias("non_pecuniary_damages"), F.col("__pec").alias("pecuniary_damages"),
        total_award(F.col("__np"), F.col("__pec")).alias("total_award"), "comments", extended.alias("extended_data"),
        dashboard_summary(F.col("injuries"), known, F.col("comments")).alias("summary_text"),
    )
    return numbered(out) if ids else out


def per_plaintiff(cases: DataFrame, ids: bool = True) -> DataFrame:
    """The older form: a row for each plaintiff (or for a case without any), with the plaintiff's fields where it has an id."""
    rows = cases.select("*", F.posexplode_outer("plaintiffs").alias("__pos", "__pl"))
    named = F.col("__pl.plaintiff_id").isNotNull()
    own = lambda c: F.when(named, F.col(f"__pl.{c}")).otherwise(F.col(c))
    region = F.col("region") if dict(cases.dtypes)["region"].startswith("array") else as_list(F.col("region"))
    head = F.when(F.col("category") != UNKNOWN, F.array("category")).otherwise(F.array().cast("array<string>"))
    regions = F.coalesce(some(F.concat(head, F.coalesce(region, F.array().cast("array<string>")))), F.array(F.lit(UNKNOWN)))
    np_ = own("non_pecuniary_damages").cast("double")
    other = F.col("other_damages")
    pec = F.when(F.size(other) > 0, _sum(other, "amount"))
    out = rows.select(
        "ord", F.coalesce("__pos", F.lit(0)).alias("plaintiff_no"), "case_name", "year", "court", own("plaintiff_name").alias("plaintiff_name"), own("sex").alias("sex"),
        own("age").alias("age"), np_.alias("non_pecuniary_damages"), pec.alias("pecuniary_damages"), total_award(np_, pec, old_rule=True).alias("total_award"),
        own("injuries").alias("injuries"), own("comments").alias("comments"), regions.alias("regions"),
        F.coalesce(F.get(region, F.lit(0)), F.col("category")).alias("region"), "category",
        dashboard_summary(own("injuries"), F.array("category"), own("comments"), most=None, label="Category: ").alias("summary_text"),
    )
    return numbered(out, "ord", ["plaintiff_no"]) if ids else out


def flat(cases: DataFrame) -> DataFrame:
    """The old one-to-one form, with the category as region."""
    return cases.select(
        F.coalesce(given(F.col("category")), F.lit(UNKNOWN)).alias("region"), "case_name", "year", "court",
        F.col("non_pecuniary_damages").alias("damages"), dashboard_summary(F.col("injuries"), F.array("category"), F.col("comments"), most=None, label="Category: ").alias("summary_text"),
    )


def coverage(before: DataFrame, after: DataFrame, claims_before: str = "family_law_act_claims", claims_after: str = "claims") -> DataFrame:
    """One row: cases and claims with claims before and after consolidation, whether they differ, and cases with injuries."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    one = lambda df, c, tag: df.agg(
        F.count("*").alias(f"rows_{tag}"), F.count_if(size(c) > 0).alias(f"with_claims_{tag}"), F.sum(size(c)).alias(f"claims_{tag}"),
        F.count_if(size("injuries") > 0).alias(f"with_injuries_{tag}"),
    )
    return one(before, claims_before, "before").crossJoin(one(after, claims_after, "after")).withColumn("mismatch", F.col("claims_before") != F.col("claims_after"))
