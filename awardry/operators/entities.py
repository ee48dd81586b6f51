"""Cases by judge, by category and by claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import given, normal, title_case


def first_of(df: DataFrame, keys: list[str], order: list[Column], tasks: int | None = None) -> DataFrame:
    """The first row of each key in an order; the rows are dealt to so many tasks, or as the session says, and sorted once."""
    df = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def by_judge(cases: DataFrame, judges: str = "judges", out: str = "judge") -> DataFrame:
    """A row for each case and different judge, the name in title case."""
    names = F.array_distinct(F.transform(F.filter(judges, lambda j: F.trim(j) != ""), lambda j: title_case(F.trim(j))))
    return cases.withColumn(out, F.explode(names))


def judge_cases(cases: DataFrame, ord_column: str = "ord", dedupe: bool = True, tasks: int | None = None) -> DataFrame:
    """by_judge, of the same name and year the first case of each judge only."""
    rows = by_judge(cases)
    return first_of(rows, ["judge", "case_name", "year"], [F.col(ord_column)], tasks) if dedupe else rows


def awards(cases: DataFrame, claims: str = "claims") -> DataFrame:
    """A row for each claim that is an award above 0; a claim without the flag is one."""
    rows = cases.withColumn("claim", F.explode(claims))
    is_award = F.coalesce(F.col("claim.is_fla_award"), F.lit(True)) & (F.col("claim.amount") > 0)
    return rows.where(is_award).withColumns(
        {
            "relationship": F.coalesce(given(F.col("claim.relationship")), F.lit("Unknown")),
            "amount": F.col("claim.amount"),
            "description": F.coalesce(F.col("claim.description"), F.lit("")),
        }
    ).drop("claim")


def with_claims(cases: DataFrame, claims: str = "claims") -> DataFrame:
    return cases.where(F.coalesce(F.size(claims), F.lit(0)) > 0)


def by_category(cases: DataFrame, valid: DataFrame | None = None, regions: str = "regions", out: str = "category") -> DataFrame:
    """A row for each case and different region in upper case that is valid; all are if valid is empty or missing."""
    names = F.array_distinct(F.transform(F.filter(regions, lambda r: F.trim(r) != ""), normal))
    rows = cases.withColumn(out, F.explode(names))
    if valid is not None and not valid.isEmpty():
        rows = rows.join(valid.select(F.col("category").alias(out)).distinct(), out, "left_semi")
    return rows


#: How the category of a relationship begins.
RELATION = "FLA: "


def category_cases(cases: DataFrame, name: str, region: str = "region", regions: str = "regions", claims: str = "claims") -> DataFrame:
    """The cases of one category: its name equals region or one of the regions, but for case; FLA: x: a claim of x is an award."""
    if name.startswith(RELATION):
        want = name[len(RELATION) :].strip().lower()
        hit = F.exists(claims, lambda c: (F.lower(F.trim(F.coalesce(c["relationship"], F.lit("")))) == want) & F.coalesce(c["is_fla_award"], F.lit(True)))
    else:
        hit = (F.upper(F.coalesce(region, F.lit(""))) == name.upper()) | F.coalesce(F.exists(regions, lambda r: F.upper(r) == name.upper()), F.lit(False))
    return cases.where(F.coalesce(hit, F.lit(False)))


def category_points(cases: DataFrame, name: str, claim_amounts: bool = False, amount: str = "damages", adjusted: str = "adjusted", claims: str = "claims", **columns) -> DataFrame:
    """Timeline points of one category: category, year, award, adjusted, case_name.

    A category FLA: x shows the main award of its cases; with claim_amounts, each award of x instead, as it is.
    """
    rows = category_cases(cases, name, claims=claims, **columns).withColumn("category", F.lit(name))
    if claim_amounts and name.startswith(RELATION):
        own = awards(rows.drop(amount), claims).where(F.lower(F.trim("relationship")) == name[len(RELATION) :].strip().lower())
        rows = own.withColumns({amount: F.col("amount"), adjusted: F.lit(None).cast("double")})
    return timeline_points(rows, "category", amount, adjusted, keep=("case_name",))


def by_claim_category(cases: DataFrame, claims: str = "claims", out: str = "category", amount: str = "amount") -> DataFrame:
    """A row for each case and relationship among its awards: category FLA: x, amount of the first claim with that relationship.

    The amount counts only if that first claim is an award above 0.
    """
    name = lambda c: F.lower(F.trim(c["relationship"]))
    awarded = F.filter(claims, lambda c: F.coalesce(c["is_fla_award"], F.lit(True)) & (c["amount"] > 0) & (F.coalesce(name(c), F.lit("")) != ""))
    rows = cases.withColumn("__rel", F.explode(F.array_distinct(F.transform(awarded, name))))
    first = F.get(F.filter(claims, lambda c: name(c) == F.col("__rel")), F.lit(0))
    good = F.coalesce(first["is_fla_award"], F.lit(True)) & (first["amount"] > 0)
    return rows.withColumns({out: F.concat(F.lit("FLA: "), F.col("__rel")), amount: F.when(good, first["amount"])}).drop("__rel")


def all_categories(cases: DataFrame, valid: DataFrame | None = None, regions: str = "regions", claims: str = "claims") -> DataFrame:
    """The different categories and FLA: relationships."""
    own = by_category(cases, valid, regions).select("category")
    return own.unionByName(by_claim_category(cases, claims).select("category")).distinct()


def judge_counts(cases: DataFrame) -> DataFrame:
    """(judge, n): the cases of each judge, of the same name and year one."""
    return by_judge(cases.select("judges", "case_name", "year")).select("judge", "case_name", "year").distinct().groupBy("judge").agg(F.count("*").alias("n"))


def corpus_counts(cases: DataFrame, amount: str = "damages", plaintiffs: str = "plaintiffs") -> DataFrame:
    return cases.agg(
        F.count("*").alias("total"), F.count_if(F.size(plaintiffs) > 1).alias("multi_plaintiff"), F.count_if(F.col(amount) > 0).alias("with_damages")
    )


def selected(df: DataFrame, column: str, names: list[str], most: int = 8) -> DataFrame:
    """Rows of up to ``most`` selected entities, for one comparison in one pass."""
    if len(names) > most:
        raise ValueError(f"at most {most} can be compared")
    return df.where(F.col(column).isin(names))


def all_judges(cases: DataFrame, judges: str = "judges") -> DataFrame:
    """The different judges, in title case."""
    return by_judge(cases.select(judges), judges).select("judge").distinct()


def all_relationships(cases: DataFrame, claims: str = "claims") -> DataFrame:
    """The different relationships of awards."""
    return awards(cases, claims).select("relationship").distinct()


def year_bounds(cases: DataFrame, year: str = "year") -> DataFrame:
    """first and last year; 0 counts as missing."""
    real = F.nullif(F.col(year), F.lit(0))
    return cases.agg(F.min(real).alias("first"), F.max(real).alias("last"))


def timeline_points(rows: DataFrame, by: str, amount: str = "amount", adjusted: str = "adjusted", keep: tuple[str, ...] = ()) -> DataFrame:
    """A point for each row with a year and an award above 0: by, year, award, adjusted (the award where there is none) and more columns."""
    good = rows.where(F.col("year").isNotNull() & (F.col(amount) > 0))
    return good.select(by, "year", F.col(amount).alias("award"), F.coalesce(F.nullif(F.col(adjusted), F.lit(0.0)), F.col(amount)).alias("adjusted"), *keep)
