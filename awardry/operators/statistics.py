"""Statistics of awards. Medians and quartiles are exact and need no group in one task; deviations are of the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..working import stored, tasks_for


#: Different values of a bucket that one task looks through; buckets that hold a rank and have more are cut into so many.
MOST, CUTS = 4096, 1024
#: Groups to broadcast at most.
BROADCAST_ROWS = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def all_quantiles(df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]], most: int = MOST) -> DataFrame:
    """(by, name of each quantile): exact quantiles, linear between two values, of each group that has a value.

    wanted: the columns with the names and places of their quantiles, all from one reading of df: its columns become
    rows, counted by group, column and value. A group's bucket is at first the whole range of its values. Buckets that hold a
    wanted rank and have more than ``most`` different values are cut again, into CUTS pieces of their own range, until none
    has: whatever the values, no task holds a group. NaN counts as missing.
    """
    keys = [*by, "__m"]
    each = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(wanted)])
    rows = df.select(*by, F.explode(each).alias("__x")).where("__x.v is not null and not isnan(__x.v)")
    counted = stored(rows.groupBy(*by, F.col("__x.m").alias("__m"), F.col("__x.v").alias("__v")).agg(F.count("*").alias("__c")), "values")
    last = F.col("__n") - 1

    def rank(name, end, q):
        x = last * q
        return F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), (F.floor(x) if end == "lo" else F.ceil(x)).alias("r"), (x - F.floor(x)).alias("part"))

    ranks = F.array().cast("array<struct<q:string,end:string,r:bigint,part:double>>")
    for i, at in enumerate(wanted.values()):
        ranks = F.when(F.col("__m") == i, F.array(*[rank(k, e, q) for k, q in at.items() for e in ("lo", "hi")])).otherwise(ranks)
    extent = [F.sum("__c").alias("__n"), F.count("*").alias("__d"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    active = counted.groupBy(*keys).agg(*extent).select(*keys, ranks.alias("__ranks"), F.lit(0).cast("long").alias("__base"), "__d", "__lo", "__hi")
    done, cut = None, False
    while True:
        active = stored(active, "buckets")  # a row for each group and rank at most
        large = (F.col("__d") > most) & (F.col("__lo") < F.col("__hi"))
        done = active.where(~large) if done is None else done.union(active.where(~large))
        if active.where(large).isEmpty():
            break
        cut = True
        inside = _inside(counted, active.where(large), keys)
        wide = (F.col("__lo") > 0) & (F.col("__hi") > F.col("__lo") * 16)
        share = F.when(wide, F.log(F.col("__v") / F.col("__lo")) / F.log(F.col("__hi") / F.col("__lo"))).otherwise((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
        inside = inside.withColumn("__cut", F.least(F.floor(share * CUTS), F.lit(CUTS - 1)))
        cuts = inside.groupBy(*keys, F.col("__lo").alias("__from"), "__cut").agg(*extent, F.first("__base").alias("__base"), F.first("__ranks").alias("__ranks"))
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__from").orderBy("__cut").rowsBetween(Window.unboundedPreceding, 0))  # CUTS rows
        cuts = cuts.withColumn("__upto", F.col("__base") + upto).withColumn("__base", F.col("__upto") - F.col("__n"))
        own = F.filter("__ranks", lambda x: (x["r"] >= F.col("__base")) & (x["r"] < F.col("__upto")))
        active = cuts.withColumn("__ranks", own).where(F.size("__ranks") > 0).select(*keys, "__ranks", "__base", "__d", "__lo", "__hi")
    if cut:
        found = _inside(counted, done, keys)
        to = F.col("__base") + F.sum("__c").over(Window.partitionBy(*keys, "__lo").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("__to", to)
    else:  # each group is one bucket of few values: its size and ranks come from its own rows, without a join
        dealt = counted.repartition(tasks_for(df.sparkSession, counted.count()), *keys)
        whole = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        upto = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        found = dealt.withColumns({"__n": F.sum("__c").over(whole), "__to": F.sum("__c").over(upto)}).withColumn("__ranks", ranks)
    own = F.filter("__ranks", lambda x: (x["r"] >= F.col("__to") - F.col("__c")) & (x["r"] < F.col("__to")))
    found = found.select(*by, "__v", F.explode(own).alias("__r"))
    of = lambda k, e, c: F.max(F.when((F.col("__r.q") == k) & (F.col("__r.end") == e), F.col(c)))
    between = lambda k: of(k, "lo", "__v") * (1 - of(k, "lo", "__r.part")) + of(k, "hi", "__v") * of(k, "lo", "__r.part")
    return found.groupBy(*by).agg(*[between(k).alias(k) for at in wanted.values() for k in at])


def _inside(counted: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each bucket, with its columns."""
    right = _few(buckets.select(*[F.col(k).alias(f"_{k}") for k in keys], "__ranks", "__base", "__lo", "__hi"))
    on = [counted[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return counted.join(right, on).where(F.col("__v").between(F.col("__lo"), F.col("__hi"))).drop(*[f"_{k}" for k in keys])


def with_all_quantiles(stats: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """stats, a row for each group, with the exact quantiles of df; null for a group without values."""
    q = all_quantiles(df, by, wanted)
    right = q.select(*[F.col(c).alias(f"__{c}") for c in by], *[k for at in wanted.values() for k in at])
    on = [stats[c].eqNullSafe(right[f"__{c}"]) for c in by] or F.lit(True)
    return stats.join(right if by else F.broadcast(right), on, "left").drop(*[f"__{c}" for c in by])  # without groups: one row


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """all_quantiles of one column."""
    return all_quantiles(df, by, {value: at})


def with_quantiles(stats: DataFrame, df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """with_all_quantiles of one column."""
    return with_all_quantiles(stats, df, by, {value: at})


def of_amounts(c: Column, name: str) -> list[Column]:
    """mean, min, max and std of an amount; 0 where there is none."""
    zero = lambda x, what: F.coalesce(x, F.lit(0.0)).alias(f"{what}_{name}")
    return [zero(F.avg(c), "mean"), zero(F.min(c), "min"), zero(F.max(c), "max"), zero(F.stddev_pop(c), "std")]


def award_statistics(df: DataFrame, by: list[str], amount: str = "amount", adjusted: str = "adjusted", year: str = "year") -> DataFrame:
    """A row for each group: cases, cases with an award, statistics of original and adjusted awards, first and last year.

    One grouped aggregate stands for a pass over all cases for each judge or category; medians come by quantiles().
    """
    award = F.when(F.col(amount) > 0, F.col(amount))
    money = F.when(F.col(amount) > 0, F.coalesce(F.nullif(F.col(adjusted), F.lit(0.0)), F.col(amount)))
    real_year = F.nullif(F.col(year), F.lit(0))
    df = stored(df.select(*by, award.alias("award"), money.alias("money"), real_year.alias("real_year")), "awards")  # the source is read once
    out = df.groupBy(*by).agg(
        F.count("*").alias("total_cases"), F.count("award").alias("cases_with_award"),
        *of_amounts(F.col("award"), "award"), *of_amounts(F.col("money"), "adjusted"),
        F.min("real_year").alias("first_year"), F.max("real_year").alias("last_year"),
    )
    out = with_all_quantiles(out, df, by, {"award": {"median_award": 0.5}, "money": {"median_adjusted": 0.5}})
    return out.na.fill(0.0, ["median_award", "median_adjusted"])


def distribution(df: DataFrame, by: list[str], value: Column, name: str = "value") -> DataFrame:
    """(by, name, n): how often each value occurs in each group."""
    return df.select(*by, value.alias(name)).where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, by: list[str], name: str = "value") -> DataFrame:
    """A distribution as one map for each group."""
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("distribution"))


def five_numbers(df: DataFrame, by: list[str], amount: str, least: int = 2) -> DataFrame:
    """min, q25, median, q75, max and n of the groups with least values or more."""
    df = stored(df.select(*by, amount), "amounts")
    out = df.groupBy(*by).agg(F.min(amount).alias("min"), F.max(amount).alias("max"), F.count(amount).alias("n")).where(F.col("n") >= least)
    return with_all_quantiles(out, df, by, {amount: {"q25": 0.25, "median": 0.5, "q75": 0.75}}).select(*by, "min", "q25", "median", "q75", "max", "n")


def timeline(df: DataFrame, amount: str, by: list[str] | None = None, year: str = "year") -> DataFrame:
    """mean, median and n by year (and group)."""
    keys = [*(by or []), year]
    df = stored(df.select(*keys, amount), "amounts")
    out = df.groupBy(*keys).agg(F.avg(amount).alias("mean"), F.count(amount).alias("n"))
    return with_all_quantiles(out, df, keys, {amount: {"median": 0.5}}).select(*keys, "mean", "median", "n")


def summary(df: DataFrame, amount: str) -> DataFrame:
    """median, mean, min, max and n of all amounts."""
    df = stored(df.select(amount), "amounts")
    out = df.agg(F.avg(amount).alias("mean"), F.min(amount).alias("min"), F.max(amount).alias("max"), F.count(amount).alias("n"))
    return with_all_quantiles(out, df, [], {amount: {"median": 0.5}}).select("median", "mean", "min", "max", "n")


def change_summary(df: DataFrame, amount: str = "amount", adjusted: str = "adjusted") -> DataFrame:
    """Median original, median adjusted, mean change in per cent."""
    percent = (F.col(adjusted) - F.col(amount)) / F.nullif(F.col(amount), F.lit(0.0)) * 100
    df = stored(df.select(amount, adjusted), "amounts")
    out = with_all_quantiles(df.agg(F.avg(percent).alias("mean_change")), df, [], {amount: {"median_original": 0.5}, adjusted: {"median_adjusted": 0.5}})
    return out.select("median_original", "median_adjusted", "mean_change")


def trend_line(df: DataFrame, amount: str, year: str = "year", points: int = 100) -> DataFrame:
    """(point, x, y): the least-squares line at evenly spaced years; y is null for a single year."""
    fit = df.agg(
        F.regr_slope(amount, year).alias("slope"), F.regr_intercept(amount, year).alias("intercept"), F.min(year).alias("lo"), F.max(year).alias("hi")
    )
    fit = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    return fit.select("point", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y"))


def cap_comparison(df: DataFrame, amount: str, cap: float = fixed.DAMAGES_CAP) -> DataFrame:
    """min, median and max against the cap: measure, amount, percent, band. Empty for fewer than two values."""
    df = stored(df.select(amount), "amounts")
    one = df.agg(F.min(amount).alias("lo"), F.max(amount).alias("hi"), F.count(amount).alias("n")).where("n >= 2")
    one = with_all_quantiles(one, df, [], {amount: {"mid": 0.5}})
    rows = one.select(F.stack(F.lit(3), F.lit("min"), F.col("lo"), F.lit("median"), F.col("mid"), F.lit("max"), F.col("hi")).alias("measure", "amount"))
    percent = F.col("amount") / cap * 100
    band = F.when(percent < 25, "low").when(percent < 50, "moderate").when(percent < 75, "high").otherwise("very high")
    return rows.select("measure", "amount", percent.alias("percent"), band.alias("band"))


def counts(df: DataFrame, name: str, out: str = "n") -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(name).agg(F.count("*").alias(out))


def rolled_up(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Statistics by the groups and all their prefixes; level tells the rows of totals."""
    return df.rollup(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(amount).alias("mean"), F.min(amount).alias("min"), F.max(amount).alias("max"))
