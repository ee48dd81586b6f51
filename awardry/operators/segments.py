"""Running values over long groups, by segments: no task holds a group, however many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..working import stored

SLOT = "__slot"
#: Slots of groups to broadcast at most.
BROADCAST_ROWS = 100_000
#: Rows of a group that one task runs along, at most; they are streamed and not held.
GROUP_ROWS = 100_000


def few_each(df: DataFrame, by: list[str], most: int = GROUP_ROWS) -> bool:
    """Whether no group has more rows than one task may run along."""
    return bool(by) and df.groupBy(*by).count().where(F.col("count") > most).isEmpty()


def running_whole(df: DataFrame, by: list[str], order: list[str], **out: tuple[str, Column]) -> DataFrame:
    """running for groups of few rows each: a window over each group, without slots, so that rows are shuffled once and not stored."""
    along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.sum(F.coalesce(x, F.lit(0))).over(along) if kind == "sum" else F.last(x, ignorenulls=True).over(along) for k, (kind, x) in out.items()})


def slotted(df: DataFrame, by: list[str], order: list[str], slots: int | None = None) -> DataFrame:
    """df with __slot: ranges of the order by the columns of by, then of order, numbered along it; a large group is in many.

    Ranges are those of Spark's range partitioning, as many as the session has shuffle partitions (fewer where data are few), or
    ``slots``. What makes df runs once; the slots are stored, so that all that is made of them has the same ones.
    """
    rows = stored(df, "unslotted")
    keys = [*by, *order]
    dealt = rows.repartitionByRange(slots, *keys) if slots else rows.repartitionByRange(*keys)
    return stored(dealt.withColumn(SLOT, F.spark_partition_id()), "slotted")


def running(df: DataFrame, by: list[str], order: list[str], **out: tuple[str, Column]) -> DataFrame:
    """A slotted table with columns that run along each group's order: ("sum", x) up to the row itself, ("last", x) the last x that isn't null.

    Each slot tells its own sum or last of each group; these are carried over the slots, a row for each slot of a group, and then
    the rows are finished inside their slots. Rows that are equal in order have an arbitrary place among one another.
    """
    values = {k: F.coalesce(x, F.lit(0)) if kind == "sum" else x for k, (kind, x) in out.items()}
    rows = df.withColumns({f"__v_{k}": v for k, v in values.items()})
    at = F.struct(*order)
    own = {
        k: (F.sum(f"__v_{k}") if kind == "sum" else F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), at))).alias(f"__c_{k}") for k, (kind, _) in out.items()
    }
    before = Window.partitionBy(*by).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by, SLOT).agg(*own.values())
    carried = carried.select(
        *[F.col(c).alias(f"__b_{c}") for c in (*by, SLOT)],
        *[(F.coalesce(F.sum(f"__c_{k}").over(before), F.lit(0)) if kind == "sum" else F.last(f"__c_{k}", ignorenulls=True).over(before)).alias(f"__c_{k}") for k, (kind, _) in out.items()],
    )
    small = carried.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(carried) if small else carried, [rows[c].eqNullSafe(carried[f"__b_{c}"]) for c in (*by, SLOT)])
    inside = Window.partitionBy(*by, SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = {
        k: F.col(f"__c_{k}") + F.sum(f"__v_{k}").over(inside) if kind == "sum" else F.coalesce(F.last(f"__v_{k}", ignorenulls=True).over(inside), F.col(f"__c_{k}"))
        for k, (kind, _) in out.items()
    }
    return rows.withColumns(done).drop(*[f"__v_{k}" for k in out], *[f"__c_{k}" for k in out], *[f"__b_{c}" for c in (*by, SLOT)])
