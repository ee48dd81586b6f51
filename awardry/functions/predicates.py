"""Conditions and values of case columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import given


def nonzero(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(0.0))


def damages_value(damages=None, non_pecuniary=None, extended=None, plaintiffs=None) -> Column:
    """The first amount that isn't null or 0 of the case, its extension and its plaintiffs."""
    parts = [F.nullif(c.try_cast("double"), F.lit(0.0)) for c in (damages, non_pecuniary, extended) if c is not None]
    if plaintiffs is not None:
        amounts = F.transform(plaintiffs, lambda p: nonzero(p["non_pecuniary_damages"]))
        parts.append(F.get(F.filter(amounts, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def in_categories(regions: Column, selected: list[str]) -> Column:
    """Whether a case has one of the selected categories; all cases do if none are selected."""
    if not selected:
        return F.lit(True)
    wanted = F.array(*[F.lit(s.strip().lower()) for s in selected])
    return F.coalesce(F.arrays_overlap(F.transform(regions, lambda x: F.lower(F.trim(x))), wanted), F.lit(False))


def in_range(value: Column, low=None, high=None) -> Column:
    """Within inclusive bounds; a null is outside once there is one."""
    out = F.lit(True)
    if low is not None:
        out = out & F.coalesce(value >= low, F.lit(False))
    if high is not None:
        out = out & F.coalesce(value <= high, F.lit(False))
    return out


def of_gender(sex: Column, gender: str | None) -> Column:
    """Missing values pass; else the first letter of the gender decides."""
    return F.lit(True) if not gender else given(sex).isNull() | (F.upper(sex) == gender[0].upper())


def of_age(age: Column, wanted: int | None, tolerance: int = 5) -> Column:
    return F.lit(True) if wanted is None else age.isNull() | (F.abs(age - wanted) <= tolerance)


def total_award(non_pecuniary: Column, pecuniary: Column, old_rule: bool = False) -> Column:
    """The sum: null if it is 0, or by the old rule if both are null."""
    total = F.coalesce(non_pecuniary, F.lit(0.0)) + F.coalesce(pecuniary, F.lit(0.0))
    return F.when(non_pecuniary.isNotNull() | pecuniary.isNotNull(), total) if old_rule else F.nullif(total, F.lit(0.0))
