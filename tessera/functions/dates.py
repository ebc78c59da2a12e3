"""Dates given as text, to the year, the month or the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(c: Column, i: int) -> Column:
    return F.try_element_at(F.split(F.trim(c), "-"), F.lit(i))


def flexible_date(c: Column) -> Column:
    """The earliest day that a year, a month or a day can mean; null for anything else."""
    n = F.size(F.split(F.trim(c), "-"))
    month = F.when(n > 1, _part(c, 2).try_cast("int")).otherwise(1)
    day = F.when(n > 2, _part(c, 3).try_cast("int")).otherwise(1)
    year = _part(c, 1).try_cast("int")
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(F.trim(c) == "", None).when(year.isNull() | month.isNull() | day.isNull(), None).otherwise(text.try_cast("date"))


def long_date(c: Column) -> Column:
    """'21 November 2025' for an ISO day; '' for null, anything else unchanged."""
    year, month, day = (_part(c, i).try_cast("int") for i in (1, 2, 3))
    names = F.array(*[F.lit(m) for m in "January February March April May June July August September October November December".split()])
    ok = (F.size(F.split(F.trim(c), "-")) == 3) & year.isNotNull() & day.isNotNull() & month.between(1, 12)
    return F.when(c.isNull() | (c == ""), "").when(ok, F.concat_ws(" ", day.cast("string"), F.try_element_at(names, F.when(month.between(1, 12), month).otherwise(1)), year.cast("string"))).otherwise(c)


def predates(event: Column, in_force_from: Column) -> Column:
    """The event came before the law; false where either is unknown."""
    return F.coalesce(event < flexible_date(in_force_from), F.lit(False))
