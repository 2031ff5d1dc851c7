"""Length of a time period in days, from its first day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months, or else days, of each granularity (fixed values).
MONTHS = {"month": 1, "quarter": 3, "year": 12}
DAYS = {"day": 1, "week": 7}


def period_days(day: Column, granularity: str) -> Column:
    if granularity in DAYS:
        return F.when(day.isNotNull(), F.lit(DAYS[granularity])).cast("long")
    if granularity not in MONTHS:
        raise ValueError(f"Unknown time granularity: {granularity}")
    start = day.cast("date")
    return F.datediff(F.add_months(start, MONTHS[granularity]), start).cast("long")
