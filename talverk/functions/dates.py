"""Dates that may be partial: `YYYY`, `YYYY-MM`, `YYYY-MM-DD`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, DAY = r"\A[0-9]{4}\z", r"\A[0-9]{4}-[0-9]{2}\z", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def first_day(text: Column) -> Column:
    """The first day of a partial date; null for null and for what is no date of these forms (`2020-13`, `1/4 1985`)."""
    full = (
        F.when(text.rlike(DAY), text)
        .when(text.rlike(MONTH), F.concat(text, F.lit("-01")))
        .when(text.rlike(YEAR), F.concat(text, F.lit("-01-01")))
    )
    return F.try_to_date(full, "yyyy-MM-dd")


def last_day(text: Column) -> Column:
    """The last day of a partial date; null for null and for what is no date."""
    first = first_day(text)
    return F.when(text.rlike(YEAR), F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd")).when(text.rlike(MONTH), F.last_day(first)).otherwise(first)
