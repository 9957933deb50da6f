"""Parts of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_parts(col: str) -> dict[str, Column]:
    """Day of week, month (short names) and year, named after the column."""
    return {
        f"{col}_dow": F.date_format(col, "E"),
        f"{col}_month": F.date_format(col, "MMM"),
        f"{col}_year": F.year(col),
    }


def year_difference(later: Column, earlier: Column) -> Column:
    return F.year(later) - F.year(earlier)
