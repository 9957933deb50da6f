"""Flags, buckets, level maps, labels and messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_sum(cols: Sequence[Column]) -> Column:
    """Sum within a row, missing counted as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])


def flag(test: Column, missing_is_zero: bool = False) -> Column:
    """1 where the test holds, else 0. A missing test stays missing unless `missing_is_zero`."""
    yes = F.when(test, 1)
    return yes.otherwise(0) if missing_is_zero else yes.when(~test, 0)


def buckets(col: Column, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """Label of the first inclusive range that holds the value, else missing."""
    out = F
    for low, high, label in ranges:
        out = out.when(col.between(low, high), F.lit(label))
    return out


def level_map(col: Column, codes: Mapping[str, int]) -> Column:
    """Integer of a label by dictionary; a label outside it gives null."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.create_map(*pairs)[col]


def level_position(col: Column, levels: Sequence[str]) -> Column:
    """1-based position in an ordered level list; other values give null."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), col).cast("int")
    return F.when(place > 0, place)


def level_label(index: Column, levels: Sequence[str]) -> Column:
    """Label at a 1-based index; an index outside the list gives null."""
    return F.when(index.between(1, len(levels)), F.element_at(F.array(*[F.lit(v) for v in levels]), index))


def recode(col: Column, changes: Mapping) -> Column:
    """Listed values replaced, the rest kept (as text)."""
    out = F
    for old, new in changes.items():
        out = out.when(col == F.lit(old), F.lit(new))
    return out.otherwise(col.cast("string"))


def year_month(year: Column, month: Column) -> Column:
    """`YYYY-MM` from two numbers."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))
