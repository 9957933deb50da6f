"""Shape, types, first values and missing-value reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text_of(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string").alias(name)


def column_aggregate(
    df: DataFrame, cols: Sequence[str], make, value: str = "value", by: Sequence[str] = ()
) -> DataFrame:
    """(by, name, value): `make(column)` for every column in ONE aggregate, turned into long form."""
    wide = df.groupBy(*by).agg(*[make(F.col(f"`{c}`")).alias(c) for c in cols])
    return wide.unpivot([F.col(b) for b in by], [F.col(f"`{c}`") for c in cols], "name", value)


def shape(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def type_counts(df: DataFrame) -> DataFrame:
    """(type, n_columns, n_values): columns per type and the non-missing cells they hold."""
    of_type = dict(df.dtypes)
    filled = column_aggregate(df, df.columns, F.count, "filled")
    pairs = [F.lit(x) for name, kind in of_type.items() for x in (name, kind)]
    named = filled.withColumn("type", F.create_map(*pairs)[F.col("name")])
    return named.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("filled").alias("n_values")
    )


def glimpse(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """(name, type, first_values): the first `n` values of every column as one line of text."""
    first = df.orderBy(*order_by).limit(n)
    lists = [F.array_join(F.collect_list(_text_of(first, c)), ", ", "NA").alias(c) for c in df.columns]
    # collect_list over a sorted, n-row table in one partition keeps its order
    wide = first.coalesce(1).sortWithinPartitions(*order_by).agg(*lists)
    long = wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "name", "first_values")
    pairs = [F.lit(x) for name, kind in df.dtypes for x in (name, kind)]
    return long.select("name", F.create_map(*pairs)[F.col("name")].alias("type"), "first_values")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """(name, n_missing), largest first."""
    out = column_aggregate(df, cols or df.columns, lambda c: F.count_if(c.isNull()), "n_missing")
    if not keep_zero:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.desc("n_missing"), "name")


def null_percent(df: DataFrame, cols: Sequence[str] | None = None, style: str = "r") -> DataFrame:
    """(name, pct_missing). Style "r" rounds the share to 4 places, then takes percent; style "pandas"
    rounds the percent to 2 places. Both round half to even."""
    cols = cols or df.columns

    def share(c: Column) -> Column:
        part = F.count_if(c.isNull()) / F.count(F.lit(1))
        return F.bround(part, 4) * 100 if style == "r" else F.bround(part * 100, 2)

    return column_aggregate(df, cols, share, "pct_missing")


def null_counts_by_group(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, name, n_missing)."""
    return column_aggregate(df, cols, lambda c: F.count_if(c.isNull()), "n_missing", by)


def null_count_histogram(df: DataFrame) -> DataFrame:
    """(n_missing, n_columns): how many columns have each number of missing values."""
    return null_counts(df, keep_zero=True).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_columns"))


def total_nulls(df: DataFrame) -> DataFrame:
    """One row (n_missing, n_columns_missing)."""
    long = null_counts(df, keep_zero=True)
    return long.agg(
        F.sum("n_missing").alias("n_missing"), F.count_if(F.col("n_missing") > 0).alias("n_columns_missing")
    )


def zero_fraction(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, zero_share): share of rows equal to zero; missing rows count in the divisor."""
    zeros = lambda c: F.try_divide(F.count_if(c == 0), F.count(F.lit(1)))
    return column_aggregate(df, cols, zeros, "zero_share")


def names_where(stats: DataFrame, condition: Column) -> list[str]:
    """Column names that meet a condition in a (name, ...) statistics table.

    Reads at most one row per column of the profiled table to the driver.
    """
    return [row["name"] for row in stats.where(condition).select("name").orderBy("name").collect()]
