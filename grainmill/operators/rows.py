"""Filters, positions, orders, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import attach_by_key, key_counts, row_positions


def drop_where(df: DataFrame, test: Column, keep_null: bool) -> DataFrame:
    """Drops rows that meet `test`; `keep_null` says whether rows where it is missing stay."""
    return df.where(~F.coalesce(test, F.lit(False)) if keep_null else ~test)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def filter_group_size(df: DataFrame, keys: Sequence[str], more_than: int, spread_by: Sequence[str]) -> DataFrame:
    """Rows whose key has more than `more_than` rows. Frequent keys are the ones that stay, so the join
    back is spread by `spread_by`."""
    frequent = key_counts(df, keys, "__n").where(F.col("__n") > more_than)
    return attach_by_key(df, frequent, keys, "__n", spread_by, how="inner")


def slice_rows(
    df: DataFrame,
    order_by: Sequence[str],
    keep: Sequence[tuple[int, int]] | None = None,
    drop: Sequence[tuple[int, int]] | None = None,
    name: str = "pos",
) -> DataFrame:
    """Rows in (or outside) inclusive 1-based position ranges of a unique ascending order."""
    placed = row_positions(df, order_by, name=name)
    inside = [F.col(name).between(a, b) for a, b in (keep or drop or [])]
    test = reduce(lambda a, b: a | b, inside)
    return placed.where(test if keep else ~test)


def order_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Sort by (column, "asc" | "desc") pairs, missing values last either way."""
    marks = {"asc": F.asc_nulls_last, "desc": F.desc_nulls_last}
    return df.orderBy(*[marks[way](col) for col, way in keys])


def top_k(df: DataFrame, k: int, *keys: tuple[str, str]) -> DataFrame:
    return order_by(df, *keys).limit(k)


def levels_by_first(df: DataFrame, level: str, value: str) -> DataFrame:
    """(level, best, place): levels in the order they first appear when sorted by `value` descending."""
    best = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.max(value).alias("best"))
    ordered = best.withColumn("__neg", -F.col("best"))
    return row_positions(ordered, ["__neg", level], name="place").drop("__neg")


def stack(*tables: DataFrame) -> DataFrame:
    """Union by column name; absent columns become missing, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
