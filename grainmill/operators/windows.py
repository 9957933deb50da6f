"""Ranks, shares and group statistics attached to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.scale import (
    attach_by_key,
    quantiles_of_counts,
    same_keys,
    scalars,
    settle,
    value_counts,
)


def share_within(counts: DataFrame, by: Sequence[str], n: str = "n", name: str = "prop") -> DataFrame:
    """Share of `n` in the sum over its group, for tables already counted down to few rows per group."""
    return counts.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def top_n_ties(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """Rows among the `k` largest values of their group, ties kept. Spark drops rows that cannot be among
    them before the shuffle, so a large group costs no more than a small one."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.withColumn("__rank", F.rank().over(w)).where(F.col("__rank") <= k).drop("__rank")


def first_row_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One whole row per key combination, the first in `order_by`; null keys are equal. Every task keeps
    at most one row per key before the shuffle, so many copies of one key do not pile up."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def group_quantile(df: DataFrame, by: Sequence[str], col: str, p: float, name: str) -> DataFrame:
    """(by, name, rows): exact quantile per group and the number of rows of the group."""
    counts = settle(value_counts(df, [col], by), "counts")
    q = quantiles_of_counts(counts, [p], by).select(*by, F.element_at("q", 1).alias(name))
    sizes = counts.groupBy(*[F.col(b).alias(f"__q_{b}") for b in by]).agg(F.sum("n").alias("rows"))
    return q.join(sizes, same_keys(q, sizes, by, "__q_")).select(*by, name, "rows")


def attach_group_median(
    df: DataFrame, by: Sequence[str], col: str, name: str, spread_by: Sequence[str]
) -> DataFrame:
    """Adds the median of `col` in the row's group."""
    return attach_by_key(df, group_quantile(df, by, col, 0.5, name), by, "rows", spread_by)


def fill_group_median(df: DataFrame, by: Sequence[str], col: str, spread_by: Sequence[str]) -> DataFrame:
    """Missing values of `col` become the median of their group; a group without values stays missing."""
    filled = attach_group_median(df, by, col, "__median", spread_by)
    return filled.withColumn(col, F.coalesce(col, "__median")).drop("__median")


def tier(value: Column, low: Column, high: Column) -> Column:
    """2 above `high`, 1 between (inclusive), 0 below `low`."""
    return F.when(value > high, 2).when(value.between(low, high), 1).when(value < low, 0)


def quantile_tiers(
    df: DataFrame, by: Sequence[str], col: str, low: float = 0.2, high: float = 0.8
) -> DataFrame:
    """(by, median, rows, tier): groups tiered by their median against quantiles of that median over ROWS."""
    groups = settle(group_quantile(df, by, col, 0.5, "median"), "groups")
    counts = groups.groupBy(F.lit("median").alias("name"), F.col("median").alias("value")).agg(
        F.sum("rows").alias("n")
    )
    cut = scalars(quantiles_of_counts(settle(counts, "counts"), [low, high]))["q"]
    return groups.withColumn("__cut", cut).select(
        *by, "median", "rows", tier(F.col("median"), F.get("__cut", 0), F.get("__cut", 1)).alias("tier")
    )
