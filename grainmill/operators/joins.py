"""Lookups, filters by another table, grids, side-by-side tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import attach_by_key, key_counts


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Natural left join to the distinct rows of `table`; a key it lacks gives nulls, a null key matches nothing.

    The keys of `df` are counted first. A small table is broadcast; beyond that, rows of a frequent key are spread over
    slices (`attach_by_key`), each of which meets all of the table's rows of that key.
    """
    payload = [c for c in table.columns if c != key]
    found = table.where(F.col(key).isNotNull()).distinct().groupBy(key)
    found = found.agg(F.collect_list(F.struct(*payload)).alias("__rows"))
    stats = found.join(key_counts(df.where(F.col(key).isNotNull()), [key], "__n"), key)
    own = [c for c in df.columns if c != key]
    joined = attach_by_key(df, stats, [key], "__n", df.columns)
    rows = joined.select(key, *own, F.explode_outer("__rows").alias("__row"))
    return rows.select(key, *own, *[F.col(f"__row.{c}").alias(c) for c in payload])


def keep_ids(df: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    """Rows whose id occurs in `ids`."""
    return df.join(ids.select(id_), id_, "left_semi")


def level_row(df: DataFrame, cols: Sequence[str], most: int = 10_000) -> DataFrame:
    """One row with the sorted distinct values of each column, for columns of few levels; a column with
    more than `most` levels raises, and no task collects more than `most + 1` of them."""

    def levels(c: str) -> DataFrame:
        some = df.where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1)
        found = some.agg(F.sort_array(F.collect_list(c)).alias(c))
        kind = found.schema[c].dataType
        error = F.raise_error(F.lit(f"{c} has more than {most} levels")).cast(kind)
        return found.select(F.when(F.size(c) <= most, F.col(c)).otherwise(error).alias(c))

    return df.sparkSession.range(1).select(*[levels(c).scalar().alias(c) for c in cols])


def expand_grid(values: DataFrame) -> DataFrame:
    """All combinations of the value lists in a one-row table of arrays, one column per list."""
    out = values
    for c in values.columns:
        rest = [x for x in out.columns if x != c]
        out = out.select(*rest, F.explode(c).alias(c))
    return out.select(*values.columns)


def value_lists(df: DataFrame, lists: Mapping[str, Sequence]) -> DataFrame:
    """Adds array columns with fixed values to a one-row table."""
    return df.withColumns({k: F.array(*[F.lit(x) for x in v]) for k, v in lists.items()})


def bind_columns(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """Columns of two tables side by side, matched on the row id."""
    return left.join(right, id_)


def attach_group_stat(
    df: DataFrame, by: Sequence[str], stats: DataFrame, weight: str, spread_by: Sequence[str]
) -> DataFrame:
    """Group statistics (one row per group, with its row count `weight`) on every row of the group."""
    return attach_by_key(df, stats, by, weight, spread_by)
