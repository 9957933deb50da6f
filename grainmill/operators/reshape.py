"""Long and wide forms, level columns, complete grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.columns import clean_name
from grainmill.operators.joins import level_row
from grainmill.operators.scale import with_scalars


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), type_: str = "string") -> DataFrame:
    """(ids, name, value): one row per cell of `cols`, missing cells kept, all cast to one type."""
    narrow = df.select(*ids, *[F.col(f"`{c}`").cast(type_).alias(c) for c in cols])
    return narrow.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in cols], "name", "value")


def complete_counts(counts: DataFrame, level: str, key: str, n: str = "n") -> DataFrame:
    """Adds the absent (level, key) combinations with a count of 0, for a `level` of few values.

    The levels travel as one array; each key keeps its counts in a map and is exploded over the array.
    """
    levels = level_row(counts, [level])
    per_key = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(level, n))).alias("__m")
    )
    grid = with_scalars(per_key, levels, "__l").select(key, "__m", F.explode(f"__l.{level}").alias(level))
    return grid.select(level, key, F.coalesce(F.try_element_at("__m", F.col(level)), F.lit(0)).alias(n))


def learn_levels(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """Sorted distinct values of a column of few levels. At most `most + 1` values reach the driver."""
    seen = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string")).distinct().limit(most + 1).collect()
    if len(seen) > most:
        raise ValueError(f"{col} has more than {most} levels")
    return sorted(row[0] for row in seen)


def one_hot(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = False) -> DataFrame:
    """One 0/1 column per level, named `<col>_<level>`; a missing or unknown value gives zeros."""
    kept = list(levels)[1:] if drop_first else list(levels)
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return df.withColumns({f"{col}_{clean_name(v)}": (text == F.lit(v)).cast("int") for v in kept}).drop(col)


def pivot_counts(counts: DataFrame, words: Sequence[str], id_: str = "id", word: str = "word", n: str = "n") -> DataFrame:
    """(id, one column per listed word) from a long table of counts; absent words count 0."""
    listed = counts.where(F.col(word).isin(list(words)))
    return listed.groupBy(id_).agg(
        *[F.sum(F.when(F.col(word) == w, F.col(n)).otherwise(0)).alias(w) for w in words]
    )
