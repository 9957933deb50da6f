"""One sparse matrix out of numbers, levels and terms, kept as rows (id, position, value).

Positions are handed out by rank: numbers first, then the levels of each column, then terms in word order. The list of
terms stays a table, so a vocabulary of any size reaches neither the driver nor a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import attach_by_key, key_counts, row_positions, settle


def _from(start: Column | int) -> Column:
    return start if isinstance(start, Column) else F.lit(start).cast("long")


def number_entries(df: DataFrame, numbers: Mapping[str, Column], start: int = 0) -> DataFrame:
    """(id, position, value) of the numbers that are neither zero nor missing."""
    listed = F.array(
        *[F.struct(F.lit(start + i).cast("long").alias("position"), c.cast("double").alias("value")) for i, c in enumerate(numbers.values())]
    )
    return df.select("id", F.inline(listed)).where("value <> 0")


def level_index(df: DataFrame, column: str, start: int) -> DataFrame:
    """(level, position, n): the levels of a column in order, positions from `start`; n rows have each."""
    counts = settle(key_counts(df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")), ["level"]), "levels")
    return row_positions(counts, ["level"], name="position", stored=True).withColumn("position", F.col("position") + (start - 1))


def level_entries(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """(id, position, 1) of each row's level; a level that the index lacks gives nothing."""
    rows = df.select("id", F.col(column).alias("level"))
    found = attach_by_key(rows, index, ["level"], "n", ["id"], how="inner")
    return found.select("id", "position", F.lit(1.0).alias("value"))


def term_index(vocab: DataFrame, start: int) -> DataFrame:
    """(word, doc_count, position): words in order, positions from `start`."""
    stored = settle(vocab.select("word", "doc_count"), "vocabulary")
    return row_positions(stored, ["word"], name="position", stored=True).withColumn("position", F.col("position") + (start - 1))


def term_entries(weights: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """(id, position, value) of the words that the index has; a word with many documents is spread over slices."""
    found = attach_by_key(weights, index.select("word", "doc_count", "position"), ["word"], "doc_count", ["id"], how="inner")
    return found.select("id", "position", F.col(value).cast("double").alias("value")).where("value <> 0")


def assemble(
    df: DataFrame, numbers: Mapping[str, Column], levels: Sequence[str], weights: DataFrame, vocab: DataFrame, value: str
) -> tuple[DataFrame, DataFrame]:
    """(entries (id, position, value), columns (position, name)) over numbers, levels and terms.

    `weights` is (id, word, value) and may hold words that `vocab` (word, doc_count) lacks. Zeros are not stored.
    """
    parts = [number_entries(df, numbers)]
    named = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("name")) for i, n in enumerate(numbers)])
    names = [df.sparkSession.range(1).select(F.inline(named))]
    start = len(numbers)
    for c in levels:
        index = settle(level_index(df, c, start), "index")
        parts.append(level_entries(df, c, index))
        names.append(index.select("position", F.concat(F.lit(f"{c}="), F.col("level").cast("string")).alias("name")))
        start += index.count()
    index = settle(term_index(vocab, start), "index")
    parts.append(term_entries(weights, index, value))
    names.append(index.select("position", F.col("word").alias("name")))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, names)
