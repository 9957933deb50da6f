"""Reproducible splits and folds: every choice follows from a hash of the row id and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import row_positions


def id_hash(id_: str, seed: int) -> Column:
    """Number in [0, 2^32) that depends on the id and the seed alone, not on partitioning."""
    digest = F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def random_split(df: DataFrame, id_: str, train_share: float, seed: int, name: str = "part") -> DataFrame:
    """Adds "train" / "holdout" with about `train_share` of the rows in train."""
    cut = int(train_share * 2**32)
    return df.withColumn(name, F.when(id_hash(id_, seed) < cut, "train").otherwise("holdout"))


def stratified_split(
    df: DataFrame, id_: str, strata: Sequence[str], train_share: float, seed: int, name: str = "part"
) -> DataFrame:
    """The same share of every stratum, to the row: the first ones of each in hash order."""
    hashed = df.withColumn("__hash", id_hash(id_, seed))
    placed = row_positions(hashed, ["__hash", id_], by=strata, name="__pos", total="__total")
    chosen = F.col("__pos") <= F.floor(F.col("__total") * F.lit(float(train_share)))
    return placed.withColumn(name, F.when(chosen, "train").otherwise("holdout")).drop("__hash", "__pos", "__total")


def quartile_bin(value: Column, quartiles: Column) -> Column:
    """1 to 4: which quarter of the distribution a value falls in."""
    return F.size(F.filter(quartiles, lambda q: q < value)) + 1


def kfold(df: DataFrame, id_: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Adds a fold number 0 .. k-1."""
    return df.withColumn(name, (id_hash(id_, seed) % k).cast("int"))


def tail_validation(df: DataFrame, order_by: Sequence[str], share: float, name: str = "part") -> DataFrame:
    """The last `share` of the rows in a unique order become "validation"."""
    placed = row_positions(df, order_by, name="__pos", total="__total")
    first = F.col("__total") - F.floor(F.col("__total") * F.lit(float(share)))
    return placed.withColumn(name, F.when(F.col("__pos") > first, "validation").otherwise("train")).drop(
        "__pos", "__total"
    )
