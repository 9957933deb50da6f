"""Steps of a preprocessing recipe.

Every step is a Spark ML estimator or transformer, so a recipe is a `pyspark.ml.Pipeline`: `fit(train)` learns
all parameters in order from the training rows alone, `transform(new)` applies them. A step that learns runs
one aggregate over the training rows; the small result is written, so later steps do not repeat it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.encode import level_position
from grainmill.functions.numeric import box_cox, centred
from grainmill.operators import impute, profile, reshape, transforms
from grainmill.operators.columns import columns_by_name
from grainmill.operators.scale import (
    attach_by_key,
    key_counts,
    row_positions,
    scalars,
    settle,
    value_counts,
)
from grainmill.operators.windows import top_n_ties


class Apply(Transformer):
    """A step without parameters of its own: any function of a table."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)


class Fitted(Model):
    """What a learnt step does to new rows; `parameters` is a small written table, a list or a dict."""

    def __init__(self, function: Callable[[DataFrame], DataFrame], parameters=None):
        super().__init__()
        self.function = function
        self.parameters = parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)


class Learn(Estimator):
    """A step that turns training rows into a `Fitted`."""

    def __init__(self, learn: Callable[[DataFrame], Fitted]):
        super().__init__()
        self.learn = learn

    def _fit(self, dataset: DataFrame) -> Fitted:
        return self.learn(dataset)


def remove(*cols: str) -> Apply:
    return Apply(lambda df: df.drop(*cols))


def mutate(**new: Column) -> Apply:
    return Apply(lambda df: df.withColumns(new))


def fill_constant(values: Mapping[str, object]) -> Apply:
    return Apply(lambda df: impute.fill_constant(df, values))


def ordinal_score(levels: Sequence[str], *cols: str) -> Apply:
    return Apply(lambda df: df.withColumns({c: level_position(F.col(c), levels) for c in cols}))


def interact(left: str, right: str) -> Apply:
    """Products of all columns whose names match the two patterns."""
    return Apply(
        lambda df: transforms.interactions(df, columns_by_name(df, matches=left), columns_by_name(df, matches=right))
    )


def keep_type(*_: str) -> Apply:
    """Text and factor are one type here, so conversions between them change nothing."""
    return Apply(lambda df: df)


def _row_step(make_row, apply_row) -> Learn:
    def learn(train: DataFrame) -> Fitted:
        row = settle(make_row(train), "parameters")
        return Fitted(lambda df: apply_row(df, row), row)

    return Learn(learn)


def fill_mode(*cols: str) -> Learn:
    return _row_step(lambda d: impute.mode_row(d, cols), lambda d, row: impute.fill_from_row(d, row, cols))


def fill_median(*cols: str) -> Learn:
    return _row_step(lambda d: impute.median_row(d, cols), lambda d, row: impute.fill_from_row(d, row, cols))


def fill_mean(*cols: str) -> Learn:
    return _row_step(lambda d: impute.mean_row(d, cols), lambda d, row: impute.fill_from_row(d, row, cols))


def normalize(*cols: str) -> Learn:
    """Centre and scale with the mean and sd (n - 1) of the training rows."""

    def make(d: DataFrame) -> DataFrame:
        return d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])

    def put(d: DataFrame, row: DataFrame) -> DataFrame:
        return transforms.by_scalars(
            d, row, lambda c: {c: centred(F.col(c), F.col(f"__s.m_{c}"), F.col(f"__s.s_{c}"))}, cols
        )

    return _row_step(make, put)


def box_cox_step(*cols: str) -> Learn:
    """Box-Cox of 1 + x with the best power per column."""

    def make(d: DataFrame) -> DataFrame:
        found = transforms.box_cox_lambdas(d, cols)
        return found.agg(*[F.max(F.when(F.col("name") == c, F.col("lambda"))).alias(c) for c in cols])

    def put(d: DataFrame, row: DataFrame) -> DataFrame:
        return transforms.by_scalars(d, row, lambda c: {c: box_cox(F.col(c) + 1, F.col(f"__s.{c}"))}, cols)

    return _row_step(make, put)


class LogColumn:
    """log(x + offset) and its inverse, kept together so that one cannot be used without the other."""

    def __init__(self, col: str, offset: float = 0.0):
        self.col, self.offset = col, offset

    def step(self) -> Apply:
        return Apply(lambda df: df.withColumn(self.col, F.log(F.col(self.col) + self.offset)))

    def inverse(self, estimate: Column) -> Column:
        return F.exp(estimate) - self.offset


def frequent_levels(train: DataFrame, col: str, threshold: float) -> DataFrame:
    """(level, n) of levels with at least `threshold` rows, or that share of the rows if below 1."""
    counts = settle(key_counts(train.where(F.col(col).isNotNull()), [col], "__n"), "levels")
    if threshold >= 1:
        return counts.where(F.col("__n") >= threshold)
    total = scalars(counts.agg(F.sum("__n").alias("t")))["t"]
    return counts.where(F.col("__n") >= total * F.lit(float(threshold)))


def lump_rare(col: str, threshold: float, spread_by: Sequence[str], other: str = "other") -> Learn:
    """Rare and unseen levels become `other`; missing stays missing."""

    def learn(train: DataFrame) -> Fitted:
        kept = settle(frequent_levels(train, col, threshold).withColumn("__kept", F.lit(True)), "levels")

        def put(df: DataFrame) -> DataFrame:
            joined = attach_by_key(df, kept, [col], "__n", spread_by)
            text = F.col(col).cast("string")
            level = F.when(F.col(col).isNull() | F.col("__kept"), text).otherwise(F.lit(other))
            return joined.withColumn(col, level).drop("__kept")

        return Fitted(put, kept)

    return Learn(learn)


def one_hot(*cols: str, drop_first: bool = False) -> Learn:
    """0/1 columns for the levels seen in training."""

    def learn(train: DataFrame) -> Fitted:
        levels = {c: reshape.learn_levels(train, c) for c in cols}

        def put(df: DataFrame) -> DataFrame:
            for c in cols:
                df = reshape.one_hot(df, c, levels[c], drop_first)
            return df

        return Fitted(put, levels)

    return Learn(learn)


def label_encode(col: str, spread_by: Sequence[str]) -> Learn:
    """0-based code of a level in sorted order; unseen levels give null."""

    def learn(train: DataFrame) -> Fitted:
        levels = key_counts(train.where(F.col(col).isNotNull()), [col], "__n")
        coded = settle(row_positions(levels, [col], name="__code"), "levels")

        def put(df: DataFrame) -> DataFrame:
            joined = attach_by_key(df, coded, [col], "__n", spread_by)
            return joined.withColumn(col, (F.col("__code") - 1).cast("int")).drop("__code")

        return Fitted(put, coded)

    return Learn(learn)


def variance_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, n_distinct, freq_ratio, distinct_share): most frequent value over the second, and the share of
    distinct values, missing values left out. Only two values per column cross the final shuffle."""
    counts = settle(
        value_counts(df, cols, type_="string").where(F.col("value").isNotNull()).select("name", "value", "n"), "counts"
    )
    totals = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("rows"))
    # ties at the top: the second value is as frequent as the first, so any two of them will do
    per_size = counts.groupBy("name", "n").agg(F.count(F.lit(1)).alias("k"))
    top = top_n_ties(per_size, ["name"], "n", 2)
    best = top.groupBy(F.col("name").alias("__name")).agg(
        F.max("n").alias("first"), F.min("n").alias("low"), F.max_by("k", "n").alias("ties"), F.count("n").alias("sizes")
    )
    second = F.when(F.col("ties") > 1, F.col("first")).when(F.col("sizes") > 1, F.col("low"))
    return totals.join(best, totals["name"] == best["__name"]).select(
        "name",
        "n_distinct",
        F.try_divide(F.col("first"), second).alias("freq_ratio"),
        (F.col("n_distinct") / F.col("rows")).alias("distinct_share"),
    )


def near_zero(ratio: float = 95 / 5, share: float = 0.1) -> Column:
    """Condition on a variance report: a single value, or one value that dwarfs the others."""
    return (F.col("n_distinct") == 1) | ((F.col("freq_ratio") > ratio) & (F.col("distinct_share") <= share))


def drop_near_zero_variance(*cols: str) -> Learn:
    def learn(train: DataFrame) -> Fitted:
        gone = profile.names_where(variance_report(train, cols or train.columns), near_zero())
        return Fitted(lambda df: df.drop(*gone), gone)

    return Learn(learn)


def drop_sparse(cols: Sequence[str], limit: float = 0.9994) -> Learn:
    """Drops columns in which more than `limit` of the training rows are zero."""

    def learn(train: DataFrame) -> Fitted:
        gone = profile.names_where(profile.zero_fraction(train, cols), F.col("zero_share") > limit)
        return Fitted(lambda df: df.drop(*gone), gone)

    return Learn(learn)

