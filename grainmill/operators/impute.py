"""Filling missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.columns import columns_of_type
from grainmill.operators.scale import attach_by_key, key_counts, modes, quantile_row, same_keys, settle, with_scalars


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def fill_all_strings(df: DataFrame, value: str = "None") -> DataFrame:
    return df.na.fill(value, subset=columns_of_type(df, "string"))


def fill_from_row(df: DataFrame, row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values of each column become the value of the same column in a one-row table."""
    new = {c: F.coalesce(F.col(c).cast(row.schema[c].dataType), F.col(f"__s.{c}")) for c in cols}
    return with_scalars(df, row).withColumns(new).drop("__s")


def mode_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mode of every column, in the column's own type."""
    long = modes(df, cols)
    return long.agg(
        *[F.max(F.when(F.col("name") == c, F.col("value"))).cast(df.schema[c].dataType).alias(c) for c in cols]
    )


def median_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    q = quantile_row(df, cols, [0.5])
    return q.select(*[F.get(c, F.lit(0)).alias(c) for c in cols])


def mean_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def fill_mode_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_from_row(df, mode_row(df, cols), cols)


def fill_median_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_from_row(df, median_row(df, cols), cols)


def fill_mean_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return fill_from_row(df, mean_row(df, cols), cols)


def fill_mode_group(df: DataFrame, by: Sequence[str], col: str, spread_by: Sequence[str]) -> DataFrame:
    """Missing values become the mode of their group (null keys form a group); a group without any value
    stays missing."""
    best = modes(df, [col], by).select(*by, F.col("value").alias("__mode"))
    sizes = key_counts(df.select(*[F.col(b).alias(f"__g_{b}") for b in by]), [f"__g_{b}" for b in by], "__n")
    stats = best.join(sizes, same_keys(best, sizes, by, "__g_")).select(*by, "__mode", "__n")
    joined = attach_by_key(df, stats, by, "__n", spread_by)
    return joined.withColumn(col, F.coalesce(col, F.col("__mode").cast(df.schema[col].dataType))).drop("__mode")


def fill_from_column(df: DataFrame, col: str, other: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(col, other))


def fill_line(df: DataFrame, col: str, x: str, rounded: bool = False) -> DataFrame:
    """Missing values become the prediction of a straight line on one other column."""
    fit = df.agg(F.regr_slope(col, x).alias("b"), F.regr_intercept(col, x).alias("a"))
    marked = with_scalars(df, fit)
    guess: Column = F.col("__s.a") + F.col("__s.b") * F.col(x)
    return marked.withColumn(col, F.coalesce(col, F.bround(guess, 0) if rounded else guess)).drop("__s")


def fill_regression(df: DataFrame, col: str, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Missing values become the prediction of a linear model on several columns, fitted on the rows
    that have a value. Predictor values must be present. Every level has its own column and takes the place
    of the intercept; a level not seen among the known rows adds nothing."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    index = [f"__i_{c}" for c in categories]
    dummy = [f"__d_{c}" for c in categories]
    stages = []
    if categories:
        stages += [
            StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=dummy),
        ]
    stages += [
        VectorAssembler(inputCols=[*numeric, *dummy], outputCol="__x"),
        LinearRegression(featuresCol="__x", labelCol=col, predictionCol="__guess",
                         fitIntercept=not categories, regParam=0.0, tol=1e-10, maxIter=500),
    ]
    known = settle(df.where(F.col(col).isNotNull()).select(col, *numeric, *categories), "known")
    model = Pipeline(stages=stages).fit(known)
    done = model.transform(df)
    return done.withColumn(col, F.coalesce(col, "__guess")).select(*df.columns)
