"""Linear models from sums of products: one scan of the rows, whatever the number of penalties, mixtures and folds.

The rows are read once. Every task multiplies its batches into one matrix of sums per fold; the matrices of all
tasks are added up row by row. The sums of a training set are those of all folds but one, so that the coefficients of
every grid point on every training set, and its error on the fold left out, follow from the sums alone. Sizes are
set by the number of columns: a task holds one matrix per fold, a solver the matrices of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.joins import level_row
from grainmill.operators.scale import scalars, settle, with_scalars
from grainmill.session import share_code

#: A column whose variance is this small a share of its mean square is constant.
CONSTANT = 1e-12
MOST_SWEEPS = 20_000
#: A sweep that moves no standardised coefficient by more than this share of the target's deviation is the last.
TOLERANCE = 1e-13
#: The training set of all folds.
ALL = -1


def dummies(train: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """0/1 columns for the levels that `train` has, but the first in order of each column."""
    row = level_row(train, columns).first()
    return {
        f"{c}_{level}": F.coalesce(F.col(f"`{c}`") == F.lit(level), F.lit(False)).cast("double")
        for c in columns
        for level in row[c][1:]
    }


def cross_sums(df: DataFrame, columns: Sequence[Column], by: str | None = None, checked: bool = True) -> DataFrame:
    """(fold, i, sums): row i of the sums of products of 1 and `columns`, per value of the integer column `by`.

    Missing values raise, or become NaN if not `checked`. A task sends one row per fold and column, so the shuffle does
    not grow with the rows.
    """
    share_code(df.sparkSession)
    width = len(columns) + 1
    fold = F.col(by).cast("int") if by else F.lit(0)
    rows = df.select(fold.alias("fold"), F.array(F.lit(1.0), *[c.cast("double") for c in columns]).alias("x"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if checked and np.isnan(x).any():
                raise ValueError("missing values in the columns of a linear model: impute first")
            for f in np.unique(folds):
                own = x[folds == f]
                sums[int(f)] = sums.get(int(f), 0) + own.T @ own
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(total))],
                names=["fold", "i", "sums"],
            )

    parts = rows.mapInArrow(multiply, "fold int, i int, sums array<double>")
    added = parts.groupBy("fold", "i").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return added.select("fold", "i", vector_to_array("sums").alias("sums"))


def descend(g: np.ndarray, c: np.ndarray, l1: float, l2: float, b: np.ndarray, scale: float) -> np.ndarray:
    """Coordinate descent on b'gb/2 - c'b + l1 |b| + l2 b'b/2 from `b`, until a sweep changes nothing to speak of."""
    b, rest = b.copy(), c - g @ b
    for _ in range(MOST_SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(np.diag(g) > 0):
            z = rest[j] + g[j, j] * b[j]
            step = np.sign(z) * max(abs(z) - l1, 0.0) / (g[j, j] + l2) - b[j]
            if step:
                b[j] += step
                rest -= g[:, j] * step
                moved = max(moved, abs(step))
        if moved <= TOLERANCE * scale:
            break
    return b


def path_of(sums: np.ndarray, held: np.ndarray, penalties: Sequence[float], mix: float) -> list[dict]:
    """Coefficients for each penalty, from the largest down, on a training set; errors on the sums `held`.

    Columns are standardised with the set's own means and deviations and the penalty applies to that scale:
    squared error / 2n + penalty * (mix * |b| + (1 - mix) / 2 * b'b). Coefficients come back on the scale of the columns.
    """
    n = sums[0, 0]
    means = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(means, means)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0))
    flat = deviation**2 <= CONSTANT * np.diag(sums)[1:] / n
    unit = np.where(flat, 1.0, deviation)[:-1]
    g = spread[:-1, :-1] / np.outer(unit, unit)
    c = spread[:-1, -1] / unit
    g[flat[:-1]] = g[:, flat[:-1]] = 0
    c[flat[:-1]] = 0
    b, out = np.zeros(len(c)), []
    for penalty in sorted(penalties, reverse=True):
        if mix == 0 and penalty > 0:  # the equations are linear
            b = np.linalg.solve(g + penalty * np.eye(len(c)), c)
        else:
            b = descend(g, c, penalty * mix, penalty * (1 - mix), b, float(deviation[-1]))
        coefficients = b / unit
        intercept = means[-1] - means[:-1] @ coefficients
        v = np.concatenate([[intercept], coefficients, [-1.0]])
        error = float(v @ held @ v)
        out.append({"penalty": penalty, "intercept": float(intercept), "coefficients": coefficients, "squares": max(error, 0.0)})
    return out


PATHS = "training int, mix double, penalty double, intercept double, coefficients array<double>, n double, squares double"


def penalty_paths(
    train: DataFrame, columns: Sequence[Column], target: Column, fold: str, folds: int,
    penalties: Sequence[float], mixes: Sequence[float],
) -> DataFrame:
    """(training, mix, penalty, intercept, coefficients, n, squares) of every grid point on every training set.

    `training` is the fold left out (0 .. folds - 1) or ALL; `n` and `squares` are the rows and the squared error of
    that fold, of all rows for ALL. One scan of `train`; each path of penalties is solved by a task of its own.
    A training set without rows has no path.
    """
    sums = cross_sums(train, [*columns, target], fold)
    wanted = F.array(
        *[F.struct(F.lit(t).alias("training"), F.lit(float(m)).alias("mix")) for t in (ALL, *range(folds)) for m in mixes]
    )
    dealt = settle(sums, "sums").select("*", F.explode(wanted).alias("p")).select("fold", "i", "sums", "p.*")
    penalties = [float(p) for p in penalties]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        training, mix = int(part["training"].iloc[0]), float(part["mix"].iloc[0])
        width = len(part["sums"].iloc[0])
        each = {f: np.zeros((width, width)) for f in part["fold"].unique()}
        for f, i, row in zip(part["fold"], part["i"], part["sums"]):
            each[f][i] = row
        whole = sum(each.values())
        held = whole if training == ALL else each.get(training, np.zeros((width, width)))
        own = whole if training == ALL else whole - held
        found = path_of(own, held, penalties, mix) if own[0, 0] > 0.5 else []
        return pd.DataFrame(
            [{"training": training, "mix": mix, "n": held[0, 0], **x} for x in found],
            columns=[x.split()[0] for x in PATHS.split(", ")],
        )

    return dealt.groupBy("training", "mix").applyInPandas(solve, PATHS)


def grid_errors(paths: DataFrame) -> DataFrame:
    """(mix, penalty, mean, sd, best): root mean squared error over the folds; among means equal in nine places the largest
    penalty, then the largest mixture, is best."""
    root = F.sqrt(F.col("squares") / F.col("n"))
    each = paths.where((F.col("training") != ALL) & (F.col("n") > 0))
    errors = each.groupBy("mix", "penalty").agg(F.avg(root).alias("mean"), F.stddev_samp(root).alias("sd"))
    first = scalars(errors.agg(F.min_by(F.struct("mix", "penalty"), F.struct(F.round("mean", 9), -F.col("penalty"), -F.col("mix"))).alias("p")))["p"]
    return errors.withColumn("best", (F.col("mix") == first["mix"]) & (F.col("penalty") == first["penalty"]))


def chosen_fit(paths: DataFrame) -> DataFrame:
    """One row (mix, penalty, intercept, coefficients): the best grid point, fitted on all training rows."""
    best = grid_errors(paths).where("best").select(F.col("mix").alias("m"), F.col("penalty").alias("p"))
    whole = paths.where(F.col("training") == ALL)
    hit = whole.join(F.broadcast(best), (F.col("mix") == F.col("m")) & (F.col("penalty") == F.col("p")))  # one row
    return hit.select("mix", "penalty", "intercept", "coefficients")


def with_linear_value(df: DataFrame, fit: DataFrame, columns: Sequence[Column], name: str = "prediction") -> DataFrame:
    """Adds the value that a one-row table (intercept, coefficients) gives each row of `df`."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    marked = with_scalars(df, fit.select("intercept", "coefficients"), "__fit")
    terms = F.zip_with(F.array(*[c.cast("double") for c in columns]), "__fit.coefficients", lambda x, b: x * b)
    return marked.select(*kept, (F.col("__fit.intercept") + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).alias(name))


def tuned(
    train: DataFrame, columns: Sequence[Column], target: Column, fold: str, folds: int,
    penalties: Sequence[float], mixes: Sequence[float],
) -> tuple[DataFrame, DataFrame]:
    """(grid errors, one-row table (mix, penalty, intercept, coefficients) of the best point, fitted on all rows)."""
    paths = settle(penalty_paths(train, columns, target, fold, folds, penalties, mixes), "paths")
    return grid_errors(paths), settle(chosen_fit(paths), "fit")


def coefficient_table(fit: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, coefficient), one row per column of a fit."""
    listed = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.col("coefficients").alias("coefficient"))
    return fit.select(F.inline(listed))


def penalty_grid(low: float, high: float, levels: int) -> list[float]:
    """`levels` penalties evenly spaced in their decimal logarithm."""
    return [10.0 ** (low + (high - low) * i / (levels - 1)) for i in range(levels)]
