"""Transforms whose parameters come from the data."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.numeric import box_cox, box_cox_of_log, centred
from grainmill.operators.scale import quantile_row, settle, with_scalars


def by_scalars(df: DataFrame, row: DataFrame, make: Callable[[str], dict[str, Column]], cols: Sequence[str]) -> DataFrame:
    """Adds the columns `make(c)` for every c, where the one-row table is visible as struct `__s`."""
    new: dict[str, Column] = {}
    for c in cols:
        new.update(make(c))
    return with_scalars(df, row).withColumns(new).drop("__s")


def standardize(df: DataFrame, cols: Sequence[str], population: bool = False) -> DataFrame:
    """Centre and scale; sd with n - 1, or with n if `population`. Null for a constant column."""
    sd = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[sd(c).alias(f"s_{c}") for c in cols])
    return by_scalars(df, row, lambda c: {c: centred(F.col(c), F.col(f"__s.m_{c}"), F.col(f"__s.s_{c}"))}, cols)


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / IQR with exact quartiles."""
    row = quantile_row(df, cols, [0.25, 0.5, 0.75])

    def scaled(c: str) -> dict[str, Column]:
        q = F.col(f"__s.{c}")
        return {c: centred(F.col(c), F.get(q, F.lit(1)), F.get(q, F.lit(2)) - F.get(q, F.lit(0)))}

    return by_scalars(df, row, scaled, cols)


def log_if_skewed(df: DataFrame, cols: Sequence[str], limit: float = 0.75) -> DataFrame:
    """Columns with skewness above `limit`: log(x + 1) if the column holds a zero, else log(x)."""
    row = df.agg(
        *[F.skewness(F.col(c).cast("double")).alias(f"k_{c}") for c in cols],
        *[F.coalesce(F.bool_or(F.col(c) == 0), F.lit(False)).alias(f"z_{c}") for c in cols],
    )

    def logged(c: str) -> dict[str, Column]:
        x, skewed, zero = F.col(c).cast("double"), F.col(f"__s.k_{c}") > limit, F.col(f"__s.z_{c}")
        return {c: F.when(skewed & zero, F.log1p(x)).when(skewed, F.log(x)).otherwise(x)}

    return by_scalars(df, row, logged, cols)


GRID_HALF = 10


def box_cox_lambdas(df: DataFrame, cols: Sequence[str], exact: float = 2e-4, width: float = 2.0) -> DataFrame:
    """(name, lambda, llf): power per column that maximises the profile likelihood of Box-Cox on x + 1.

    Each round scores 21 powers per open column in ONE aggregate. While the best of a column is the first or last,
    its window moves there and doubles; then each round looks closer, down to steps of `exact`. Between
    rounds 25 numbers per column come to the driver. Lambda and llf of a column without two different values are null.
    The logarithms are written once, as every round reads them.
    """
    logs = settle(df.select(*[F.log1p(F.col(c).cast("double")).alias(c) for c in cols]), "logs")
    base = width / GRID_HALF
    window = {c: (0.0, base) for c in cols}
    found: dict[str, tuple[float | None, float | None]] = {}
    while window:
        powers = {c: [centre + j * step for j in range(-GRID_HALF, GRID_HALF + 1)] for c, (centre, step) in window.items()}
        sums = [x for c in powers for x in (F.sum(c), F.count(c), F.min(c), F.max(c))]
        spreads = [F.var_pop(box_cox_of_log(F.col(c), F.lit(p))) for c in powers for p in powers[c]]
        row = iter(logs.agg(*[x.alias(f"v{i}") for i, x in enumerate([*sums, *spreads])]).first())
        totals = {c: tuple(next(row) for _ in range(4)) for c in powers}
        for c, tried in powers.items():
            (total, n, low, high), variances = totals[c], [next(row) for _ in tried]
            scored = [((p - 1) * total - n / 2 * math.log(v), i) for i, (p, v) in enumerate(zip(tried, variances)) if low != high and v and 0 < v < math.inf]
            if not scored:
                found[c] = None, None
                del window[c]
                continue
            llf, i = max(scored)
            step = window[c][1]
            if i in (0, 2 * GRID_HALF) and step >= base:
                window[c] = tried[i], 2 * step
            elif step <= exact * 1.001:
                found[c] = tried[i], llf
                del window[c]
            else:
                window[c] = tried[i], max(step / 8, base) if step > base else step / GRID_HALF
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in cols], "name string, lambda double, llf double")


def box_cox_fit_apply(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column transformed with its own best power."""
    fitted = box_cox_lambdas(df, cols)
    row = fitted.agg(*[F.max(F.when(F.col("name") == c, F.col("lambda"))).alias(c) for c in cols])
    return by_scalars(df, row, lambda c: {c: box_cox(F.col(c) + 1, F.col(f"__s.{c}"))}, cols)


def interactions(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Products of every left column with every right column, named `<left>_x_<right>`."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a in left for b in right})
