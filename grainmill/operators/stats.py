"""Grouped summaries, shape statistics, correlation, histograms, densities, distribution points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.numeric import normal_kernel, normal_quantile
from grainmill.operators.linear import cross_sums
from grainmill.operators.profile import column_aggregate
from grainmill.operators.scale import (
    attach_by_key,
    exact_quantiles,
    key_counts,
    modes,
    quantile_row,
    quantiles_of_counts,
    row_positions,
    running_weight,
    scalars,
    settle,
    value_counts,
    with_scalars,
)

#: Columns whose products one scan sums up.
BLOCK = 256


def group_summary(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, mean, sd, sum) of one column; missing values are skipped."""
    return df.groupBy(*by).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.sum(col).alias("sum")
    )


def share_of_total(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, sum, prop): group sum and its share of the grand total."""
    sums = df.groupBy(*by).agg(F.sum(col).alias("sum"))
    total = scalars(df.agg(F.sum(col).alias("t")))["t"]
    return sums.withColumn("prop", F.try_divide(F.col("sum"), total))


def count_sorted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_counts(df, keys).orderBy(F.desc("n"), *keys)


def five_number(df: DataFrame, col: str) -> DataFrame:
    """One row (min, q1, median, mean, q3, max)."""
    ends = df.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))
    q = scalars(quantile_row(df, [col], [0.25, 0.5, 0.75]))[col]
    return ends.withColumn("__q", q).select(
        "min", F.get("__q", 0).alias("q1"), F.get("__q", 1).alias("median"), "mean", F.get("__q", 2).alias("q3"), "max"
    )


def group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """(by, q): array of exact quantiles per group."""
    return exact_quantiles(df, [col], probs, by).select(*by, "q")


def group_mode(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, value, n): most frequent value per group, the smallest on a tie."""
    return modes(df, [col], by).select(*by, "value", "n")


def skewness_scan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, skew): population skewness of every column in one pass."""
    return column_aggregate(df, cols, lambda c: F.skewness(c.cast("double")), "skew")


def skewness_adjusted(df: DataFrame, col: str) -> DataFrame:
    """One row (n, skew): skewness with the small-sample correction; null below three values."""
    base = df.agg(F.count(col).cast("double").alias("n"), F.skewness(col).alias("s"))
    n = F.col("n")
    return base.select(
        n.cast("long").alias("n"),
        F.when(n > 2, F.col("s") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"),
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; null if either is constant."""
    a, b = a.cast("double"), b.cast("double")
    a2, b2 = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a2) * F.stddev_samp(b2))


def corr_matrix(df: DataFrame, cols: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(x, y, r): lower triangle without diagonal, each pair over the rows where both are present.

    Every column becomes three: presence, deviation from the column's mean (0 where missing) and its square. Their sums of
    products hold all that a pair needs, and one scan sums them, matrix by matrix and not pair by pair. More than `block`
    columns are taken in blocks: each pair of blocks is one scan that reads its own columns alone.
    """
    if len(cols) < 2:
        raise ValueError("a correlation matrix needs two columns")
    means = df.agg(*[F.avg(c).alias(c) for c in cols])
    marked = with_scalars(df.select(*cols), means, "__mean")
    pieces = [list(cols[i : i + block]) for i in range(0, len(cols), block)]
    pairs = [_block_correlations(marked, a, None) for a in pieces if len(a) > 1]
    pairs += [_block_correlations(marked, a, b) for a, b in combinations(pieces, 2)]
    return reduce(DataFrame.unionByName, pairs)


def _block_correlations(marked: DataFrame, first: Sequence[str], second: Sequence[str] | None) -> DataFrame:
    """(x, y, r) of the pairs inside one block of columns, or of those with one column in each of two."""
    cols = [*first, *(second or ())]
    parts = []
    for c in cols:
        away = F.col(c).cast("double") - F.col(f"__mean.{c}")
        parts += [F.col(c).isNotNull().cast("double"), F.coalesce(away, F.lit(0.0)), F.coalesce(away * away, F.lit(0.0))]
    sums = cross_sums(marked, parts, checked=False).where("i > 0")
    kinds = sums.select(
        F.floor((F.col("i") - 1) / 3).alias("x"), ((F.col("i") - 1) % 3).alias("kind"), F.expr("slice(sums, 2, size(sums) - 1)").alias("s")
    )
    named = [F.max(F.when(F.col("kind") == k, F.col("s"))).alias(n) for k, n in enumerate(("present", "away", "square"))]
    later = F.sequence(F.lit(0), F.lit(len(first) - 1) if second else F.col("x").cast("int") - 1)
    rows = kinds.groupBy("x").agg(*named).where(F.col("x") >= (len(first) if second else 1))
    rows = rows.select("*", F.explode(later).alias("y"))
    at = lambda col, kind: F.get(col, F.col("y") * 3 + kind)
    n, a, b = at("present", 0), at("away", 0), at("present", 1)
    aa, bb, ab = at("square", 0), at("present", 2), at("away", 1)

    def spread(total: Column, squares: Column) -> Column:
        """Squared deviations from the mean over the rows of the pair; null for a constant."""
        left = squares - total * total / n
        return F.when(left > squares * 1e-12, left)

    value = (ab - a * b / n) / F.sqrt(spread(a, aa) * spread(b, bb))
    name = F.array(*[F.lit(c) for c in cols])
    return rows.select(
        F.get(name, F.col("x").cast("int")).alias("x"), F.get(name, "y").alias("y"), F.when(n > 0, value).alias("r")
    )


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str, k: int, weakest: bool = True) -> DataFrame:
    """(name, r): the `k` lowest (or highest) correlations with one column."""
    long = column_aggregate(df, cols, lambda c: correlation(c, F.col(target)), "r")
    return long.orderBy(F.asc_nulls_last("r") if weakest else F.desc_nulls_last("r"), "name").limit(k)


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value): one row per distinct value of each column, as text."""
    return value_counts(df, cols, type_="string").select("name", "value")


def range_row(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def bin_number(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based bin of `bins` equal parts of [lo, hi], the last one closed."""
    place = F.floor(F.try_divide(v - lo, hi - lo) * bins) + 1
    return F.when(v.isNotNull(), F.least(F.coalesce(place, F.lit(1)), F.lit(bins))).cast("int")


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, lo, hi, n): counts in equal-width bins over the range of the whole table."""
    marked = with_scalars(df.select(*by, F.col(col).cast("double").alias("v")), range_row(df, col))
    lo, hi = F.col("__s.lo"), F.col("__s.hi")
    placed = marked.select(*by, "__s", bin_number(F.col("v"), lo, hi, bins).alias("bin")).where("bin is not null")
    width = (hi - lo) / bins
    return placed.groupBy(*by, "bin", "__s").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (lo + width * (F.col("bin") - 1)).alias("lo"), (lo + width * F.col("bin")).alias("hi"), "n"
    )


def density_estimate(df: DataFrame, col: str, by: Sequence[str], bins: int = 100, points: int = 64) -> DataFrame:
    """(by, point, x, density): Gaussian kernel density on a grid over the range of the table.

    The kernel runs over bins, not rows: each group carries at most `bins` (middle, count) pairs.
    Bandwidth is 0.9 min(sd, IQR / 1.34) n^-0.2 of the group.
    """
    binned = histogram(df, col, bins, by)
    parts = binned.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(((F.col("lo") + F.col("hi")) / 2).alias("mid"), "n"))).alias("parts"),
        F.sum("n").alias("n"),
    )
    spread = df.groupBy(*[F.col(b).alias(f"__b_{b}") for b in by]).agg(F.stddev_samp(col).alias("sd"))
    q = group_quantiles(df, by, col, [0.25, 0.75]).select(*[F.col(b).alias(f"__c_{b}") for b in by], "q")
    for other, prefix in ((spread, "__b_"), (q, "__c_")):
        match = F.lit(True)
        for b in by:
            match = match & parts[b].eqNullSafe(other[prefix + b])
        parts = parts.join(other, match)
    iqr = F.get("q", 1) - F.get("q", 0)
    h = F.least(F.col("sd"), iqr / 1.34) * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = with_scalars(parts.withColumn("h", h), range_row(df, col)).select(
        *by, "parts", "n", "h", "__s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    x = F.col("__s.lo") + (F.col("__s.hi") - F.col("__s.lo")) * F.col("point") / (points - 1)
    grid = grid.withColumn("x", x)
    total = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda acc, p: acc + p["n"] * normal_kernel(F.try_divide(F.col("x") - p["mid"], F.col("h"))),
    )
    return grid.select(*by, "point", "x", F.try_divide(total, F.col("n") * F.col("h")).alias("density"))


def boxplot_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, q1, median, q3, low, high, n_outliers): whiskers end at the last value within 1.5 IQR.

    Works on the counted values, so the rows are read once.
    """
    counts = settle(value_counts(df, [col], by).where(F.col("value").isNotNull()), "counts")
    q = quantiles_of_counts(counts, [0.25, 0.5, 0.75], by)
    q1, q3 = F.get("q", 0), F.get("q", 2)
    marked = attach_by_key(counts.select(*by, "value", F.col("n").alias("__n")), q.drop("name"), by, "n", ["value"])
    reach = (q3 - q1) * 1.5
    inside = F.col("value").between(q1 - reach, q3 + reach)
    return marked.groupBy(*by, "q").agg(
        F.min(F.when(inside, F.col("value"))).alias("low"),
        F.max(F.when(inside, F.col("value"))).alias("high"),
        F.sum(F.when(inside, 0).otherwise(F.col("__n"))).alias("n_outliers"),
    ).select(*by, q1.alias("q1"), F.get("q", 1).alias("median"), q3.alias("q3"), "low", "high", "n_outliers")


def measures_by_group(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, name, sum, max): several measures side by side in long form."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [F.col(b) for b in by], list(cols), "name", "value"
    )
    return long.groupBy(*by, "name").agg(F.sum("value").alias("sum"), F.max("value").alias("max"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share): share of rows up to and including each distinct value."""
    counts = value_counts(df, [col]).where(F.col("value").isNotNull()).select("value", "n")
    run = running_weight(counts, ["value"], "n", total="__all")
    return run.select("value", "n", ((F.col("before") + F.col("n")) / F.col("__all")).alias("share"))


def qq_points(df: DataFrame, col: str, id_: str) -> DataFrame:
    """(id, value, position, normal): sorted values against normal quantiles; equal values in id order."""
    placed = row_positions(
        df.where(F.col(col).isNotNull()).select(id_, F.col(col).alias("value")), ["value", id_], name="i", total="n"
    )
    n, i = F.col("n").cast("double"), F.col("i")
    end = F.pow(F.lit(0.5), 1 / n)
    position = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    out = placed.select(id_, "value", position.alias("position"))
    return out.withColumn("normal", normal_quantile(F.col("position")))


def line_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, slope, intercept, r2) of y on x."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def negative_binomial_fit(df: DataFrame, col: str) -> DataFrame:
    """One row (mu, size) by moments; size is null if the variance does not exceed the mean."""
    m = df.agg(F.avg(col).alias("mu"), F.var_samp(col).alias("v"))
    return m.select("mu", F.when(F.col("v") > F.col("mu"), F.pow("mu", F.lit(2)) / (F.col("v") - F.col("mu"))).alias("size"))


def mean_word_length(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by, mean_word_len) over all blank-separated pieces of all texts of the group."""
    trimmed = df.select(*by, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("__t")).where("__t <> ''")
    pieces = trimmed.select(*by, F.explode(F.split("__t", " ", -1)).alias("piece"))
    return pieces.groupBy(*by).agg(F.avg(F.char_length("piece")).alias("mean_word_len"))


def extreme_row(df: DataFrame, metric: str, tie_break: Sequence[str], largest: bool = False) -> DataFrame:
    """The whole row with the smallest (largest) metric."""
    whole = F.struct(*df.columns)
    key = F.struct((-F.col(metric) if largest else F.col(metric)).alias("m"), *tie_break)
    return df.where(F.col(metric).isNotNull()).agg(F.min_by(whole, key).alias("row")).select("row.*")
