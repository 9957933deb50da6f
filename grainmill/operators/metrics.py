"""Metrics as aggregate columns, usable in any groupBy, and comparisons of models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import running_weight

Metric = Callable[[Column, Column], Column]


def rmse(truth: Column, estimate: Column) -> Column:
    return F.sqrt(F.avg(F.pow(estimate - truth, F.lit(2))))


def rmsle(truth: Column, estimate: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.log1p(estimate) - F.log1p(truth), F.lit(2))))


def accuracy(truth: Column, estimate: Column) -> Column:
    return F.avg((truth == estimate).cast("double"))


def _hits(truth: Column, estimate: Column, positive) -> tuple[Column, Column, Column]:
    t, e = truth == F.lit(positive), estimate == F.lit(positive)
    return F.count_if(t & e), F.count_if(e), F.count_if(t)


def precision(truth: Column, estimate: Column, positive) -> Column:
    both, said, _ = _hits(truth, estimate, positive)
    return F.try_divide(both, said)


def recall(truth: Column, estimate: Column, positive) -> Column:
    both, _, real = _hits(truth, estimate, positive)
    return F.try_divide(both, real)


def f1(truth: Column, estimate: Column, positive) -> Column:
    both, said, real = _hits(truth, estimate, positive)
    return F.try_divide(both * 2, said + real)


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (auc): area under the ROC curve; equal scores count half.

    Counts per distinct score first, then one running sum over the distinct scores.
    """
    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )
    run = running_weight(counts, ["s"], "neg")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    return run.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def by_fold(df: DataFrame, fold: str, truth: str, estimate: str, metric: Metric = rmse) -> DataFrame:
    """(fold, score)."""
    return df.groupBy(fold).agg(metric(F.col(truth), F.col(estimate)).alias("score"))


def cv_mean_sd(df: DataFrame, fold: str, truth: str, estimate: str, metric: Metric = rmse) -> DataFrame:
    """One row (mean, sd) over the folds, sd with n."""
    scores = by_fold(df, fold, truth, estimate, metric)
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


def blend(predictions: Sequence[DataFrame], weights: Sequence[float], id_: str = "id") -> DataFrame:
    """(id, pred): weighted mean of several (id, pred) tables, matched on the id."""
    parts = [p.select(id_, (F.col("pred") * w).alias("pred")) for p, w in zip(predictions, weights, strict=True)]
    out = parts[0].withColumnRenamed("pred", "__p0")
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnRenamed("pred", f"__p{i}"), id_)
    total = sum(weights)
    return out.select(id_, (sum(F.col(f"__p{i}") for i in range(len(parts))) / total).alias("pred"))


def sum_components(a: DataFrame, b: DataFrame, inverse: Callable[[Column], Column], id_: str = "id") -> DataFrame:
    """(id, pred): sum of two sub-target predictions, each taken back to the original scale first."""
    left = a.select(id_, inverse(F.col("pred")).alias("__a"))
    right = b.select(id_, inverse(F.col("pred")).alias("__b"))
    return left.join(right, id_).select(id_, (F.col("__a") + F.col("__b")).alias("pred"))


def threshold_label(probability: Column, cut: float) -> Column:
    return F.when(probability > cut, 1).otherwise(0)


def compare_models(df: DataFrame, truth: str, models: Sequence[str], metrics: Mapping[str, Metric]) -> DataFrame:
    """(model, one column per metric) from a table with one prediction column per model."""
    long = df.unpivot([F.col(truth)], [F.col(m) for m in models], "model", "estimate")
    return long.groupBy("model").agg(*[f(F.col(truth), F.col("estimate")).alias(n) for n, f in metrics.items()])

