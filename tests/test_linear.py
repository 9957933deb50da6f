"""Sums of products, penalty paths and correlations against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import linear, stats

RNG = np.random.default_rng(4)
N = 600
X = np.column_stack([RNG.normal(3, 2, N), RNG.normal(0, 50, N), RNG.integers(0, 2, N), np.full(N, 7.0)])
X = np.column_stack([X, X[:, 0] * 2 + RNG.normal(0, 0.1, N)])
Y = 1.5 * X[:, 0] - 0.02 * X[:, 1] + RNG.normal(0, 1, N)
FOLD = np.arange(N) % 5


@pytest.fixture(scope="module")
def rows(spark):
    data = [(int(f), *[float(v) for v in x], float(y)) for f, x, y in zip(FOLD, X, Y)]
    return spark.createDataFrame(data, "fold int, a double, b double, c double, d double, e double, y double").repartition(7)




def cols():
    return [F.col(c) for c in "abcde"]


def test_cross_sums(rows):
    found = linear.cross_sums(rows, cols(), "fold").collect()
    assert len(found) == 5 * 6
    for r in found:
        own = np.column_stack([np.ones(N), X])[FOLD == r.fold]
        assert r.sums == pytest.approx((own.T @ own)[r.i])


def test_missing_values_raise(rows):
    with pytest.raises(Exception, match="impute first"):
        linear.cross_sums(rows.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), cols()).collect()


def gradient(train, y, fit):
    """Gradient of the squared error at a fit, for standardised columns."""
    away = train - train.mean(0)
    unit = np.where(away.std(0) > 0, away.std(0), 1)
    rest = y - fit.intercept - train @ np.array(fit.coefficients)
    return (away / unit).T @ rest / len(y), np.array(fit.coefficients) * unit


def test_every_point_of_a_path_is_a_minimum(rows):
    penalties, mixes = [1e-4, 0.01, 0.3, 5.0], [0.0, 0.4, 1.0]
    found = linear.penalty_paths(rows, cols(), F.col("y"), "fold", 5, penalties, mixes).collect()
    assert len(found) == 6 * 12
    for fit in found:
        own = np.ones(N, bool) if fit.training == linear.ALL else FOLD != fit.training
        slope, b = gradient(X[own], Y[own], fit)
        slope = slope - fit.penalty * (1 - fit.mix) * b
        edge = fit.penalty * fit.mix
        for g, value, constant in zip(slope, b, X.std(0) == 0):
            if constant:
                assert value == 0
            elif value:
                assert g == pytest.approx(edge * np.sign(value), abs=1e-7)
            else:
                assert abs(g) <= edge + 1e-7
        held = ~own if fit.training != linear.ALL else own
        assert fit.n == held.sum()
        assert fit.squares == pytest.approx(((Y - fit.intercept - X @ np.array(fit.coefficients))[held] ** 2).sum())


def test_best_point_is_refitted_on_all_rows(rows):
    penalties = linear.penalty_grid(-3, 1, 9)
    errors, fit = linear.tuned(rows, cols(), F.col("y"), "fold", 5, penalties, [1.0, 0.5])
    table = errors.collect()
    best = min(table, key=lambda e: (round(e["mean"], 9), -e.penalty, -e.mix))
    assert [e for e in table if e.best] == [best] and len(table) == 18
    row = fit.first()
    assert (row.mix, row.penalty) == (best.mix, best.penalty)
    new = linear.with_linear_value(rows, fit, cols()).select("a", "b", "c", "d", "e", "prediction").collect()
    for r in new[:20]:
        assert r.prediction == pytest.approx(row.intercept + sum(b * v for b, v in zip(row.coefficients, r[:5])))


def test_a_fold_without_rows_and_rows_without_folds(rows):
    found = linear.penalty_paths(rows.where("fold < 2"), cols(), F.col("y"), "fold", 3, [0.1], [1.0])
    assert {r.training: r.n for r in found.collect()} == {linear.ALL: 240, 0: 120, 1: 120, 2: 0}
    assert linear.penalty_paths(rows.where("false"), cols(), F.col("y"), "fold", 3, [0.1], [1.0]).count() == 0


@pytest.mark.parametrize("block", [2, 3, 256])
def test_correlations_of_pairs_with_gaps(spark, rows, block):
    gaps = rows.withColumns({"a": F.when(F.col("c") > 0, F.col("a")), "b": F.when(F.col("fold") != 1, F.col("b") + 1e6), "f": F.lit(None).cast("double")})
    names = ["a", "b", "c", "d", "e", "f"]
    got = {(r.x, r.y): r.r for r in stats.corr_matrix(gaps, names, block).collect()}
    table = gaps.select(*names).toPandas().astype(float)
    assert set(got) == {(b, a) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (x, y), r in got.items():
        both = table[[x, y]].dropna()
        constant = len(both) < 2 or both.std(ddof=0).min() == 0
        assert r is None if constant else r == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=1e-7)


def test_dummies_leave_out_the_first_level(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "y"), (None, "x")], "g string, h string")
    found = linear.dummies(df, ["g", "h"])
    assert list(found) == ["g_b", "g_c", "h_y"]
    assert df.select(*[c.alias(n) for n, c in found.items()]).collect()[3] == (0.0, 0.0, 0.0)
