"""Properties that hold for any input."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from grainmill.operators import impute, metrics, models, resample, reshape, scale, stats, transforms, windows
from grainmill.recipe import steps


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [
        (i, rng.choice("abc"), rng.gammavariate(2, 3) if rng.random() > 0.1 else None, float(rng.randint(0, 3)), rng.choice(["x", "y", None]))
        for i in range(400)
    ]
    return spark.createDataFrame(rows, "id long, g string, v double, z double, s string").cache()


def test_long_form_and_back(table):
    long = reshape.to_long(table, ["v", "z"], ["id"], "double")
    back = long.groupBy("id").pivot("name", ["v", "z"]).agg(F.first("value", ignorenulls=True))
    assert back.exceptAll(table.select("id", "v", "z")).count() == 0
    assert long.count() == 800


def test_folds_are_disjoint_and_complete(table):
    folds = resample.kfold(table, "id", 5, 9)
    assert folds.count() == 400 and {r.fold for r in folds.select("fold").distinct().collect()} == set(range(5))


def test_splits_ignore_partitioning(table):
    for split in (
        lambda d: resample.random_split(d, "id", 0.7, 1),
        lambda d: resample.stratified_split(d, "id", ["g"], 0.7, 1),
        lambda d: resample.tail_validation(d, ["id"], 0.3),
    ):
        a = split(table.repartition(1)).select("id", "part").orderBy("id").collect()
        b = split(table.repartition(7)).select("id", "part").orderBy("id").collect()
        assert a == b


def test_strata_keep_their_share(table):
    out = resample.stratified_split(table, "id", ["g"], 0.7, 1).groupBy("g").agg(
        F.count_if(F.col("part") == "train").alias("k"), F.count("*").alias("n")
    )
    assert all(r.k == int(r.n * 0.7) for r in out.collect())


def test_shares_sum_to_one(table):
    shares = windows.share_within(scale.key_counts(table, ["g", "s"]), ["g"])
    assert all(r.p == pytest.approx(1) for r in shares.groupBy("g").agg(F.sum("prop").alias("p")).collect())


@pytest.mark.parametrize("fill", [impute.fill_median_global, impute.fill_mean_global, impute.fill_mode_global])
def test_imputers_leave_nothing_missing(table, fill):
    out = fill(table, ["v"])
    assert out.where("v is null").count() == 0
    assert out.where("v is not null").join(table.where("v is not null").select("id", F.col("v").alias("o")), "id").where("v <> o").count() == 0


def test_median_against_numpy(table):
    v = np.array([r.v for r in table.collect() if r.v is not None])
    assert impute.median_row(table, ["v"]).first().v == pytest.approx(np.median(v))


def test_recipe_learns_from_train_alone(table):
    train, test = table.where("id < 200"), table.where("id >= 200").withColumn("v", F.lit(1000.0))
    recipe = Pipeline(stages=[steps.fill_mean("v"), steps.normalize("v"), steps.fill_mode("s")]).fit(train)
    done = recipe.transform(test)
    v = np.array([r.v if r.v is not None else np.nan for r in train.collect()])
    v = np.where(np.isnan(v), np.nanmean(v), v)
    assert done.first().v == pytest.approx((1000 - v.mean()) / v.std(ddof=1))
    assert done.where("s is null").count() == 0


def test_box_cox_power_is_the_best_one(table):
    got = transforms.box_cox_lambdas(table, ["v"]).first()
    x = np.array([r.v for r in table.collect() if r.v is not None]) + 1

    def llf(lam):
        y = np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    best = max(np.arange(-2, 2, 0.001), key=llf)
    assert got["lambda"] == pytest.approx(best, abs=2e-3)
    assert got["llf"] == pytest.approx(llf(got["lambda"]))


def test_box_cox_power_far_from_zero(spark):
    values = [0.0] * 1434 + [53.0 + 20 * i for i in range(25)] + [572.0]
    df = spark.createDataFrame([(v, 3.0) for v in values], "v double, same double")
    got = {r.name: r["lambda"] for r in transforms.box_cox_lambdas(df, ["v", "same"]).collect()}
    logs = np.log1p(values)

    def llf(lam):
        return (lam - 1) * logs.sum() - len(logs) / 2 * np.log((np.expm1(lam * logs) / lam).var())

    best = max(np.arange(-20, -2, 0.0005), key=llf)
    assert best < -9 and got["v"] == pytest.approx(best, abs=1e-3) and got["same"] is None


def test_density_integrates_to_one(table):
    d = stats.density_estimate(table.where("v is not null"), "v", ["g"], points=400).orderBy("g", "x").collect()
    for g in "abc":
        xs, ys = zip(*[(r.x, r.density) for r in d if r.g == g])
        assert np.trapezoid(ys, xs) == pytest.approx(1, abs=0.12)


def test_linear_model_beats_the_mean(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 17), rng.choice("pq"), 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, k string, y double")
    df = df.withColumn("y", F.col("x") * 2 + F.when(F.col("k") == "p", 5).otherwise(0) + F.sin("id"))
    train, new = df.where("id < 200"), df.where("id >= 200")
    _, scored = models.fit_and_score(models.feature_stages(["x"], ["k"]), LinearRegression(labelCol="y", regParam=0.001), train, new, "y")
    out = scored.agg(metrics.rmse(F.col("y"), F.col("prediction")).alias("e"), F.stddev_pop("y").alias("sd")).first()
    assert out.e < 0.2 * out.sd


def test_several_predictors_fill_what_is_missing(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], None if i % 10 == 0 else 3.0 * i + (i % 2)) for i in range(60)], "x double, k string, y double")
    out = impute.fill_regression(df, "y", ["x"], ["k"])
    assert out.columns == ["x", "k", "y"]
    assert all(r.y == pytest.approx(3 * r.x + (r.x % 2), abs=0.01) for r in out.collect())


def test_regression_fill_uses_half_even_rounding(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (5.0, None)], "x double, y double")
    assert impute.fill_line(df, "y", "x", rounded=True).where("x = 5").first().y == 2.0


def test_precision_and_recall_follow_the_positive_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, e int")
    y, e = F.col("y"), F.col("e")
    got = df.agg(metrics.precision(y, e, 1).alias("p1"), metrics.recall(y, e, 1).alias("r1"), metrics.precision(y, e, 0).alias("p0"), metrics.f1(y, e, 2).alias("none")).first()
    assert tuple(got) == (1.0, 0.5, pytest.approx(2 / 3), None)
