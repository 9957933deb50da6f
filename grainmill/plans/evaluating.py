"""Metrics, cross-validation summaries, blends, comparisons, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import columns, metrics, resample, textmine
from grainmill.operators.scale import attach_by_key
from grainmill.plans.registry import query
from grainmill.plans.roles import LABELLED, RIDES, TWEETS, labelled, r, rides, texts
from grainmill.plans.words import tokens_sql

# predictions made from the tables by a fixed rule
_PRED = """preds as (select o_orderkey as id, o_totalprice as y, o_totalprice * (0.8::double + (o_orderkey % 41) / 100) as m1,
  o_totalprice * (0.9::double + (o_orderkey % 17) / 100) as m2, o_totalprice + (o_orderkey % 1000) * 10 as m3 from orders)"""


def preds(t):
    y, k = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"),
        y.alias("y"),
        (y * (F.lit(0.8) + k % 41 / 100)).alias("m1"),
        (y * (F.lit(0.9) + k % 17 / 100)).alias("m2"),
        (y + k % 1000 * 10).alias("m3"),
    )


_SCORES = LABELLED + ", scores as (select id, target, toxic, (id * 37 % 101 + 40 * target) / 150 as p, case when (id * 37 % 101 + 40 * target) / 150 > 0.5 then 1 else 0 end as said from labelled)"


def scores(t):
    p = (F.col("id") * 37 % 101 + F.col("target") * 40) / 150
    return labelled(t).select("id", "target", "toxic", p.alias("p"), metrics.threshold_label(p, 0.5).alias("said"))


@query("metric_rmse", f"with {_PRED} select round(sqrt(avg(power(m1 - y, 2))), 4) as rmse from preds")
def metric_rmse(t):
    return preds(t).agg(r(metrics.rmse(F.col("y"), F.col("m1")), 4).alias("rmse"))


@query("metric_rmsle", f"with {_PRED} select round(sqrt(avg(power(ln(m1 + 1) - ln(y + 1), 2))), 6) as rmsle from preds")
def metric_rmsle(t):
    return preds(t).agg(r(metrics.rmsle(F.col("y"), F.col("m1"))).alias("rmsle"))


@query(
    "metric_precision_recall_f1",
    f"with {_SCORES} "
    + " union all ".join(
        f"""select {c} as positive, round(count(*) filter (where target = {c} and said = {c}) / nullif(count(*) filter (where said = {c}), 0), 6) as precision,
        round(count(*) filter (where target = {c} and said = {c}) / nullif(count(*) filter (where target = {c}), 0), 6) as recall,
        round(2 * count(*) filter (where target = {c} and said = {c}) / nullif(count(*) filter (where said = {c}) + count(*) filter (where target = {c}), 0), 6) as f1 from scores"""
        for c in (0, 1)
    ),
)
def metric_precision_recall_f1(t):
    """Once per class: which class counts as positive is the caller's choice."""
    s = scores(t)
    y, e = F.col("target"), F.col("said")
    parts = [
        F.struct(
            F.lit(c).alias("positive"),
            r(metrics.precision(y, e, c)).alias("precision"),
            r(metrics.recall(y, e, c)).alias("recall"),
            r(metrics.f1(y, e, c)).alias("f1"),
        )
        for c in (0, 1)
    ]
    return s.agg(F.array(*parts).alias("a")).select(F.inline("a"))


@query(
    "metric_accuracy_auc",
    f"""with {_SCORES}, k as (select target, rank() over (order by p) as lo, count(*) over (partition by p) as c from scores),
        s as (select sum(case when target = 1 then lo + (c - 1) / 2 end) as ranks, count(*) filter (where target = 1) as pos, count(*) filter (where target = 0) as neg from k)
        select (select round(avg(case when target = said then 1.0::double else 0 end), 6) from scores) as accuracy, round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) as auc from s""",
)
def metric_accuracy_auc(t):
    s = scores(t)
    acc = s.agg(r(metrics.accuracy(F.col("target"), F.col("said"))).alias("accuracy"))
    return acc.withColumn("auc", r(metrics.auc(s, "target", "p").scalar()))


_FOLD = "cast('0x' || substr(md5(id || ':5'), 1, 8) as bigint) % 5"


@query(
    "cv_mean_sd",
    f"""with {_PRED}, f as (select {_FOLD} as fold, sqrt(avg(power(m1 - y, 2))) as score from preds group by 1)
        select round(avg(score), 4) as mean, round(stddev_pop(score), 4) as sd from f""",
)
def cv_mean_sd(t):
    folds = resample.kfold(preds(t), "id", 5, 5)
    return metrics.cv_mean_sd(folds, "fold", "y", "m1").select(r("mean", 4).alias("mean"), r("sd", 4).alias("sd"))


_BLEND = "round((0.1::double * m1 + 0.1::double * m2 + 0.8::double * m3) / (0.1::double + 0.1::double + 0.8::double), 6)"


@query("blend_predictions", f"with {_PRED} select id, {_BLEND} as pred from preds")
def blend_predictions(t):
    p = preds(t)
    tables = [p.select("id", F.col(m).alias("pred")) for m in ("m1", "m2", "m3")]
    return metrics.blend(tables, [0.1, 0.1, 0.8]).withColumn("pred", r("pred"))


@query("blend_score", f"with {_PRED}, b as (select y, {_BLEND} as pred from preds) select round(sqrt(avg(power(ln(pred + 1) - ln(y + 1), 2))), 6) as rmsle from b")
def blend_score(t):
    truth = preds(t).select("id", "y")
    return blend_predictions(t).join(truth, "id").agg(r(metrics.rmsle(F.col("y"), F.col("pred"))).alias("rmsle"))


@query(
    "sum_component_models",
    f"with {RIDES} select id, round(exp(ln(registered + 1) * 0.9::double) - 1 + exp(ln(casual + 1) * 0.8::double) - 1, 6) + 0.0 as pred from rides",
)
def sum_component_models(t):
    src = rides(t)
    reg = src.select("id", (F.log1p("registered") * 0.9).alias("pred"))
    cas = src.select("id", (F.log1p("casual") * 0.8).alias("pred"))
    return metrics.sum_components(reg, cas, F.expm1).select("id", r("pred").alias("pred"))


@query("threshold_labels", f"with {_SCORES} select id, case when p > 0.65 then 1 else 0 end as label, cast(round_even(p, 0) as integer) as rounded from scores")
def threshold_labels(t):
    return scores(t).select(
        "id", metrics.threshold_label(F.col("p"), 0.65).alias("label"), F.bround("p", 0).cast("int").alias("rounded")
    )


@query(
    "model_comparison",
    f"with {_PRED} "
    + " union all ".join(
        f"select '{m}' as model, round(sqrt(avg(power({m} - y, 2))), 4) as rmse, round(sqrt(avg(power(ln({m} + 1) - ln(y + 1), 2))), 6) as rmsle from preds"
        for m in ("m1", "m2", "m3")
    ),
)
def model_comparison(t):
    found = metrics.compare_models(preds(t), "y", ["m1", "m2", "m3"], {"rmse": metrics.rmse, "rmsle": metrics.rmsle})
    return found.select("model", r("rmse", 4).alias("rmse"), r("rmsle").alias("rmsle"))


# ---- user functions ----------------------------------------------------------------------------


@query(
    "table_metric_fn",
    f"with {_PRED} select cast(id % 10 as integer) as part, round(avg(abs(m2 - y) / y), 6) as mape from preds group by 1",
)
def table_metric_fn(t):
    """A metric is a function from two columns to an aggregate, so any caller can add one."""

    def mape(truth, estimate):
        return F.avg(F.abs(estimate - truth) / truth)

    parts = preds(t).withColumn("part", (F.col("id") % 10).cast("int"))
    return metrics.by_fold(parts, "part", "y", "m2", mape).select("part", r("score").alias("mape"))


@query(
    "column_lambda",
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity) + 1, 6) as l_quantity, round(sqrt(l_discount) + 1, 6) as l_discount from lineitem",
)
def column_lambda(t):
    done = columns.across(t.lineitem, ["l_quantity", "l_discount"], lambda c: r(F.sqrt(c) + 1))
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")


@query(
    "group_lambda",
    """select event_id, round(case when event_id % 9 = 0 then avg(case when event_id % 9 <> 0 then value end) over (partition by event_type) else value end, 6) as value from events""",
)
def group_lambda(t):
    """A function of a group's rows: missing values become the mean of the group."""
    src = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    stats = src.groupBy("event_type").agg(F.avg("value").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    filled = attach_by_key(src, stats, ["event_type"], "__n", ["event_id"])
    return filled.select("event_id", r(F.coalesce("value", "__mean")).alias("value"))


@query("row_generator", f"with {TWEETS}, {tokens_sql('tweets', 'location')} select location, word, count(*) as n from tokens group by all")
def row_generator(t):
    words = textmine.unnest_tokens(texts(t), keep=["location"])
    return words.groupBy("location", "word").agg(F.count(F.lit(1)).alias("n"))
