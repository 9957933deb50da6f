"""Dates, logarithms, power transforms, scaling, interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import calendar, numeric
from grainmill.operators import columns, profile, reshape, stats, transforms
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, RIDES, houses, r, rides


@query("hour_of_day", f"with {RIDES} select id, cast(hour(datetime) as integer) as hour from rides")
def hour_of_day(t):
    return rides(t).select("id", F.hour("datetime").alias("hour"))


@query(
    "date_parts",
    f"""with {RIDES} select id, strftime(datetime, '%a') as datetime_dow, strftime(datetime, '%b') as datetime_month,
        cast(year(datetime) as integer) as datetime_year from rides""",
)
def date_parts(t):
    return rides(t).withColumns(calendar.date_parts("datetime")).select("id", "datetime_dow", "datetime_month", "datetime_year")


@query(
    "year_difference",
    """select o_orderkey, l_linenumber, l_partkey, l_suppkey, cast(year(l_shipdate) - year(o_orderdate) as integer) as years
       from lineitem join orders on l_orderkey = o_orderkey""",
)
def year_difference(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        calendar.year_difference(F.col("l_shipdate"), F.col("o_orderdate")).alias("years"),
    )


@query(
    "log_family",
    """select event_id, round(ln(value), 6) + 0.0 as log_x, round(ln(1 + value), 6) as log1p_x, round(log10(value), 6) + 0.0 as log10_x,
       round(ln(value + 1), 6) as log_offset, round(exp(value / 100), 6) as exp_x, round(exp(value / 100) - 1, 6) as expm1_x,
       round(power(10, log10(value)), 6) as back from events""",
)
def log_family(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        r(F.log(v)).alias("log_x"),
        r(F.log1p(v)).alias("log1p_x"),
        r(F.log10(v)).alias("log10_x"),
        r(F.log(v + 1)).alias("log_offset"),
        r(F.exp(v / 100)).alias("exp_x"),
        r(F.expm1(v / 100)).alias("expm1_x"),
        r(F.pow(F.lit(10.0), F.log10(v))).alias("back"),
    )


@query(
    "boxcox_fixed",
    f"""with {RIDES} select id, round((power(1 + windspeed, 0.15::double) - 1) / 0.15::double, 6) + 0.0 as windspeed, cast(temp as double) as temp from rides""",
)
def boxcox_fixed(t):
    src = rides(t).select("id", "windspeed", F.col("temp").cast("double").alias("temp"))
    skewed = profile.names_where(stats.skewness_scan(src, ["windspeed", "temp"]), F.col("skew") > 0.75)
    return columns.across(src, skewed, lambda c: r(numeric.box_cox1p(c, 0.15)))


def _lambda_sql():
    """The best power on -40 .. 40 in steps of 0.2, then in steps ten times finer around it."""
    parts, prev = [], None
    for i, step in enumerate((0.2, 0.02, 0.002, 0.0002), 1):
        source = f"{prev}, range(-10, 11) as u(j)" if prev else "range(-200, 201) as u(j)"
        parts.append(f"g{i} as (select {'lam' if prev else '0.0::double'} + j * {step!r}::double as l from {source})")
        parts.append(
            f"""b{i} as (select l, (l - 1) * sum(ln(x)) - count(*) / 2 * ln(var_pop(case when abs(l) < 1e-12 then ln(x) else (power(x, l) - 1) / l end)) as llf
            from xs, g{i} where l * (select max(ln(x)) from xs) < 300 group by l)"""
        )
        parts.append(f"p{i} as (select l as lam, llf from b{i} order by llf desc, l limit 1)")
        prev = f"p{i}"
    return ", ".join(parts)


#: A column with few values above zero, whose best power is far below -2.
_RARE = "case when event_id % 56 = 0 then 53 + event_id % 500 else 0 end"


def _lambda_row(name, x):
    return f"""select * from (with xs as (select {x} + 1 as x from events), {_lambda_sql()}
        select '{name}' as name, round(lam, 6) + 0.0 as lambda, round(llf, 2) as llf from p4)"""


@query(
    "boxcox_mle",
    " union all ".join([
        _lambda_row("windspeed", "value"),
        _lambda_row("temp", "cast(json_extract_string(props, '$.k') as double)"),
        _lambda_row("rare", _RARE),
    ]),
)
def boxcox_mle(t):
    rare = t.events.select(F.expr(_RARE).alias("rare"))
    found = transforms.box_cox_lambdas(rides(t), ["windspeed", "temp"]).union(transforms.box_cox_lambdas(rare, ["rare"]))
    return found.select("name", r("lambda").alias("lambda"), r("llf", 2).alias("llf"))


@query(
    "boxcox_mle_apply",
    f"""with xs as (select value + 1 as x from events), {_lambda_sql()},
        rare as (select * from (with xs as (select {_RARE} + 1 as x from events), {_lambda_sql()} select lam as low from p4))
        select event_id as id, round((power(value + 1, lam) - 1) / lam, 5) + 0.0 as windspeed,
               round((power({_RARE} + 1, low) - 1) / low, 5) + 0.0 as rare from events, p4, rare""",
)
def boxcox_mle_apply(t):
    src = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("windspeed"), F.expr(_RARE).alias("rare"))
    done = transforms.box_cox_fit_apply(src, ["windspeed", "rare"])
    return done.select("id", r("windspeed", 5).alias("windspeed"), r("rare", 5).alias("rare"))


@query(
    "log_if_skewed",
    """select e.event_id as id, round(ln(value), 6) + 0.0 as a, round(ln(1 + case when event_id % 10 = 0 then 0 else value end), 6) + 0.0 as b,
       cast(user_id as double) as c from events e""",
)
def log_if_skewed(t):
    src = t.events.select(
        F.col("event_id").alias("id"),
        F.col("value").alias("a"),
        F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("b"),
        F.col("user_id").alias("c"),
    )
    done = transforms.log_if_skewed(src, ["a", "b", "c"])
    return done.select("id", r("a").alias("a"), r("b").alias("b"), "c")


def _scaled_sql(centre, scale):
    cols = ("sale_price", "lot_frontage")
    row = ", ".join(f"{centre.format(c)} as m_{c}, {scale.format(c)} as s_{c}" for c in cols)
    out = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 as {c}" for c in cols)
    return f"with {HOUSES}, k as (select {row} from houses) select id, {out} from houses, k"


def _scaled(done):
    return done.select("id", r("sale_price").alias("sale_price"), r("lot_frontage").alias("lot_frontage"))


@query("standardize_sample", _scaled_sql("avg({0})", "stddev_samp({0})"))
def standardize_sample(t):
    return _scaled(transforms.standardize(houses(t), ["sale_price", "lot_frontage"]))


@query("standardize_population", _scaled_sql("avg({0})", "stddev_pop({0})"))
def standardize_population(t):
    return _scaled(transforms.standardize(houses(t), ["sale_price", "lot_frontage"], population=True))


@query("robust_scale", _scaled_sql("median({0})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def robust_scale(t):
    return _scaled(transforms.robust_scale(houses(t), ["sale_price", "lot_frontage"]))


@query(
    "round_half_even",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 2, 0) as half, round_even(l_quantity / 4, 1) as quarter from lineitem""",
)
def round_half_even(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numeric.round_half_even(F.col("l_quantity") / 2, 0).alias("half"),
        numeric.round_half_even(F.col("l_quantity") / 4, 1).alias("quarter"),
    )


@query(
    "interaction_terms",
    f"""with {RIDES} select id, {', '.join(f'case when season = {s} and weather = {w} then 1 else 0 end as season_x{s}_x_weather_x{w}' for s in (1, 2, 3, 4) for w in (1, 2, 3))},
        round(temp * windspeed, 6) as temp_x_windspeed, temp * temp as temp_x_temp from rides""",
)
def interaction_terms(t):
    src = rides(t).select("id", "season", "weather", "temp", "windspeed")
    for c in ("season", "weather"):
        src = reshape.one_hot(src, c, reshape.learn_levels(src, c))
    season = columns.columns_by_name(src, starts_with="season_")
    weather = columns.columns_by_name(src, starts_with="weather_")
    src = transforms.interactions(src, season, weather)
    src = transforms.interactions(src, ["temp"], ["windspeed", "temp"])
    return src.withColumn("temp_x_windspeed", r("temp_x_windspeed")).drop(*season, *weather, "temp", "windspeed")
