"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import impute
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, houses, r

_H = f"with {HOUSES}"


def _h(t, *cols):
    return houses(t).select("id", *cols)


@query(
    "fill_constant",
    f"{_H} select id, coalesce(quality, 'None') as quality, coalesce(zoning, 'None') as zoning, coalesce(lot_frontage, 0) as lot_frontage, coalesce(garage_yr, 0) as garage_yr from houses",
)
def fill_constant(t):
    values = {"quality": "None", "zoning": "None", "lot_frontage": 0.0, "garage_yr": 0}
    return impute.fill_constant(_h(t, *values), values)


@query(
    "fill_all_strings",
    f"{_H} select id, coalesce(quality, 'None') as quality, coalesce(zoning, 'None') as zoning, status, lot_frontage from houses",
)
def fill_all_strings(t):
    return impute.fill_all_strings(_h(t, "quality", "zoning", "status", "lot_frontage"))


def _mode_sql(col):
    return f"(select {col} from houses where {col} is not null group by {col} order by count(*) desc, {col} limit 1)"


@query(
    "fill_mode_global",
    f"{_H} select id, coalesce(quality, {_mode_sql('quality')}) as quality, coalesce(zoning, {_mode_sql('zoning')}) as zoning from houses",
)
def fill_mode_global(t):
    return impute.fill_mode_global(_h(t, "quality", "zoning"), ["quality", "zoning"])


@query(
    "fill_mode_group",
    f"""{_H}, c as (select neighborhood, status, zoning, count(*) as n from houses where zoning is not null group by all),
        m as (select * from (select *, row_number() over (partition by neighborhood, status order by n desc, zoning) as k from c) where k = 1)
        select id, h.neighborhood, h.status, coalesce(h.zoning, m.zoning) as zoning from houses h
        left join m on h.neighborhood is not distinct from m.neighborhood and h.status is not distinct from m.status""",
)
def fill_mode_group(t):
    return impute.fill_mode_group(
        _h(t, "neighborhood", "status", "zoning"), ["neighborhood", "status"], "zoning", ["id"]
    )


@query(
    "fill_median_global",
    f"{_H} select id, round(coalesce(lot_frontage, (select median(lot_frontage) from houses)), 6) as lot_frontage, round(coalesce(lot_area, (select median(lot_area) from houses)), 6) as lot_area from houses",
)
def fill_median_global(t):
    filled = impute.fill_median_global(_h(t, "lot_frontage", "lot_area"), ["lot_frontage", "lot_area"])
    return filled.select("id", r("lot_frontage").alias("lot_frontage"), r("lot_area").alias("lot_area"))


@query(
    "fill_mean_global",
    f"{_H} select id, round(coalesce(lot_frontage, (select avg(lot_frontage) from houses)), 6) as lot_frontage, round(coalesce(garage_yr, (select avg(garage_yr) from houses)), 6) as garage_yr from houses",
)
def fill_mean_global(t):
    filled = impute.fill_mean_global(_h(t, "lot_frontage", "garage_yr"), ["lot_frontage", "garage_yr"])
    return filled.select("id", r("lot_frontage").alias("lot_frontage"), r("garage_yr").alias("garage_yr"))


@query("fill_from_column", f"{_H} select id, coalesce(garage_yr, year_built) as garage_yr from houses")
def fill_from_column(t):
    return impute.fill_from_column(_h(t, "garage_yr", "year_built"), "garage_yr", "year_built").drop("year_built")


@query(
    "fill_regression",
    f"""{_H}, f as (select regr_slope(lot_frontage, rooms) as b, regr_intercept(lot_frontage, rooms) as a from houses)
        select id, round(coalesce(lot_frontage, a + b * rooms), 6) as lot_frontage from houses, f""",
)
def fill_regression(t):
    filled = impute.fill_line(_h(t, "lot_frontage", "rooms"), "lot_frontage", "rooms")
    return filled.select("id", r("lot_frontage").alias("lot_frontage"))


@query(
    "fill_regression_factors",
    f"""{_H}, s as (select id, lot_frontage as y, ln(coalesce(lot_area, 0) + 1) as x, neighborhood as g from houses),
        m as (select g, avg(x) as mx, avg(y) as my from s where y is not null group by g),
        b as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b from s join m on s.g = m.g where y is not null)
        select id, round(coalesce(y, my + b * (x - mx)), 4) as lot_frontage from s join m on s.g = m.g, b""",
)
def fill_regression_factors(t):
    """Two predictors, one of them a category: log area and neighborhood. The SQL solves the same least
    squares problem from the deviations within the neighborhoods."""
    h = houses(t).select("id", "lot_frontage", "neighborhood", F.log1p(F.coalesce("lot_area", F.lit(0.0))).alias("log_area"))
    filled = impute.fill_regression(h, "lot_frontage", ["log_area"], ["neighborhood"])
    return filled.select("id", r("lot_frontage", 4).alias("lot_frontage"))
