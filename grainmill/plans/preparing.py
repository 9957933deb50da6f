"""Fit-once / apply-later preparation, splits and folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F


from grainmill.operators import resample
from grainmill.operators.scale import quantile_row, settle, with_scalars
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, LABELLED, houses, labelled, r
from grainmill.recipe import steps

_H = f"with {HOUSES}"
_LEVELS = ["None", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def _parts(t, *cols):
    # written once: every step that learns reads the training rows
    h = settle(houses(t).select("id", *cols), "houses")
    return h.where(F.col("id") % 4 != 0), h.where(F.col("id") % 4 == 0)


@query(
    "recipe_fit_apply",
    f"""{_H}, train as (select * from houses where id % 4 <> 0),
        zmode as (select zoning as z from train where zoning is not null group by zoning order by count(*) desc, zoning limit 1),
        kept as (select neighborhood as kn from train where neighborhood is not null group by neighborhood having count(*) >= 0.04::double * (select count(neighborhood) from train)),
        prep as (select id, sale_price, coalesce(zoning, z) as zoning, coalesce(quality, 'None') as quality, coalesce(lot_area, 0) as lot_area,
                 coalesce(lot_frontage, 0) as lot_frontage, case when kn is not null then cast(neighborhood as varchar) when neighborhood is not null then 'other' end as neighborhood,
                 cast(yr_sold - year_built as double) as age, case when yr_sold = year_built then 1 else 0 end as is_new, status
                 from houses left join kept on neighborhood = kn, zmode),
        par as (select avg(age) as ma, stddev_samp(age) as sa, avg(lot_area) as ml, stddev_samp(lot_area) as sl from prep where id % 4 <> 0)
        select id, round(ln(sale_price + 1), 6) as sale_price, round((age - ma) / sa, 6) + 0.0 as age, round((lot_area - ml) / sl, 6) + 0.0 as lot_area, lot_frontage, neighborhood,
        case quality when 'None' then 1 when '5-LOW' then 2 when '4-NOT SPECIFIED' then 3 when '3-MEDIUM' then 4 when '2-HIGH' then 5 when '1-URGENT' then 6 end as quality,
        case when zoning = 'AUTOMOBILE' then 1 else 0 end as zoning_automobile, case when zoning = 'BUILDING' then 1 else 0 end as zoning_building,
        case when zoning = 'FURNITURE' then 1 else 0 end as zoning_furniture, case when zoning = 'HOUSEHOLD' then 1 else 0 end as zoning_household,
        case when zoning = 'MACHINERY' then 1 else 0 end as zoning_machinery,
        case when status = 'F' then 1 else 0 end as status_f, case when status = 'O' then 1 else 0 end as status_o, case when status = 'P' then 1 else 0 end as status_p,
        round(case when status = 'F' then 1 else 0 end * age, 6) + 0.0 as status_f_x_age, round(case when status = 'O' then 1 else 0 end * age, 6) + 0.0 as status_o_x_age,
        round(case when status = 'P' then 1 else 0 end * age, 6) + 0.0 as status_p_x_age
        from prep, par""",
)
def recipe_fit_apply(t):
    """Parameters from three quarters of the houses, applied to all of them."""
    train, test = _parts(
        t, "sale_price", "zoning", "quality", "lot_area", "lot_frontage", "neighborhood", "yr_sold", "year_built", "status", "balance"
    )
    price = steps.LogColumn("sale_price", 1.0)
    recipe = Pipeline(
        stages=[
            steps.fill_mode("zoning"),
            steps.keep_type("quality"),
            steps.fill_constant({"quality": "None"}),
            steps.fill_constant({"lot_area": 0.0, "lot_frontage": 0.0}),
            steps.lump_rare("neighborhood", 0.04, ["id"]),
            steps.mutate(
                age=(F.col("yr_sold") - F.col("year_built")).cast("double"),
                is_new=F.when(F.col("yr_sold") == F.col("year_built"), 1).otherwise(0),
            ),
            steps.remove("yr_sold", "year_built", "balance"),
            steps.one_hot("zoning", "status"),
            steps.interact("^status_", "^age$"),
            steps.normalize("age", "lot_area"),
            steps.ordinal_score(_LEVELS, "quality"),
            price.step(),
            steps.drop_near_zero_variance("is_new", "status_f", "status_o", "status_p"),
        ]
    )
    fitted = recipe.fit(train)
    both = fitted.transform(train).unionByName(fitted.transform(test))
    rounded = ["sale_price", "age", "lot_area", "status_f_x_age", "status_o_x_age", "status_p_x_age"]
    return both.withColumns({c: r(c) for c in rounded})


@query("step_remove", f"{_H} select id, sale_price from houses where id % 4 = 0")
def step_remove(t):
    train, test = _parts(t, "sale_price", "balance", "baths")
    return Pipeline(stages=[steps.remove("balance", "baths")]).fit(train).transform(test)


@query(
    "lump_rare",
    f"""{_H}, kept as (select neighborhood as kn from houses where id % 4 <> 0 group by neighborhood having count(*) >= 0.04::double * (select count(neighborhood) from houses where id % 4 <> 0)),
        q as (select quality as kq from houses where id % 4 <> 0 group by quality having count(*) >= 2000)
        select id, case when neighborhood is null then null when kn is not null then cast(neighborhood as varchar) else 'other' end as neighborhood,
        case when quality is null then null when kq is not null then quality else 'other' end as quality
        from houses left join kept on neighborhood = kn left join q on quality = kq where id % 4 = 0""",
)
def lump_rare(t):
    """A share for one column, a count for the other; levels learnt on train, applied to test."""
    train, test = _parts(t, "neighborhood", "quality")
    recipe = Pipeline(stages=[steps.lump_rare("neighborhood", 0.04, ["id"]), steps.lump_rare("quality", 2000, ["id"])])
    return recipe.fit(train).transform(test)


_NZV = ["one_value", "rare_flag", "o_orderpriority", "o_custkey"]
_NZV_SRC = "src as (select 'x' as one_value, case when o_orderkey % 50 = 0 then 1 else 0 end as rare_flag, o_orderpriority, o_custkey from orders)"


@query(
    "near_zero_variance",
    f"with {_NZV_SRC}, l as ("
    + " union all ".join(f"select '{c}' as name, cast({c} as varchar) as value, count(*) as n from src group by {c}" for c in _NZV)
    + """), k as (select *, row_number() over (partition by name order by n desc, value) as k from l)
       select name, count(*) as n_distinct, round(max(n) filter (where k = 1) / max(n) filter (where k = 2), 6) as freq_ratio,
       round(count(*) / sum(n), 6) as distinct_share,
       count(*) = 1 or coalesce(max(n) filter (where k = 1) / max(n) filter (where k = 2) > 19 and count(*) / sum(n) <= 0.1, false) as dropped from k group by name""",
)
def near_zero_variance(t):
    src = t.orders.select(
        F.lit("x").alias("one_value"),
        F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0).alias("rare_flag"),
        "o_orderpriority",
        "o_custkey",
    )
    report = steps.variance_report(src, _NZV)
    return report.select(
        "name",
        "n_distinct",
        r("freq_ratio").alias("freq_ratio"),
        r("distinct_share").alias("distinct_share"),
        F.coalesce(steps.near_zero(), F.lit(False)).alias("dropped"),
    )


@query("drop_sparse", "select o_orderkey, o_custkey, o_totalprice from orders")
def drop_sparse(t):
    src = t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_totalprice") < 0, 1).otherwise(0).alias("nearly_empty")
    )
    return steps.drop_sparse(["o_custkey", "o_totalprice", "nearly_empty"]).fit(src).transform(src)


@query(
    "label_encode",
    f"{_H} select id, case when quality is not null then cast(dense_rank() over (order by quality nulls last) - 1 as integer) end as quality from houses",
)
def label_encode(t):
    src = houses(t).select("id", "quality")
    return steps.label_encode("quality", ["id"]).fit(src).transform(src)


@query("type_conversion_steps", f"{_H} select id, coalesce(quality, 'None') as quality from houses")
def type_conversion_steps(t):
    src = houses(t).select("id", "quality")
    recipe = Pipeline(
        stages=[steps.keep_type("quality"), steps.fill_constant({"quality": "None"}), steps.keep_type("quality")]
    )
    return recipe.fit(src).transform(src)


# ---- splits ------------------------------------------------------------------------------------


def _hash_sql(col, seed):
    return f"cast('0x' || substr(md5({col} || ':{seed}'), 1, 8) as bigint)"


@query(
    "random_split",
    f"select o_orderkey, case when {_hash_sql('o_orderkey', 7)} < cast(floor(0.75::double * 4294967296) as bigint) then 'train' else 'holdout' end as part from orders",
)
def random_split(t):
    return resample.random_split(t.orders.select("o_orderkey"), "o_orderkey", 0.75, 7)


@query(
    "stratified_split",
    f"""with {LABELLED}, p as (select id, target, row_number() over (partition by target order by {_hash_sql('id', 11)}, id) as k,
        count(*) over (partition by target) as n from labelled) select id, target, case when k <= floor(n * 0.7::double) then 'train' else 'holdout' end as part from p""",
)
def stratified_split(t):
    return resample.stratified_split(labelled(t).select("id", "target"), "id", ["target"], 0.7, 11)


@query(
    "stratified_split_numeric",
    f"""with q as (select quantile_cont(o_totalprice, 0.25) as a, median(o_totalprice) as b, quantile_cont(o_totalprice, 0.75) as c from orders),
        s as (select o_orderkey, cast(1 + (o_totalprice > a)::int + (o_totalprice > b)::int + (o_totalprice > c)::int as integer) as bin from orders, q),
        p as (select o_orderkey, bin, row_number() over (partition by bin order by {_hash_sql('o_orderkey', 3)}, o_orderkey) as k, count(*) over (partition by bin) as n from s)
        select o_orderkey, bin, case when k <= floor(n * 0.25::double) then 'train' else 'holdout' end as part from p""",
)
def stratified_split_numeric(t):
    """Strata are the quartiles of the target."""
    src = t.orders.select("o_orderkey", "o_totalprice")
    marked = with_scalars(src, quantile_row(src, ["o_totalprice"], [0.25, 0.5, 0.75]))
    bins = resample.quartile_bin(F.col("o_totalprice"), F.col("__s.o_totalprice"))
    return resample.stratified_split(marked.select("o_orderkey", bins.alias("bin")), "o_orderkey", ["bin"], 0.25, 3)


@query("kfold", f"select o_orderkey, cast({_hash_sql('o_orderkey', 42)} % 5 as integer) as fold from orders")
def kfold(t):
    return resample.kfold(t.orders.select("o_orderkey"), "o_orderkey", 5, 42)


@query(
    "tail_validation",
    """with p as (select event_id, row_number() over (order by ts, event_id) as k, count(*) over () as n from events)
       select event_id, case when k > n - floor(n * 0.3::double) then 'validation' else 'train' end as part from p""",
)
def tail_validation(t):
    return resample.tail_validation(t.events.select("event_id", "ts"), ["ts", "event_id"], 0.3).select("event_id", "part")
