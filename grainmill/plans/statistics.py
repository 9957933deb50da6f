"""Aggregation, missing-value reports, shape statistics, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions.numeric import CENTRE, SHOULDER, TAIL
from grainmill.operators import profile, stats
from grainmill.operators.scale import key_counts
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, LABELLED, RIDES, TWEETS, houses, labelled, r, rides, tweets
from grainmill.plans.words import tokens_sql
from grainmill.operators.textmine import unnest_tokens

# ---- groups ------------------------------------------------------------------------------------


@query(
    "group_summary",
    f"with {RIDES} select season, round(avg(count), 6) as mean, round(stddev_samp(count), 6) as sd, cast(sum(count) as bigint) as sum from rides group by season",
)
def group_summary(t):
    return stats.group_summary(rides(t), ["season"], "count").select(
        "season", r("mean").alias("mean"), r("sd").alias("sd"), "sum"
    )


@query(
    "share_of_total",
    f"with {RIDES} select season, cast(sum(count) as bigint) as sum, round(sum(count) / (select sum(count) from rides), 6) as prop from rides group by season",
)
def share_of_total(t):
    return stats.share_of_total(rides(t), ["season"], "count").withColumn("prop", r("prop"))


@query("group_count", f"with {TWEETS} select keyword, target, count(*) as n from tweets group by keyword, target")
def group_count(t):
    return key_counts(tweets(t), ["keyword", "target"])


@query(
    "count_sorted",
    f"with {LABELLED}, {tokens_sql('labelled', 'target')} select target, word, count(*) as n from tokens group by all order by n desc, target, word",
)
def count_sorted(t):
    return stats.count_sorted(unnest_tokens(labelled(t), keep=["target"]), ["target", "word"])


# ---- missing values ----------------------------------------------------------------------------

_MISSING = ["lot_area", "lot_frontage", "quality", "zoning", "garage_yr", "status"]
_MISSING_SQL = " union all ".join(
    f"select '{c}' as name, cast(sum(case when {c} is null then 1 else 0 end) as bigint) as n_missing, count(*) as n from houses"
    for c in _MISSING
)


@query("null_counts", f"with {HOUSES}, m as ({_MISSING_SQL}) select name, n_missing from m where n_missing > 0")
def null_counts(t):
    return profile.null_counts(houses(t), _MISSING)


@query(
    "null_percent",
    f"""with {HOUSES}, m as ({_MISSING_SQL}) select name, round(round_even(n_missing / n, 4) * 100, 6) as pct_r,
        round(round_even(n_missing / n * 100, 2), 6) as pct_pandas from m""",
)
def null_percent(t):
    h = houses(t)
    a = profile.null_percent(h, _MISSING, "r").select("name", r("pct_missing").alias("pct_r"))
    b = profile.null_percent(h, _MISSING, "pandas").select("name", r("pct_missing").alias("pct_pandas"))
    return a.join(b, "name")


@query(
    "null_counts_by_group",
    f"""with {TWEETS}, s as (select *, case when target is null then 'testing' else 'training' end as set from tweets)
        select set, 'keyword' as name, cast(sum(case when keyword is null then 1 else 0 end) as bigint) as n_missing from s group by set union all
        select set, 'location', cast(sum(case when location is null then 1 else 0 end) as bigint) from s group by set union all
        select set, 'text', cast(sum(case when text is null then 1 else 0 end) as bigint) from s group by set""",
)
def null_counts_by_group(t):
    tagged = tweets(t).withColumn("set", F.when(F.col("target").isNull(), "testing").otherwise("training"))
    return profile.null_counts_by_group(tagged, ["set"], ["keyword", "location", "text"])


@query(
    "null_count_histogram",
    f"with {HOUSES}, m as ({_MISSING_SQL}) select n_missing, count(*) as n_columns from m group by n_missing",
)
def null_count_histogram(t):
    return profile.null_count_histogram(houses(t).select(*_MISSING))


@query(
    "total_nulls",
    f"""with {HOUSES}, m as ({_MISSING_SQL}) select cast(sum(n_missing) as bigint) as n_missing,
        count(*) filter (where n_missing > 0) as n_columns_missing from m""",
)
def total_nulls(t):
    return profile.total_nulls(houses(t).select(*_MISSING))


# ---- location and shape ------------------------------------------------------------------------


@query(
    "five_number",
    """select min(value) as min, round(quantile_cont(value, 0.25), 6) as q1, round(median(value), 6) as median,
       round(avg(value), 6) as mean, round(quantile_cont(value, 0.75), 6) as q3, max(value) as max from events""",
)
def five_number(t):
    five = stats.five_number(t.events, "value")
    return five.select("min", r("q1").alias("q1"), r("median").alias("median"), r("mean").alias("mean"), r("q3").alias("q3"), "max")


@query(
    "group_median_quantile",
    """select event_type, round(median(value), 6) as median, round(quantile_cont(value, 0.8), 6) as q80 from events group by event_type""",
)
def group_median_quantile(t):
    return stats.group_quantiles(t.events, ["event_type"], "value", [0.5, 0.8]).select(
        "event_type", r(F.get("q", 0)).alias("median"), r(F.get("q", 1)).alias("q80")
    )


@query("group_quantile_approx")
def group_quantile_approx(t):
    """The sketch variant: bounded memory and one shuffle, for when an error of 1 in 10,000 ranks is fine."""
    return t.events.groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.8], 10_000).alias("q"))


@query(
    "group_mode",
    f"""with {HOUSES}, c as (select neighborhood, quality, count(*) as n from houses where quality is not null group by all)
        select neighborhood, quality as value, n from (select *, row_number() over (partition by neighborhood order by n desc, quality) as k from c) where k = 1""",
)
def group_mode(t):
    return stats.group_mode(houses(t), ["neighborhood"], "quality")


def _skew_sql(table, col):
    return f"""select '{col}' as name, round((avg(power({col} - m, 3))) / power(avg(power({col} - m, 2)), 1.5), 6) as skew
               from {table}, (select avg({col}) as m from {table})"""


@query(
    "skewness_scan",
    f"""with {HOUSES}, s as ({' union all '.join(_skew_sql('houses', c) for c in ('sale_price', 'lot_area', 'liv_area', 'rooms', 'balance', 'baths'))})
        select * from s where skew > 0.2""",
)
def skewness_scan(t):
    found = stats.skewness_scan(houses(t), ["sale_price", "lot_area", "liv_area", "rooms", "balance", "baths"])
    return found.where(F.col("skew") > 0.2).select("name", r("skew").alias("skew"))


@query("skewness_adjusted", "select count(value) as n, round(skewness(value), 6) as skew from events")
def skewness_adjusted(t):
    return stats.skewness_adjusted(t.events, "value").withColumn("skew", r("skew"))


# ---- correlation -------------------------------------------------------------------------------

_NUMERIC = ["sale_price", "lot_area", "lot_frontage", "liv_area", "rooms", "baths", "balance"]


@query(
    "corr_matrix",
    f"with {HOUSES} "
    + " union all ".join(
        f"select '{b}' as x, '{a}' as y, round(corr({a}, {b}), 6) + 0.0 as r from houses"
        for i, a in enumerate(_NUMERIC)
        for b in _NUMERIC[i + 1 :]
    ),
)
def corr_matrix(t):
    return stats.corr_matrix(houses(t), _NUMERIC).withColumn("r", r("r"))


@query(
    "corr_with_target",
    f"with {HOUSES}, c as ("
    + " union all ".join(f"select '{a}' as name, corr({a}, sale_price) as r from houses" for a in _NUMERIC[1:])
    + ") select name, round(r, 6) + 0.0 as r from c order by c.r, name limit 4",
)
def corr_with_target(t):
    return stats.corr_with_target(houses(t), _NUMERIC[1:], "sale_price", 4).withColumn("r", r("r"))


# ---- values, bins, densities -------------------------------------------------------------------


@query(
    "distinct_values",
    """select distinct 'o_orderstatus' as name, o_orderstatus as value from orders union all
       select distinct 'o_orderpriority', o_orderpriority from orders union all
       select distinct 'o_custkey', cast(o_custkey as varchar) from orders""",
)
def distinct_values(t):
    return stats.distinct_values(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "zero_fraction",
    "select 'l_discount' as name, round(sum(case when l_discount = 0 then 1 else 0 end) / count(*), 6) as zero_share from lineitem union all "
    "select 'l_tax', round(sum(case when l_tax = 0 then 1 else 0 end) / count(*), 6) from lineitem union all "
    "select 'l_suppkey', round(sum(case when l_suppkey = 0 then 1 else 0 end) / count(*), 6) from lineitem",
)
def zero_fraction(t):
    return profile.zero_fraction(t.lineitem, ["l_discount", "l_tax", "l_suppkey"]).withColumn("zero_share", r("zero_share"))


_BINS = "least(cast(floor((value - lo) / (hi - lo) * {n}) as integer) + 1, {n})"


@query(
    "histogram",
    f"""with g as (select min(value) as lo, max(value) as hi from events),
        b as (select event_type, {_BINS.format(n=50)} as bin, lo, hi from events, g)
        select event_type, bin, round(any_value(lo + (hi - lo) / 50 * (bin - 1)), 6) as lo, round(any_value(lo + (hi - lo) / 50 * bin), 6) as hi,
        count(*) as n from b group by event_type, bin""",
)
def histogram(t):
    found = stats.histogram(t.events, "value", 50, ["event_type"])
    return found.select("event_type", "bin", r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query(
    "density_estimate",
    f"""with g as (select min(value) as lo, max(value) as hi from events),
        b as (select event_type, {_BINS.format(n=100)} as bin, count(*) as n from events, g group by 1, 2),
        m as (select event_type, lo + (hi - lo) / 100 * (bin - 0.5::double) as mid, n from b, g),
        s as (select event_type, count(*) as total, 0.9::double * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34::double)
              * power(count(*), -0.2::double) as h from events group by event_type),
        p as (select cast(i as integer) as point, lo + (hi - lo) * i / 63 as x from g, range(64) as u(i))
        select s.event_type, point, round(x, 6) as x,
        round(sum(n * exp(-0.5::double * power((x - mid) / h, 2)) / sqrt(2 * pi())) / any_value(total * h), 8) + 0.0 as density
        from s join m on s.event_type = m.event_type, p group by s.event_type, point, x""",
)
def density_estimate(t):
    found = stats.density_estimate(t.events, "value", ["event_type"])
    return found.select("event_type", "point", r("x").alias("x"), r("density", 8).alias("density"))


@query(
    "boxplot_stats",
    """with q as (select event_type, quantile_cont(value, 0.25) as q1, median(value) as med, quantile_cont(value, 0.75) as q3 from events group by 1),
       f as (select e.event_type, value, q1, med, q3, value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1) as inside
             from events e join q on e.event_type = q.event_type)
       select event_type, round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3, min(value) filter (where inside) as low,
       max(value) filter (where inside) as high, count(*) filter (where not inside) as n_outliers from f group by event_type, q1, med, q3""",
)
def boxplot_stats(t):
    found = stats.boxplot_stats(t.events, ["event_type"], "value")
    return found.select(
        "event_type", r("q1").alias("q1"), r("median").alias("median"), r("q3").alias("q3"), "low", "high", "n_outliers"
    )


@query(
    "value_by_group_long",
    f"""with {RIDES} select season, 'casual' as name, cast(sum(casual) as double) as sum, cast(max(casual) as double) as max from rides group by season
        union all select season, 'registered', sum(registered), max(registered) from rides group by season""",
)
def value_by_group_long(t):
    return stats.measures_by_group(rides(t), ["season"], ["casual", "registered"])


@query(
    "ecdf",
    """with c as (select value, count(*) as n from events group by value)
       select value, n, round(sum(n) over (order by value) / (select count(*) from events), 6) as share from c""",
)
def ecdf(t):
    return stats.ecdf(t.events, "value").withColumn("share", r("share"))


def _poly_sql(x, parts):
    def one(cs):
        out = repr(cs[-1]) + "::double"
        for c in reversed(cs[:-1]):
            out = f"({out} * {x} + {c!r}::double)"
        return out

    return f"({one(parts[0])} / {one(parts[1])})"


@query(
    "qq_points",
    f"""with p as (select event_id, value, row_number() over (order by value, event_id) as i, count(*) over () as n from events),
        w as (select event_id, value, case when i = n then power(0.5::double, 1.0::double / n) when i = 1 then 1 - power(0.5::double, 1.0::double / n)
              else (i - 0.3175::double) / (n + 0.365::double) end as position from p),
        u as (select *, position - 0.5::double as q, sqrt(-ln(case when position < 0.5::double then position else 1 - position end)) as s,
              0.180625::double - (position - 0.5::double) * (position - 0.5::double) as c from w)
        select event_id, value, round(position, 9) as position, round(case when abs(q) <= 0.425::double then q * {_poly_sql('c', CENTRE)}
        else sign(q) * case when s <= 5 then {_poly_sql('(s - 1.6::double)', SHOULDER)} else {_poly_sql('(s - 5)', TAIL)} end end, 6) + 0.0 as normal from u""",
)
def qq_points(t):
    found = stats.qq_points(t.events, "value", "event_id")
    return found.select("event_id", "value", r("position", 9).alias("position"), r("normal").alias("normal"))


@query(
    "simple_line_fit",
    """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by l_returnflag""",
)
def simple_line_fit(t):
    found = stats.line_fit(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"])
    return found.select("l_returnflag", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"))


@query(
    "negbin_fit",
    f"""with {RIDES}, m as (select avg(count) as mu, var_samp(count) as v from rides) select round(mu, 6) as mu,
        round(case when v > mu then mu * mu / (v - mu) end, 6) as size from m""",
)
def negbin_fit(t):
    return stats.negative_binomial_fit(rides(t), "count").select(r("mu").alias("mu"), r("size").alias("size"))


@query(
    "concat_agg_word_len",
    f"""with {LABELLED}, p as (select target, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) as piece from labelled
        where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') select target, round(avg(length(piece)), 6) as mean_word_len from p group by target""",
)
def concat_agg_word_len(t):
    return stats.mean_word_length(labelled(t), ["target"]).withColumn("mean_word_len", r("mean_word_len"))


@query(
    "extreme_row",
    "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders order by o_totalprice, o_orderkey limit 1",
)
def extreme_row(t):
    return stats.extreme_row(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_totalprice", ["o_orderkey"]
    )
