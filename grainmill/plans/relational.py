"""Filters, joins, windows, orders, unions, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as tx
from grainmill.operators import joins, profile, reshape, rows, textmine, windows
from grainmill.operators.columns import tag_source
from grainmill.operators.scale import key_counts, row_positions
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, LABELLED, RIDES, TWEETS, houses, labelled, r, rides, texts, tweets
from grainmill.plans.words import STOP_ENGLISH, STOP_OTHER, STOP_SQL, tokens_sql

# ---- filters -----------------------------------------------------------------------------------



def _outlier():
    return (F.col("lot_frontage") > 200) & (F.col("sale_price") < 200_000)


@query(
    "filter_outliers",
    f"with {HOUSES} select id, lot_frontage, sale_price from houses where not (lot_frontage > 200 and sale_price < 200000)",
)
def filter_outliers(t):
    return rows.drop_where(houses(t), _outlier(), keep_null=False).select("id", "lot_frontage", "sale_price")


@query(
    "filter_outliers_keep_null",
    f"with {HOUSES} select id, lot_frontage, sale_price from houses where not coalesce(lot_frontage > 200 and sale_price < 200000, false)",
)
def filter_outliers_keep_null(t):
    return rows.drop_where(houses(t), _outlier(), keep_null=True).select("id", "lot_frontage", "sale_price")


@query("filter_not_null", f"with {TWEETS} select id, keyword from tweets where keyword is not null and target is null")
def filter_not_null(t):
    return tweets(t).where(F.col("keyword").isNotNull() & F.col("target").isNull()).select("id", "keyword")


@query(
    "drop_incomplete",
    f"with {HOUSES} select id, lot_frontage, zoning, quality from houses where lot_frontage is not null and zoning is not null and quality is not null",
)
def drop_incomplete(t):
    cols = ["lot_frontage", "zoning", "quality"]
    return rows.drop_incomplete(houses(t).select("id", *cols), cols)


@query(
    "filter_group_size",
    f"with {TWEETS}, {tokens_sql('tweets')} select id, word from (select id, word, count(*) over (partition by word) as n from tokens) where n > 10",
)
def filter_group_size(t):
    words = tweets(t).select("id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "word"))
    return rows.filter_group_size(words, ["word"], 10, ["id", "pos"]).select("id", "word")


@query(
    "filter_by_length",
    f"with {TWEETS}, {tokens_sql('tweets')} select word, count(*) as n from tokens where length(word) > 2 group by word",
)
def filter_by_length(t):
    long = textmine.unnest_tokens(texts(t)).where(F.char_length("word") > 2)
    return key_counts(long, ["word"])


@query(
    "slice_rows",
    """with p as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as pos from orders)
       select o_orderkey, o_totalprice, pos from p where pos between 1 and 10 or pos between 101 and 150""",
)
def slice_rows(t):
    cols = t.orders.select("o_orderkey", "o_totalprice")
    return rows.slice_rows(cols, ["o_totalprice", "o_orderkey"], keep=[(1, 10), (101, 150)])


@query(
    "slice_rows_negative",
    """with p as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as pos from orders)
       select o_orderkey, o_totalprice, pos from p where pos > 1""",
)
def slice_rows_negative(t):
    cols = t.orders.select("o_orderkey", "o_totalprice")
    return rows.slice_rows(cols, ["o_totalprice", "o_orderkey"], drop=[(1, 1)])


@query(
    "rare_column_filter",
    """select * from (select 'l_discount' as name, round(avg(case when l_discount = 0 then 1.0::double else 0 end), 6) as zero_share from lineitem
       union all select 'l_tax', round(avg(case when l_tax = 0 then 1.0::double else 0 end), 6) from lineitem
       union all select 'l_quantity', round(avg(case when l_quantity = 0 then 1.0::double else 0 end), 6) from lineitem) where zero_share > 0.01""",
)
def rare_column_filter(t):
    stats = profile.zero_fraction(t.lineitem, ["l_discount", "l_tax", "l_quantity"])
    return stats.where(F.col("zero_share") > 0.01).select("name", r("zero_share").alias("zero_share"))


# ---- joins -------------------------------------------------------------------------------------


@query(
    "left_join_lookup",
    """with regions as (select distinct n_nationkey, n_regionkey from nation where n_nationkey % 5 <> 3)
       select c_custkey, c_nationkey, n_regionkey from customer left join regions on c_nationkey = n_nationkey""",
)
def left_join_lookup(t):
    regions = t.nation.where(F.col("n_nationkey") % 5 != 3)
    regions = regions.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return joins.lookup(t.customer.select("c_custkey", "c_nationkey"), regions, "c_nationkey")


@query(
    "anti_join_stopwords",
    f"with {TWEETS}, {tokens_sql('tweets')} select word, count(*) as n from tokens where word not in ({STOP_SQL}) group by word",
)
def anti_join_stopwords(t):
    kept = textmine.without_stopwords(textmine.unnest_tokens(texts(t)), STOP_ENGLISH, STOP_OTHER)
    return key_counts(kept, ["word"])


@query(
    "semi_join_ids",
    f"""with {TWEETS}, {tokens_sql("tweets")}, f as (select word from tokens group by word having count(*) > 500)
        select id, keyword, target from tweets where id in (select id from tokens where word in (select word from f))""",
)
def semi_join_ids(t):
    w = tweets(t)
    frequent = textmine.prune_vocabulary(textmine.vocabulary(w), term_count_min=501)
    kept = textmine.restrict_to_vocabulary(textmine.doc_term_counts(w), frequent)
    return joins.keep_ids(w.select("id", "keyword", "target"), kept, "id")


@query(
    "cross_join_grid",
    """with s as (select distinct c_mktsegment from customer), b as (select distinct p_type from part),
       l(penalty) as (values (0.001::double), (0.01), (0.1))
       select c_mktsegment, p_type, penalty from s, b, l""",
)
def cross_join_grid(t):
    segments = joins.level_row(t.customer, ["c_mktsegment"])
    types = joins.level_row(t.part, ["p_type"])
    lists = segments.withColumn("p_type", types.scalar())
    return joins.expand_grid(joins.value_lists(lists, {"penalty": [0.001, 0.01, 0.1]}))


@query(
    "bind_columns",
    "select o_orderkey as id, o_totalprice as truth, round(o_totalprice * 1.01, 4) as estimate from orders",
)
def bind_columns(t):
    truth = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("truth"))
    preds = t.orders.select(F.col("o_orderkey").alias("id"), r(F.col("o_totalprice") * 1.01, 4).alias("estimate"))
    return joins.bind_columns(truth, preds, "id")


@query(
    "group_stat_join",
    f"""with {HOUSES} select id, neighborhood, round(median(sale_price) over (partition by neighborhood), 4) as median_sp from houses""",
)
def group_stat_join(t):
    h = houses(t).select("id", "neighborhood", "sale_price")
    out = windows.attach_group_median(h, ["neighborhood"], "sale_price", "median_sp", ["id"])
    return out.select("id", "neighborhood", r("median_sp", 4).alias("median_sp"))


# ---- windows -----------------------------------------------------------------------------------


@query(
    "prop_within_group",
    f"""with {LABELLED}, c as (select target, case when regexp_matches(text, '#') then 1.0::double else 0 end as has_tag, count(*) as n
        from labelled group by all) select target, has_tag, n, round(n / sum(n) over (partition by target), 6) as prop from c""",
)
def prop_within_group(t):
    counts = key_counts(
        labelled(t).select("target", tx.has_match(F.col("text"), "#").alias("has_tag")), ["target", "has_tag"]
    )
    return windows.share_within(counts, ["target"]).withColumn("prop", r("prop"))


@query(
    "top_n_ties",
    f"""with {LABELLED}, {tokens_sql("labelled", "id, target")}, c as (select target, word, count(*) as n from tokens group by all)
        select target, word, n from (select *, rank() over (partition by target order by n desc) as k from c) where k <= 20""",
)
def top_n_ties(t):
    counts = key_counts(textmine.unnest_tokens(labelled(t), keep=["id", "target"]), ["target", "word"])
    return windows.top_n_ties(counts, ["target"], "n", 20)


@query(
    "first_row_per_key",
    f"""with {TWEETS} select id, keyword, location, text from (select *, row_number() over (partition by location, text order by id) as k
        from tweets) where k = 1""",
)
def first_row_per_key(t):
    w = tweets(t).select("id", "keyword", "location", "text")
    return windows.first_row_per_key(w, ["location", "text"], ["id"])


@query(
    "fill_group_median",
    f"""with {HOUSES} select id, round(coalesce(lot_frontage, median(lot_frontage) over (partition by neighborhood)), 6) as lot_frontage from houses""",
)
def fill_group_median(t):
    h = houses(t).select("id", "neighborhood", "lot_frontage")
    filled = windows.fill_group_median(h, ["neighborhood"], "lot_frontage", ["id"])
    return filled.select("id", r("lot_frontage").alias("lot_frontage"))


@query(
    "quantile_tiers",
    f"""with {HOUSES}, m as (select neighborhood, median(sale_price) over (partition by neighborhood) as md from houses),
        q as (select quantile_cont(md, 0.2) as lo, quantile_cont(md, 0.8) as hi from m)
        select distinct neighborhood, round(md, 4) as median_sp,
        case when md > hi then 2 when md between lo and hi then 1 when md < lo then 0 end as wealth from m, q""",
)
def quantile_tiers(t):
    tiers = windows.quantile_tiers(houses(t), ["neighborhood"], "sale_price")
    return tiers.select("neighborhood", r("median", 4).alias("median_sp"), F.col("tier").alias("wealth"))


@query(
    "row_numbering",
    f"""with {TWEETS}, s as (select id, case when target is null then 'testing' else 'training' end as set from tweets)
        select id, set, row_number() over (order by set, id) as pos from s""",
)
def row_numbering(t):
    tagged = tweets(t).select("id", F.when(F.col("target").isNull(), "testing").otherwise("training").alias("set"))
    return row_positions(tagged, ["set", "id"])


# ---- orders ------------------------------------------------------------------------------------


@query("order_by_multi", f"with {TWEETS} select id, keyword, target from tweets")
def order_by_multi(t):
    return rows.order_by(
        tweets(t).select("id", "keyword", "target"), ("target", "desc"), ("keyword", "asc"), ("id", "asc")
    )


@query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10")
def top_k(t):
    return rows.top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", "asc"), ("o_orderkey", "asc"))


@query(
    "order_levels_by_first",
    f"""with {HOUSES}, b as (select neighborhood, max(sale_price) as best from houses group by 1)
        select neighborhood, best, row_number() over (order by best desc, neighborhood) as place from b""",
)
def order_levels_by_first(t):
    return rows.levels_by_first(houses(t), "neighborhood", "sale_price")


@query(
    "order_within_group",
    f"""with {LABELLED}, {tokens_sql("labelled", "id, target")}, c as (select target, word, count(*) as n from tokens group by all)
        select target, word, n, row_number() over (partition by target order by n, word) as pos from c""",
)
def order_within_group(t):
    counts = key_counts(textmine.unnest_tokens(labelled(t), keep=["id", "target"]), ["target", "word"])
    return row_positions(counts, ["n", "word"], by=["target"])


# ---- unions ------------------------------------------------------------------------------------


@query(
    "union_by_name",
    f"""with {TWEETS} select id, text, target, 'training' as set from tweets where target is not null
        union all select id, text, null, 'testing' from tweets where target is null""",
)
def union_by_name(t):
    w = tweets(t)
    train = tag_source(w.where(F.col("target").isNotNull()).select("id", "text", "target"), "training")
    test = tag_source(w.where(F.col("target").isNull()).select("text", "id"), "testing")
    return rows.stack(train, test)


@query("distinct_rows", f"with {HOUSES} select distinct neighborhood, status from houses")
def distinct_rows(t):
    return houses(t).select("neighborhood", "status").distinct()


# ---- reshaping ---------------------------------------------------------------------------------


@query(
    "unpivot_long",
    f"""with {RIDES} select id, 'temp' as name, cast(temp as double) as value from rides union all select id, 'windspeed', windspeed from rides
        union all select id, 'casual', case when casual > 0 then casual end from rides""",
)
def unpivot_long(t):
    some = rides(t).withColumn("casual", F.when(F.col("casual") > 0, F.col("casual")))
    return reshape.to_long(some, ["temp", "windspeed", "casual"], ["id"], "double")


@query(
    "complete_grid",
    f"""with {LABELLED}, c as (select keyword, toxic as target, count(*) as n from labelled where keyword is not null and not (keyword = 'src3' and toxic = 1) group by all),
        g as (select * from (select distinct target from c), (select distinct keyword from c))
        select g.target, g.keyword, coalesce(n, 0) as n from g left join c on g.target = c.target and g.keyword = c.keyword""",
)
def complete_grid(t):
    some = labelled(t).where(F.col("keyword").isNotNull())
    some = some.where(~((F.col("keyword") == "src3") & (F.col("toxic") == 1)))
    counts = key_counts(some.select("keyword", F.col("toxic").alias("target")), ["keyword", "target"])
    return reshape.complete_counts(counts, "target", "keyword")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummies(levels):
    return ", ".join(f"case when c_mktsegment = '{v}' then 1 else 0 end as c_mktsegment_{v.lower()}" for v in levels)


@query("one_hot_full", f"select c_custkey, {_dummies(_SEGMENTS)} from customer")
def one_hot_full(t):
    levels = reshape.learn_levels(t.customer, "c_mktsegment")
    return reshape.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", levels)


@query("one_hot_drop_first", f"select c_custkey, {_dummies(_SEGMENTS[1:])} from customer")
def one_hot_drop_first(t):
    levels = reshape.learn_levels(t.customer, "c_mktsegment")
    return reshape.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", levels, drop_first=True)


_PIVOT_WORDS = ["the", "and", "la", "der", "que"]


@query(
    "pivot_counts",
    f"with {TWEETS}, {tokens_sql('tweets')} select id, "
    + ", ".join(f"cast(sum(case when word = '{w}' then 1 else 0 end) as bigint) as {w}" for w in _PIVOT_WORDS)
    + " from tokens group by id having count(*) filter (where word in ('the', 'and', 'la', 'der', 'que')) > 0",
)
def pivot_counts(t):
    return reshape.pivot_counts(textmine.doc_term_counts(texts(t)), _PIVOT_WORDS)


@query(
    "split_by_group",
    f"""with {LABELLED} select target, count(*) as n, round(avg(length(text)), 6) as mean_chars, max(length(text)) as max_chars from labelled group by target""",
)
def split_by_group(t):
    return (
        labelled(t)
        .groupBy("target")
        .agg(
            F.count(F.lit(1)).alias("n"),
            r(F.avg(F.char_length("text"))).alias("mean_chars"),
            F.max(F.char_length("text")).cast("long").alias("max_chars"),
        )
    )
