"""Sources, sinks, profile, column choice and derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import encode
from grainmill.operators import columns, profile
from grainmill.operators.scale import key_counts
from grainmill.plans.registry import query
from grainmill.plans.roles import HOUSES, RIDES, TWEETS, houses, r, rides, tweets
from grainmill.session import fresh_path
from grainmill.sources import files

# ---- sources and sinks -------------------------------------------------------------------------


@query("csv_scan", f"with {TWEETS} select id, keyword, location, text, target from tweets")
def csv_scan(t):
    path = fresh_path(t.spark, "csv_scan")
    files.write_csv(tweets(t).select("id", "keyword", "location", "text", "target"), path, rows_per_file=50_000)
    return files.read_csv(t.spark, path, "id long, keyword string, location string, text string, target int", multi_line=True)


@query("csv_sink", "select o_orderkey as id, round(o_totalprice * 0.9, 4) as sale_price from orders")
def csv_sink(t):
    path = fresh_path(t.spark, "csv_sink")
    scored = t.orders.select(
        F.col("o_orderkey").alias("id"), r(F.col("o_totalprice") * 0.9, 4).alias("sale_price")
    )
    files.write_csv(scored, path)
    return files.read_csv(t.spark, path, "id long, sale_price double")


@query(
    "vector_text_scan",
    """select 'w' || vec_id as word, d as dim, round(cast(embedding[d] as double), 6) + 0.0 as value
       from embeddings, generate_series(1, 64) as g(d)""",
)
def vector_text_scan(t):
    path = fresh_path(t.spark, "vectors")
    files.write_word_vectors(
        t.embeddings.select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")), path
    )
    vectors = files.read_word_vectors(t.spark, path)
    return vectors.select("word", F.posexplode("vec").alias("d", "v")).select(
        "word", (F.col("d") + 1).cast("long").alias("dim"), r("v").alias("value")
    )


@query("json_column", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_column(t):
    schema = files.infer_json_schema(t.events, "props")
    return files.json_columns(t.events, "props", schema).select("event_id", "k")


# ---- profile -----------------------------------------------------------------------------------


@query("profile_shape", "select count(*) as n_rows, 5 as n_columns from documents")
def profile_shape(t):
    return profile.shape(t.documents)


@query(
    "profile_types",
    """select 'bigint' as type, 2 as n_columns, cast(count(event_id) + count(user_id) as bigint) as n_values from events
       union all select 'string', 2, cast(count(event_type) + count(props) as bigint) from events
       union all select 'double', 1, count(value) from events
       union all select 'timestamp_ntz', 1, count(ts) from events""",
)
def profile_types(t):
    return profile.type_counts(t.events)


@query(
    "profile_glimpse",
    """with f as (select * from events order by event_id limit 5)
       select 'event_id' as name, 'bigint' as type, string_agg(cast(event_id as varchar), ', ' order by event_id) as first_values from f
       union all select 'event_type', 'string', string_agg(event_type, ', ' order by event_id) from f
       union all select 'props', 'string', string_agg(props, ', ' order by event_id) from f""",
)
def profile_glimpse(t):
    return profile.glimpse(t.events.select("event_id", "event_type", "props"), ["event_id"], 5)


@query("head_n", "select event_id, event_type, value from events order by event_id limit 10")
def head_n(t):
    return t.events.select("event_id", "event_type", "value").orderBy("event_id").limit(10)


# ---- choosing columns --------------------------------------------------------------------------


@query("select_drop", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def select_drop(t):
    return t.orders.drop("o_orderstatus", "o_orderdate")


@query("reorder_columns", "select o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def reorder_columns(t):
    return columns.to_front(t.orders.drop("o_orderdate"), ["o_totalprice"])


@query("select_by_type", "select o_orderkey, o_custkey, o_totalprice from orders")
def select_by_type(t):
    return columns.select_by_type(t.orders, "numeric")


@query(
    "select_by_name",
    "select l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, l_linestatus from lineitem",
)
def select_by_name(t):
    names = columns.columns_by_name(
        t.lineitem, matches="key$|flag$", contains="status", between=("l_extendedprice", "l_discount")
    )
    return t.lineitem.select(*names)


@query("rename_transmute", "select o_orderkey, o_totalprice as y_target from orders")
def rename_transmute(t):
    return t.orders.withColumnsRenamed({"o_totalprice": "y_target"}).select("o_orderkey", "y_target")


@query(
    "clean_names",
    """select o_orderkey as id, o_totalprice as sale_price, o_custkey as x1st_flr_sf, o_orderstatus as bsmt_fin_sf1,
              o_orderpriority as ms_zoning from orders""",
)
def clean_names(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("Id"),
        F.col("o_totalprice").alias("SalePrice"),
        F.col("o_custkey").alias("1stFlrSF"),
        F.col("o_orderstatus").alias("BsmtFinSF1"),
        F.col("o_orderpriority").alias("MSZoning"),
    )
    return columns.clean_names(raw)


# ---- deriving columns --------------------------------------------------------------------------


@query(
    "derive_arith",
    f"""with {HOUSES} select id, round(lot_frontage + liv_area, 6) as total_area, rooms + baths * cast(0.5 as double) as total_rooms,
        round(liv_area / nullif(rooms, 0), 6) as avg_room, yr_sold - year_built as age,
        cast((yr_sold - year_built) * (yr_sold - year_built) as bigint) as age2 from houses""",
)
def derive_arith(t):
    age = F.col("yr_sold") - F.col("year_built")
    return houses(t).select(
        "id",
        r(F.col("lot_frontage") + F.col("liv_area")).alias("total_area"),
        (F.col("rooms") + F.col("baths") * 0.5).alias("total_rooms"),
        r(F.try_divide("liv_area", "rooms")).alias("avg_room"),
        age.alias("age"),
        (age * age).cast("long").alias("age2"),
    )


@query(
    "row_sum_skipna",
    f"""with {HOUSES} select id, round(coalesce(lot_frontage, 0) + coalesce(lot_area, 0) + coalesce(rooms, 0), 2) as outside_area
        from houses""",
)
def row_sum_skipna(t):
    parts = [F.col(c) for c in ("lot_frontage", "lot_area", "rooms")]
    return houses(t).select("id", r(encode.row_sum(parts), 2).alias("outside_area"))


@query(
    "binary_flags",
    f"""with {HOUSES} select id, case when garage_yr > year_built then 1 when garage_yr <= year_built then 0 end as remodeled,
        case when garage_yr > year_built then 1 else 0 end as remodeled_np, case when yr_sold = year_built then 1 else 0 end as new
        from houses""",
)
def binary_flags(t):
    later = F.col("garage_yr") > F.col("year_built")
    return houses(t).select(
        "id",
        encode.flag(later).alias("remodeled"),
        encode.flag(later, missing_is_zero=True).alias("remodeled_np"),
        encode.flag(F.col("yr_sold") == F.col("year_built")).alias("new"),
    )


# fixed values: inclusive hour ranges and their names
TIMES_OF_DAY = [
    (0, 4, "late night"),
    (5, 10, "early morning"),
    (11, 16, "midday"),
    (17, 20, "evening"),
    (21, 23, "night"),
]
TIME_OF_DAY_SQL = """case when hour(datetime) between 0 and 4 then 'late night' when hour(datetime) between 5 and 10 then 'early morning'
  when hour(datetime) between 11 and 16 then 'midday' when hour(datetime) between 17 and 20 then 'evening'
  when hour(datetime) between 21 and 23 then 'night' end"""


@query("case_buckets", f"with {RIDES} select id, {TIME_OF_DAY_SQL} as time_of_day from rides")
def case_buckets(t):
    return rides(t).select("id", encode.buckets(F.hour("datetime"), TIMES_OF_DAY).alias("time_of_day"))


@query(
    "cast_categorical",
    f"with {HOUSES} select id, cast(yr_sold as varchar) as yr_sold, cast(garage_yr as varchar) as garage_yr from houses",
)
def cast_categorical(t):
    coded = columns.across(houses(t), ["yr_sold", "garage_yr"], lambda c: c.cast("string"))
    return coded.select("id", "yr_sold", "garage_yr")


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "ordinal_map",
    f"""with {HOUSES} select id, case coalesce(quality, 'None') when 'None' then 0 when '5-LOW' then 1 when '4-NOT SPECIFIED' then 2
        when '3-MEDIUM' then 3 when '2-HIGH' then 4 end as quality from houses""",
)
def ordinal_map(t):
    # '1-URGENT' is left out on purpose: a label outside the dictionary gives null
    codes = {"None": 0, "5-LOW": 1, "4-NOT SPECIFIED": 2, "3-MEDIUM": 3, "2-HIGH": 4}
    label = F.coalesce(F.col("quality"), F.lit("None"))
    return houses(t).select("id", encode.level_map(label, codes).alias("quality"))


@query(
    "unmapped_labels",
    f"""with {HOUSES} select quality as label, count(*) as n from houses
        where quality is not null and quality not in ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM') group by quality""",
)
def unmapped_labels(t):
    """Labels a level map would turn into null, with their counts."""
    codes = {"5-LOW": 1, "4-NOT SPECIFIED": 2, "3-MEDIUM": 3}
    h = houses(t).select(F.col("quality").alias("label"))
    lost = h.where(F.col("label").isNotNull() & encode.level_map(F.col("label"), codes).isNull())
    return key_counts(lost, ["label"])


@query(
    "ordered_factor_score",
    """select o_orderkey, case o_orderpriority when '5-LOW' then 1 when '4-NOT SPECIFIED' then 2 when '3-MEDIUM' then 3
       when '2-HIGH' then 4 end as score from orders""",
)
def ordered_factor_score(t):
    return t.orders.select(
        "o_orderkey", encode.level_position(F.col("o_orderpriority"), PRIORITIES[:4]).alias("score")
    )


@query(
    "index_to_label",
    f"with {RIDES} select id, case season when 1 then 'spring' when 2 then 'summer' when 3 then 'fall' end as season from rides",
)
def index_to_label(t):
    return rides(t).select("id", encode.level_label(F.col("season"), ["spring", "summer", "fall"]).alias("season"))


@query(
    "recode_values",
    f"""with {TWEETS} select id, case target when 0 then 'Non-disaster' when 1 then 'Disaster' end as target,
        case location when 'en' then 'English' else location end as location from tweets""",
)
def recode_values(t):
    return tweets(t).select(
        "id",
        encode.recode(F.col("target"), {0: "Non-disaster", 1: "Disaster"}).alias("target"),
        encode.recode(F.col("location"), {"en": "English"}).alias("location"),
    )


@query("pad_key", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as year_mo from orders")
def pad_key(t):
    return t.orders.select(
        "o_orderkey", encode.year_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("year_mo")
    )


@query(
    "na_if",
    """select o_orderkey, nullif(o_orderstatus, 'F') as o_orderstatus, nullif(o_orderpriority, 'F') as o_orderpriority
       from orders""",
)
def na_if(t):
    return columns.na_if(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "F")


@query(
    "across_columns",
    """select l_orderkey, l_linenumber, l_partkey, round(l_quantity * 100, 4) as l_quantity, round(l_discount * 100, 4) as l_discount,
       round(l_tax * 100, 4) as l_tax from lineitem""",
)
def across_columns(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    scaled = columns.across(t.lineitem, cols, lambda c: r(c * 100, 4))
    return scaled.select("l_orderkey", "l_linenumber", "l_partkey", *cols)


@query(
    "tag_source",
    f"with {TWEETS} select id, 'training' as set from tweets where target is not null union all select id, 'testing' from tweets where target is null",
)
def tag_source(t):
    w = tweets(t)
    train = columns.tag_source(w.where(F.col("target").isNotNull()), "training")
    test = columns.tag_source(w.where(F.col("target").isNull()), "testing")
    return train.unionByName(test).select("id", "set")


@query(
    "format_message",
    "select p_partkey, p_name || ' has size ' || p_size || ' and brand ' || p_brand as message from part",
)
def format_message(t):
    return t.part.select(
        "p_partkey", F.format_string("%s has size %d and brand %s", "p_name", "p_size", "p_brand").alias("message")
    )


@query(
    "build_table",
    "select o_orderkey as id, o_totalprice as actual, round(o_totalprice * 0.95 + 10, 4) as pred from orders",
)
def build_table(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("actual"),
        r(F.col("o_totalprice") * 0.95 + 10, 4).alias("pred"),
    )
