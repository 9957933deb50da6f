"""The roles the test tables play: houses, tweets, rides. Each has the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scale import spread
from grainmill.sources.tables import Tables


def r(col: Column | str, places: int = 6) -> Column:
    """Rounded double for comparison with SQL; adding zero turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), places) + F.lit(0.0)


def houses(t: Tables) -> DataFrame:
    """One row per order, with its line items summed up and its customer; some values removed by rule."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("liv_area"),
        F.max("l_extendedprice").alias("lot_area"),
        F.count(F.lit(1)).alias("rooms"),
        F.sum(F.when(F.col("l_discount") == 0, 1).otherwise(0)).alias("baths"),
    )
    o, c = t.orders, t.customer
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    return joined.select(
        k.alias("id"),
        F.col("o_totalprice").alias("sale_price"),
        "lot_area",
        F.when(k % 11 != 0, F.col("liv_area")).alias("lot_frontage"),
        "liv_area",
        F.col("rooms").alias("rooms"),
        F.col("baths").alias("baths"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("quality"),
        F.when(k % 17 != 0, F.col("c_mktsegment")).alias("zoning"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_nationkey").alias("neighborhood"),
        F.year("o_orderdate").alias("yr_sold"),
        F.month("o_orderdate").alias("mo_sold"),
        (F.lit(1960) + k % 40).cast("int").alias("year_built"),
        F.when(k % 19 != 0, (F.lit(1965) + k % 35).cast("int")).alias("garage_yr"),
        F.col("c_acctbal").alias("balance"),
    )


HOUSES = """
lines as (
  select l_orderkey, sum(l_quantity) as liv_area, max(l_extendedprice) as lot_area,
         count(*) as rooms, cast(sum(case when l_discount = 0 then 1 else 0 end) as bigint) as baths
  from lineitem group by l_orderkey),
houses as (
  select o_orderkey as id, o_totalprice as sale_price, lot_area,
         case when o_orderkey % 11 <> 0 then liv_area end as lot_frontage, liv_area, rooms, baths,
         case when o_orderkey % 13 <> 0 then o_orderpriority end as quality,
         case when o_orderkey % 17 <> 0 then c_mktsegment end as zoning,
         o_orderstatus as status, c_nationkey as neighborhood,
         cast(year(o_orderdate) as integer) as yr_sold, cast(month(o_orderdate) as integer) as mo_sold,
         cast(1960 + o_orderkey % 40 as integer) as year_built,
         case when o_orderkey % 19 <> 0 then cast(1965 + o_orderkey % 35 as integer) end as garage_yr,
         c_acctbal as balance
  from orders left join lines on o_orderkey = l_orderkey left join customer on o_custkey = c_custkey)
"""


def tweets(t: Tables) -> DataFrame:
    """Documents with the class from `labels`; documents without a label are the test set."""
    d, y = spread(t.documents, "doc_id"), t.labels
    return d.join(y, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("keyword"),
        F.col("lang").alias("location"),
        "text",
        F.col("quality").alias("target"),
        "toxic",
    )


def texts(t: Tables) -> DataFrame:
    """The documents of `tweets` for queries that use no class: without the join to `labels`."""
    return spread(t.documents, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("location"), "text")


TWEETS = """
tweets as (
  select d.doc_id as id, case when d.doc_id % 7 <> 0 then source end as keyword, lang as location, text,
         quality as target, toxic
  from documents d left join labels y on d.doc_id = y.doc_id)
"""


def labelled(t: Tables) -> DataFrame:
    return tweets(t).where(F.col("target").isNotNull())


LABELLED = TWEETS + ", labelled as (select * from tweets where target is not null)\n"


def rides(t: Tables) -> DataFrame:
    """Events as hourly rentals: a time, codes for season and weather, three counts, two measures."""
    n = F.round("value").cast("int")
    casual = F.expr("cast((cast(round(value) as int) * (event_id % 5)) div 10 as int)")
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("datetime"),
        (F.col("user_id") % 4 + 1).cast("int").alias("season"),
        (F.col("user_id") % 3 + 1).cast("int").alias("weather"),
        F.when(F.dayofweek("ts").isin(1, 7), 0).otherwise(1).alias("workingday"),
        F.get_json_object("props", "$.k").cast("int").alias("temp"),
        F.col("value").alias("windspeed"),
        casual.alias("casual"),
        (n - casual).alias("registered"),
        n.alias("count"),
        F.col("event_type").alias("kind"),
    )


RIDES = """
rides as (
  select event_id as id, ts as datetime, cast(user_id % 4 + 1 as integer) as season,
         cast(user_id % 3 + 1 as integer) as weather,
         case when dayofweek(ts) in (0, 6) then 0 else 1 end as workingday,
         cast(json_extract_string(props, '$.k') as integer) as temp, value as windspeed,
         cast((cast(round(value) as integer) * (event_id % 5)) // 10 as integer) as casual,
         cast(cast(round(value) as integer) - (cast(round(value) as integer) * (event_id % 5)) // 10 as integer)
           as registered,
         cast(round(value) as integer) as count, event_type as kind
  from events)
"""
