"""Where written intermediates go."""

from types import SimpleNamespace

import pytest

from grainmill.operators.scale import attach_by_key, key_counts
from grainmill.session import fresh_path, order_buckets, shared_dir


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_a_cluster_must_name_its_folder():
    nothing = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: nothing))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_ranges_follow_the_shuffle_partitions(spark):
    assert order_buckets(spark) == 16
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    assert order_buckets(spark) == 2000
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hot_key_is_joined_in_slices(spark):
    """With a third of the rows on one key, no joined partition holds more than a small part of them."""
    spark.conf.set("grainmill.broadcast.bytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.range(30000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as k")
        out = attach_by_key(rows, key_counts(rows, ["k"], "n"), ["k"], "n", ["id"], "inner").where("k = -1")
        per_task = [r["count"] for r in out.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
        assert sum(per_task) == 10000 and max(per_task) < 1000
    finally:
        spark.conf.unset("grainmill.broadcast.bytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
