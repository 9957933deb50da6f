"""Written intermediates in the shared folder, and key lookups that keep very frequent keys spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import fresh_path


class Shelf:
    """Tables that one run of an operator writes under the shared folder, each deleted once it is used up.

    A written table is what later steps read, so a lost executor brings back no work from before it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and returns the written table; a table of the same name is forgotten, not deleted."""
        self.paths[name] = path = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def free_name(taken: Sequence[str], name: str) -> str:
    """`name`, lengthened until no column of `taken` has it; Spark's names do not mind case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ...: Arrow stages take no names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Joins `table` (one row per key; `weight`: how many of `rows` hold the key) to `rows`.

    Keys with more than half a shuffle partition's fair share of the rows go by broadcast: there are fewer
    than two per shuffle partition, which bounds what is sent. All other keys are joined by shuffle, where
    no key can make a task much longer. Both tables are read twice, so pass written ones. Null keys match nothing.
    """
    keys = list(keys)
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * (2 * shuffle_parts(rows.sparkSession)) > F.lit(total)
    frequent = table.where(hot)
    if frequent.isEmpty():
        return rows.join(table.drop(weight), keys, how)
    found = rows.join(F.broadcast(frequent.drop(weight)), keys)
    rest = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    return found.unionByName(rest.join(table.where(~hot).drop(weight), keys, how))


def lookup_once(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, spread_by: Sequence[str]) -> DataFrame:
    """Inner join of `table` (written, one row per key; `weight`: how many of `rows` hold the key) to `rows`, read once.

    A key with more than half a shuffle partition's fair share of the weight is cut into slices of that size: its rows
    are dealt by a hash of `spread_by`, its row of `table` stands once per slice. There are fewer than two such keys
    per shuffle partition, which bounds the list that is sent to every task. The plan is the same at every size.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    share = F.col(weight) * (2 * shuffle_parts(rows.sparkSession))
    slices = F.when(share > total, F.ceil(share / F.lit(max(total, 1)))).otherwise(1).cast("int")
    frequent = F.broadcast(table.where(share > total).select(*keys, slices.alias("slices")))
    dealt = F.pmod(F.xxhash64(*spread_by), F.coalesce("slices", F.lit(1))).cast("int")
    left = rows.join(frequent, list(keys), "left").withColumn("slice", dealt).drop("slices")
    right = table.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop(weight)
    return left.join(right, [*keys, "slice"]).drop("slice")
