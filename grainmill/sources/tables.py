"""Access to a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """`Tables(spark, dir).orders` reads `dir/orders.parquet`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
