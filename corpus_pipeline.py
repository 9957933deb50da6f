"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import lines, mixing, neardup, packing, quality
from grainmill.llm.queries import offer
from grainmill.llm.shelf import Shelf

#: The quality bands and the sketches of the stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs).where("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id has."""
    return lines.drop_repeated_lines(docs).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one of smallest id."""
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


#: Columns that stages read; all others are carried along under names that clash with nothing.
READ = ("doc_id", "text", "source")


def _stage(fn, keeps: bool = True):
    """`fn` as a stage. If it `keeps` the columns of its documents, these come back under their names, in their order.

    Null and empty texts, null and repeated doc_ids and an empty table are treated as the operator of the stage says.
    """

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        offer(spark)
        if not keeps:
            return fn(spark, docs, sf_dir)
        plain = [c if c in READ else f"extra{i}" for i, c in enumerate(docs.columns)]
        return fn(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*docs.columns)

    return stage


STAGES = [
    ("quality rules", _stage(keep_good)),
    ("line dedup", _stage(drop_lines)),
    ("near-duplicates", _stage(drop_near)),
    ("mixing", _stage(mix)),
    ("packing", _stage(pack, keeps=False)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage reads what the one before has written. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = shelf.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            shelf.drop(f"stage{i - 1}")
    return docs
