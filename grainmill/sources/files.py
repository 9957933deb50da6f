"""CSV and word-vector files, JSON text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, null_value: str = "NA",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with header. Empty cells and `null_value` are missing. Large files are read in parallel parts; with
    `multi_line` quoted cells may hold line breaks, and each file is read by one task.

    Give a schema for anything large: without one Spark reads the file twice to infer it.
    """
    reader = (
        spark.read.option("header", True)
        .option("nullValue", null_value)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, null_value: str = "NA", rows_per_file: int = 0) -> None:
    """CSV folder with header and no index, one file per partition. Where cells hold line breaks, which a reader
    cannot split, `rows_per_file` keeps files small; 0 sets no bound."""
    (
        df.write.option("header", True)
        .option("nullValue", null_value)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines `word v1 ... vn` as (word, vec array<float>)."""
    parts = F.split("value", " ", -1)
    return (
        spark.read.text(path)
        .select(parts.alias("p"))
        .select(
            F.element_at("p", 1).alias("word"),
            F.slice("p", F.lit(2), F.size("p") - 1).cast("array<float>").alias("vec"),
        )
    )


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec") -> None:
    """The reverse of `read_word_vectors`."""
    line = F.concat_ws(" ", F.col(word), F.array_join(F.col(vec).cast("array<string>"), " "))
    df.select(line.alias("value")).write.text(path)


def infer_json_schema(df: DataFrame, col: str) -> str:
    """Schema text with the fields of ALL rows, found in one aggregate. A field whose values have no common type
    and one that is always null are strings, decimals are doubles. Text that does not parse is passed over."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col))).first()[0]
    if not found or not found.startswith("OBJECT<"):
        raise ValueError(f"no common object in the values of {col} to learn a schema from")
    found = re.sub(r"\bOBJECT<", "STRUCT<", found)
    return re.sub(r"\b(VARIANT|VOID)\b(?!:)", "STRING", re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", found))


def json_columns(df: DataFrame, col: str, schema: str | T.StructType, prefix: str = "") -> DataFrame:
    """Adds one column per top-level field of the JSON text in `col`; text that does not parse gives nulls."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema.removeprefix("STRUCT<").removesuffix(">"))
    parsed = F.from_json(F.col(col), schema)
    fields: dict[str, Column] = {f"{prefix}{f.name}": parsed.getField(f.name) for f in schema.fields}
    return df.withColumns(fields)
