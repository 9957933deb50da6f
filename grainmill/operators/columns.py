"""Choosing, naming and deriving columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of "numeric", "string" or "non_string" columns."""
    tests = {
        "numeric": lambda t: isinstance(t, T.NumericType),
        "string": lambda t: isinstance(t, T.StringType),
        "non_string": lambda t: not isinstance(t, T.StringType),
    }
    return [f.name for f in df.schema.fields if tests[kind](f.dataType)]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[f"`{c}`" for c in columns_of_type(df, kind)])


def columns_by_name(
    df: DataFrame,
    matches: str | None = None,
    contains: str | None = None,
    starts_with: str | None = None,
    one_of: Iterable[str] | None = None,
    between: tuple[str, str] | None = None,
) -> list[str]:
    """Names that meet any of the given tests, in table order."""
    keep = set()
    for i, name in enumerate(df.columns):
        if matches is not None and re.search(matches, name):
            keep.add(i)
        if contains is not None and contains in name:
            keep.add(i)
        if starts_with is not None and name.startswith(starts_with):
            keep.add(i)
        if one_of is not None and name in set(one_of):
            keep.add(i)
    if between is not None:
        low, high = (df.columns.index(b) for b in between)
        keep |= set(range(low, high + 1))
    return [df.columns[i] for i in sorted(keep)]


def to_front(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def clean_name(name: str) -> str:
    """snake_case form of a name; a leading digit gets an `x`."""
    words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
    words = re.sub(r"([a-z])([A-Z])", r"\1_\2", words)
    words = re.sub(r"([a-z])(\d+)(?=[A-Z])", r"\1\2_", words) if not name[:1].isdigit() else words
    words = re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower()
    if words[:1].isdigit():
        words = "x" + words
    return words or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """All names to unique snake_case; repeats get _2, _3, ..."""
    taken: set[str] = set()
    names = []
    for base in map(clean_name, df.columns):
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def across(df: DataFrame, cols: Iterable[str], f: Callable[[Column], Column], name: str = "{}") -> DataFrame:
    """One expression for many columns in a single projection; `name` is the pattern of the result name."""
    return df.withColumns({name.format(c): f(F.col(f"`{c}`")) for c in cols})


def na_if(df: DataFrame, value, cols: Iterable[str] | None = None) -> DataFrame:
    """`value` becomes missing in the given columns (default: all of the value's kind)."""
    if cols is None:
        cols = columns_of_type(df, "string" if isinstance(value, str) else "numeric")
    return across(df, cols, lambda c: F.when(c == F.lit(value), F.lit(None)).otherwise(c))


def tag_source(df: DataFrame, tag: str, name: str = "set") -> DataFrame:
    return df.withColumn(name, F.lit(tag))
