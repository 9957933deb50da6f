"""Building blocks that keep global order, quantiles, modes and key lookups spread over many tasks.

A rank over a whole table, an exact median or a join on one very frequent key would all pull their rows
into one task if written the short way. The functions here cut such work into ranges or slices first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.session import broadcast_bytes, broadcast_rows, fresh_path, order_buckets, shuffle_parts, stored_bytes, task_rows

SAMPLE_PER_BUCKET = 16
#: A frequent key is cut into slices of this part of a shuffle partition's fair share, so that partitions come out even.
SLICES_PER_PART = 16


def settle(df: DataFrame, name: str = "step", file_rows: int = 0) -> DataFrame:
    """Writes `df` under the shared folder and returns the written table, with `file_rows` rows a file at most, if given.

    For small or narrow intermediates that are read more than once: the work behind them is done a single
    time, a lost executor does not bring it back, and their real size is known to the next plan.
    """
    return _settled(df, name, file_rows)[0]


def _settled(df: DataFrame, name: str, file_rows: int = 0) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(stored: DataFrame) -> None:
    """Deletes a table that `settle` has written, once nothing reads it any more."""
    files = stored.inputFiles()
    if files:
        spark = stored.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Redistributes a plain table scan by a unique key if it has fewer partitions than there are cores.

    For work that is heavy per row (patterns, tokens) on a table stored in few pieces. A table in many
    pieces passes unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, key)


def fits_task(stored: DataFrame) -> bool:
    """Whether a written table is small enough for one task (its row count comes from file footers)."""
    return stored.count() <= task_rows(stored.sparkSession)


def scalars(row: DataFrame) -> Column:
    """The single row of `row` as a struct column, usable in any other table (a scalar subquery, no join)."""
    return row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns])).scalar()


def with_scalars(df: DataFrame, row: DataFrame, name: str = "__s") -> DataFrame:
    """Adds the single row of `row` to every row of `df` as struct column `name`."""
    return df.select("*", scalars(row).alias(name))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Join condition `left.key <=> right.<prefix>key` for all keys; null keys match each other."""
    tests = [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    return reduce(lambda a, b: a & b, tests)


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key combination (partial counts are summed before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def attach_by_key(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread_by: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Joins `stats` (one row per key, `weight` = how many of the rows have the key) to `rows`.

    `stats` is written first, so that its bytes and rows are known. Few enough are broadcast. Beyond that, keys with more than a
    slice, a sixteenth of a shuffle partition's fair share of the total weight, are split: rows are spread by a hash of
    `spread_by` (columns that identify a row) and the one `stats` row is copied once per slice. There are fewer such
    keys than slices, sixteen per shuffle partition, which bounds the broadcast list of heavy keys.
    """
    spark = stats.sparkSession
    stats, path = _settled(stats, "stats")
    parts = shuffle_parts(spark) * SLICES_PER_PART
    payload = [c for c in stats.columns if c not in keys and c != weight]
    if stored_bytes(spark, path) <= broadcast_bytes(spark) and stats.count() <= broadcast_rows(spark):
        right = F.broadcast(
            stats.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *payload)
        )
        joined = rows.join(right, same_keys(rows, right, keys, "__r_"), how)
        return joined.drop(*[f"__r_{k}" for k in keys])
    total = scalars(stats.agg(F.sum(weight).alias("t")))["t"]
    heavy = F.broadcast(
        stats.where(F.col(weight) * parts > total).select(
            *[F.col(k).alias(f"__h_{k}") for k in keys],
            F.ceil(F.col(weight) * parts / total).cast("int").alias("__slices"),
        )
    )
    cut = F.coalesce(F.col("__slices"), F.lit(1))
    left = rows.join(heavy, same_keys(rows, heavy, keys, "__h_"), "left").select(
        *[rows[c] for c in rows.columns],
        F.pmod(F.xxhash64(*[rows[c] for c in spread_by]), cut).cast("int").alias("__slice"),
    )
    right = stats.join(heavy, same_keys(stats, heavy, keys, "__h_"), "left").select(
        *[stats[k].alias(f"__r_{k}") for k in keys],
        *[stats[c].alias(c) for c in payload],
        F.explode(F.sequence(F.lit(0), cut - 1)).alias("__r_slice"),
    )
    on = same_keys(left, right, keys, "__r_") & (left["__slice"] == right["__r_slice"])
    # named, as files of short words look smaller to Spark than the driver finds them
    return left.join(right.hint("merge"), on, how).drop("__slice", "__r_slice", *[f"__r_{k}" for k in keys])


def _edges(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    """One row with the `buckets - 1` cut points of `key` and a coarse index over them.

    The sample is the keys with the smallest hashes: the same rows on every evaluation, at most
    `buckets * SAMPLE_PER_BUCKET` of them.
    """
    step = max(1, isqrt(buckets))
    sample = (
        df.select(key.alias("k"))
        .select("k", F.xxhash64("k").alias("h"))
        .orderBy("h", "k")
        .limit(buckets * SAMPLE_PER_BUCKET)
        .agg(F.sort_array(F.collect_list("k")).alias("s"))
    )
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.element_at("s", (F.floor(i * F.size("s") / buckets) + 1).cast("int")),
    )
    fine = sample.select(F.when(F.size("s") > 0, picks).otherwise(F.slice("s", 1, 0)).alias("fine"))
    return fine.select(
        "fine",
        F.filter("fine", lambda e, i: (i + 1) % step == 0).alias("coarse"),
        F.lit(step).alias("step"),
    )


def _bucketed(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    """Adds `__bucket`, the number of cut points not above `key`, found in two steps of sqrt(buckets)."""
    marked = with_scalars(df, _edges(df, key, buckets), "__e").withColumn("__k", key)
    below = lambda e: e <= F.col("__k")
    first = F.size(F.filter(F.col("__e.coarse"), below)) * F.col("__e.step")
    marked = marked.withColumn("__first", first)
    block = F.slice(F.col("__e.fine"), F.col("__first") + 1, F.col("__e.step"))
    bucket = F.col("__first") + F.size(F.filter(block, below))
    return marked.withColumn("__bucket", bucket).drop("__e", "__k", "__first")


def _bucket_starts(cut: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Per (by, bucket): own weight, weight of earlier buckets, total of the group. At most one row per
    bucket and group, whatever the number of rows."""
    sizes = cut.groupBy(*by, "__bucket").agg(F.sum(weight).alias("__size"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *[F.col(b).alias(f"__o_{b}") for b in by],
        F.col("__bucket").alias("__o___bucket"),
        "__size",
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"),
        F.sum("__size").over(group).alias("__total"),
    )


def _join_starts(cut: DataFrame, starts: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "__bucket"]
    joined = cut.join(starts, same_keys(cut, starts, keys, "__o_"))
    return joined.drop(*[f"__o_{k}" for k in keys])


def running_weight(
    df: DataFrame,
    order: Sequence[str],
    weight: str | None = None,
    by: Sequence[str] = (),
    before: str = "before",
    total: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds `before`: the summed `weight` (default 1 per row) of the rows of the same `by` group that
    come earlier in ascending `order`; optionally `total`, the sum over the group.

    `(by, order)` must identify a row. The order is cut into ranges over all groups together, so a group
    with a third of the rows also gets a third of the ranges, and no task sorts more than one range.
    The table is read three times; unless it is `stored` already, it is written once before. A small table
    skips all this and is sorted as it is.
    """
    src = df if stored else settle(df, "ordered")
    small = fits_task(src)
    src = src.withColumn("__w", F.lit(1).cast("long") if weight is None else F.col(weight))
    if small:
        group = Window.partitionBy(*by)
        earlier = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        out = src.withColumn(before, F.coalesce(F.sum("__w").over(earlier), F.lit(0)))
        if total:
            out = out.withColumn(total, F.sum("__w").over(group))
        return out.drop("__w")
    key = F.struct(*[F.col(c) for c in (*by, *order)])
    cut = _bucketed(src, key, order_buckets(df.sparkSession))
    joined = _join_starts(cut, _bucket_starts(cut, by, "__w"), by)
    inside = (
        Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (F.col("__start") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).alias(before)
    kept = [*df.columns, earlier, *([F.col("__total").alias(total)] if total else [])]
    return joined.select(*kept)


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    total: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds the 1-based position of each row in ascending `order`, within `by` groups if given."""
    placed = running_weight(df, order, by=by, before=name, total=total, stored=stored)
    return placed.withColumn(name, F.col(name) + 1)


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), type_: str = "double") -> DataFrame:
    """(by, name, value, n); missing values are counted too."""
    narrow = df.select(*by, *[F.col(f"`{c}`").cast(type_).alias(c) for c in cols])
    long = narrow.unpivot([F.col(b) for b in by], list(cols), "name", "value")
    return key_counts(long, [*by, "name", "value"])


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by, name, n, q): exact, linearly interpolated quantiles; `q` holds one value per probability.

    Values are counted first, ranges of values are then sized, and only ranges that hold a wanted rank
    are sorted. No task ever holds all values of a column or group.
    """
    return quantiles_of_counts(settle(value_counts(df, cols, by), "counts"), probs, by)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """`exact_quantiles` of a stored table (by, name, value, n) of values already counted."""
    small = fits_task(counts)
    counts = counts.where(F.col("value").isNotNull())
    group = [*by, "name"]
    if small:
        at = F.array(*[F.lit(float(p)) for p in probs])
        return counts.groupBy(*group).agg(
            F.sum("n").alias("n"), F.percentile("value", at, F.col("n")).alias("q")
        )
    key = F.struct(*[F.col(c) for c in (*group, "value")])
    cut = _bucketed(counts, key, order_buckets(counts.sparkSession))
    starts = _bucket_starts(cut, group, "n")

    def rank(p: float, up: bool) -> Column:
        at = (F.col("__total") - 1) * F.lit(float(p))
        return (F.ceil(at) if up else F.floor(at)).cast("long")

    wanted = [(i, up) for i in range(len(probs)) for up in (False, True)]

    def holds(start: Column, size: Column, i: int, up: bool) -> Column:
        r = rank(probs[i], up)
        return (start <= r) & (r < start + size)

    hit = reduce(lambda a, b: a | b, [holds(F.col("__start"), F.col("__size"), i, up) for i, up in wanted])
    near = _join_starts(cut, starts.where(hit), group)
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = near.withColumn("__before", F.col("__start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    picked = near.groupBy(*group).agg(
        F.max("__total").alias("__total"),
        *[
            F.max(F.when(holds(F.col("__before"), F.col("n"), i, up), F.col("value"))).alias(f"__v{i}{int(up)}")
            for i, up in wanted
        ],
    )

    def blend(i: int) -> Column:
        at = (F.col("__total") - 1) * F.lit(float(probs[i]))
        low, high = F.col(f"__v{i}0"), F.col(f"__v{i}1")
        return low + (high - low) * (at - F.floor(at))

    return picked.select(
        *group, F.col("__total").alias("n"), F.array(*[blend(i) for i in range(len(probs))]).alias("q")
    )


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row; column c holds the array of quantiles of column c (null if c has no values)."""
    long = exact_quantiles(df, cols, probs)
    return long.agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in cols])


def modes(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, value, n, rows): most frequent non-missing value per column, the smallest on a tie.

    Values are compared as strings. Built on counts per value, so a group never sits in one buffer.
    """
    counts = value_counts(df, cols, by, "string").where(F.col("value").isNotNull())
    best = F.struct(-F.col("n"), F.col("value"))
    return counts.groupBy(*by, "name").agg(
        F.min_by("value", best).alias("value"), F.max("n").alias("n"), F.sum("n").alias("rows")
    )
