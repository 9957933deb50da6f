"""Line dedup: levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. The lines of a batch are joined with the runs of all
earlier batches; a line whose hash is in a run has been seen in a smaller document. What the batch sees
for the first time becomes a new sorted run. Two runs of one level are merged into one of the next level,
so there are never more runs than levels. Results do not depend on where batches are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, free_name, lookup, numbered

BATCHES = 4
MIN_CHARS = 10
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, body, pos, h1, h2) of every line that is long enough; two hashes make 128 bits.

    `body` tells apart rows of one doc_id with different texts.
    """
    split = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("body"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    keyed = split.select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _cuts(docs: DataFrame, batches: int) -> list:
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares).alias("at")).first()["at"] if shares else None
    return sorted(set(found or []))


def repeated_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, body, pos) of the lines whose key stands in a document of smaller doc_id."""
    shelf = Shelf(docs.sparkSession)
    lines = shelf.keep(_lines(docs, min_chars), "lines")
    cuts = _cuts(docs, batches)
    levels: list[list[str]] = []
    tables: dict[str, DataFrame] = {}
    dropped = []

    def add_run(run: DataFrame, name: str, level: int) -> None:
        tables[name] = shelf.keep(run.sortWithinPartitions(*HASH), name)
        if level == len(levels):
            levels.append([])
        levels[level].append(name)
        if len(levels[level]) == 2:
            both, levels[level] = levels[level], []
            merged = reduce(DataFrame.unionByName, [tables.pop(x) for x in both])
            add_run(merged.repartition(*HASH), f"{name}m", level + 1)
            shelf.drop(*both)

    for i in range(len(cuts) + 1):
        inside = F.lit(True)
        if i:
            inside = inside & (F.col("doc") > cuts[i - 1])
        if i < len(cuts):
            inside = inside & (F.col("doc") <= cuts[i])
        batch = lines.where(inside)
        firsts = batch.groupBy(*HASH).agg(
            F.min("doc").alias("owner"), (F.min("doc") < F.max("doc")).alias("shared"), F.count(F.lit(1)).alias("n")
        )
        runs = [tables[x] for level in levels for x in level]
        if runs:
            seen = reduce(DataFrame.unionByName, runs).withColumn("seen", F.lit(True))
            firsts = firsts.join(seen, HASH, "left")
        else:
            firsts = firsts.withColumn("seen", F.lit(None).cast("boolean"))
        firsts = shelf.keep(firsts, f"firsts{i}")
        repeats = lookup(batch, firsts.where("seen or shared").drop("shared"), HASH, "n")
        gone = repeats.where(F.col("seen").isNotNull() | (F.col("doc") != F.col("owner")))
        dropped.append(shelf.keep(gone.select("doc", "body", "pos"), f"dropped{i}"))
        add_run(firsts.where("seen is null").select(*HASH), f"run{i}", 0)
        shelf.drop(f"firsts{i}")
    shelf.drop("lines", *[x for level in levels for x in level])
    return reduce(DataFrame.unionByName, dropped)


def _assemble(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Takes the lines at the listed positions (last column) out of the text in column `at`."""
    for batch in batches:
        texts, gone = batch.column(at), batch.column(batch.num_columns - 1)
        out, counts, sizes = [], [], []
        for text, drop in zip(texts, gone):
            text, drop = text.as_py() or "", set(drop.as_py() or ())
            lines = text.split("\n")
            out.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text)
            sizes.append(len(lines))
            counts.append(len(drop))
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        cols[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [*names, "n_lines", "n_dropped"]
        )


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least
    `min_chars` code points keeps its lines only in the smallest doc_id that holds it, all of them there.

    Null or empty text: one empty line, text "". Rows that share a doc_id are one document. Null doc_id:
    the row stays as it is and is compared with nothing. Columns named n_lines or n_dropped are replaced,
    all others stay, whatever their names.
    An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, body, lost = (free_name(docs.columns, x) for x in ("doc", "body", "gone"))
    gone = repeated_lines(docs, batches, min_chars).groupBy(F.col("doc").alias(doc), F.col("body").alias(body)).agg(
        F.collect_set("pos").alias(lost)
    )
    marked = docs.withColumns({doc: F.col("doc_id"), body: F.xxhash64("text")})
    joined = marked.join(gone, [doc, body], "left").select(*[F.col(f"`{c}`") for c in docs.columns], lost)
    names, at = docs.columns, docs.columns.index("text")
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return numbered(joined).mapInArrow(lambda it: _assemble(it, at, names), f"{fields}, n_lines long, n_dropped long")
