"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where it is the smallest of its neighbourhood a chunk ends. The cut
depends on the bytes around it alone, not on the cut before, so a passage that stands in two texts is cut alike
in both but for its first REACH + SHORTEST and last SHORTEST bytes. Chunks found before, in order of (doc_id,
hash of the text, place), are repeats.

Most chunks stand once. So the texts are cut twice: first to count digests and find where each stands first,
then to look up the repeated ones; nothing but numbers is shuffled, and no table of all chunks is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, free_name, lookup_once, numbered
from grainmill.llm.text import INNER, mix, steps

#: A cut has the smallest hash of so many places before and behind it, so chunks are longer than that, and twice as
#: long on average; a chunk ends at LONGEST bytes at the latest.
SHORTEST, LONGEST = 12, 128
#: Repeated stretches below this many code points are left alone.
MIN_SPAN = 100
#: The hash looks back over so many bytes, each moved on by SHIFT bits.
REACH, SHIFT = 16, 2
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << SHIFT) + GEAR[data[i]] in 32 bits, for all places at once by doubling the reach."""
    h = GEAR[data]
    reach = 1
    while reach < REACH:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(SHIFT * reach)
        h, reach = more, 2 * reach
    return h


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of h[i : i + width] for each i with so many behind it, by doubling the width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def cuts(data: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """Ends of the chunks of one text. Cuts never fall inside a character."""
    n = len(data)
    inner = INNER[data]
    h = gear_hashes(data[: n - 1])  # h[i]: of a cut before byte i + 1
    h[inner[1:]] = 0xFFFFFFFF
    edge = np.full(shortest, 0xFFFFFFFF, np.uint32)
    lows = _lowest(np.concatenate([edge, h, edge]), shortest)
    before, behind = lows[: len(h)], lows[shortest + 1 : shortest + 1 + len(h)]
    ends = np.flatnonzero((h <= before) & (h <= behind) & (h != 0xFFFFFFFF)) + 1
    if len(ends) and np.diff(ends).min(initial=shortest + 1) <= shortest:  # equal hashes: a short run of bytes over and over
        last, thin = -shortest, []
        for end in ends.tolist():
            if end - last > shortest:
                thin.append(end)
                last = end
        ends = np.array(thin)
    ends = np.append(ends, n)
    gaps = np.flatnonzero(np.diff(ends, prepend=0) > longest)
    if not len(gaps):
        return ends
    forced = []  # by the longest length alone
    for g in gaps.tolist():
        last = int(ends[g - 1]) if g else 0
        while ends[g] - last > longest:
            last += longest
            while inner[last]:
                last -= 1
            forced.append(last)
    return np.sort(np.append(ends, forced))


#: A chunk: its text's doc_id and hash, its place there in code points, and 12 bytes of its digest.
CHUNK = "doc long, body long, start int, size int, h1 long, h2 int"
DIGEST, PLACE = ["h1", "h2"], ["doc", "body", "start"]


def _chunked(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0), batch.column(1)
        for first, data, offsets in steps(batch.column(2)):
            text, start, size, digest = [], [], [], []
            for i in range(len(offsets) - 1):
                own = data[offsets[i] : offsets[i + 1]]
                if not len(own):
                    continue
                ends = cuts(own, shortest, longest)
                raw = own.tobytes()
                chars = np.concatenate([[0], np.cumsum(~INNER[own])])
                at = np.concatenate([[0], ends])
                text.append(np.full(len(ends), first + i))
                start.append(chars[at[:-1]])
                size.append(chars[ends] - chars[at[:-1]])
                digest += [hashlib.blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(at[:-1].tolist(), ends.tolist())]
            if text:
                own, parts = pa.array(np.concatenate(text)), np.frombuffer(b"".join(digest), [("h1", "<i8"), ("h2", "<i4")])
                columns = [*[k.take(own) for k in keys], np.concatenate(start).astype(np.int32), np.concatenate(size).astype(np.int32)]
                columns += [np.ascontiguousarray(parts["h1"]), np.ascontiguousarray(parts["h2"])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*PLACE, "size", *DIGEST])


def _named(docs: DataFrame) -> DataFrame:
    """(doc, body, text): what names a text, and the text. `body` tells apart rows of one doc_id with different texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), "text")


def repeated_spans(
    docs: DataFrame,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    min_span: int = MIN_SPAN,
) -> DataFrame:
    """One row per repeated stretch: doc_id, body (xxhash64 of the text), start, end (code points, end exclusive),
    n_chunks, and in first_doc_id the smallest document that holds one of its chunks first.

    A chunk is repeated if a chunk of the same digest (96 bits) stands at a smaller (doc_id, body, start). Neighbouring
    repeated chunks form a stretch; those of at least `min_span` code points are returned. A passage loses what lies
    before its first common cut and behind its last, so one not much longer than `min_span` may be left alone.

    Null or empty text and null doc_id: no rows. Rows that share a doc_id and a text count once; rows that share a
    doc_id alone are different texts, in the order of `body`. Other columns are not read. An empty table gives an
    empty result. One table of repeated digests is written and stays, as the result reads it.
    """
    texts = _named(docs).where("doc is not null and text <> ''")
    chunks = texts.mapInArrow(lambda it: _chunked(it, shortest, longest), CHUNK)
    seen = chunks.groupBy(*DIGEST).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = Shelf(docs.sparkSession).keep(seen, "seen")
    found = lookup_once(chunks, seen, DIGEST, "n", PLACE)
    again = found.where(F.struct(*PLACE) > F.col("first")).select(*PLACE, "size", F.col("first.doc").alias("first_doc"))
    order = Window.partitionBy("doc", "body").orderBy("start")
    runs = again.dropDuplicates(PLACE).withColumn("end", F.col("start") + F.col("size"))
    runs = runs.withColumn("opens", (F.lag("end", 1, -1).over(order) < F.col("start")).cast("long"))
    runs = runs.withColumn("run", F.sum("opens").over(order))
    spans = runs.groupBy("doc", "body", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("first_doc").alias("first_doc_id"),
    )
    return spans.where(F.col("end") - F.col("start") >= min_span).drop("run").withColumnRenamed("doc", "doc_id")


def cut_repeats(docs: DataFrame, **kinds) -> DataFrame:
    """`docs` with every repeated stretch taken out of `text`; other columns stay, whatever their names.

    What is repeated, and which rows count once, is as in `repeated_spans`: all rows that share a doc_id and a text lose
    the same stretches, rows that share a doc_id alone lose their own. Null or empty text and null doc_id: the row
    stays as it is. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, **kinds).groupBy(F.col("doc_id").alias("doc"), "body").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone")
    )
    gone = free_name(docs.columns, "gone")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    known = "doc is not null and row.text <> ''"
    found = rows.where(known).join(spans, ["doc", "body"], "left").select("row.*", F.col("gone").alias(gone))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if lost:
                    ends = [0, *[x["end"] for x in lost]]
                    starts = [*[x["start"] for x in lost], len(text)]
                    text = "".join([text[a:b] for a, b in zip(ends, starts)])
                out.append(text)
            cols = batch.columns[:-1]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    cut = numbered(found).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
    return cut.unionByName(rows.where(f"not coalesce({known}, false)").select("row.*"))
