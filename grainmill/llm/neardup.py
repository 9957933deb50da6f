"""MinHash near-duplicate detection by fast similarity sketching.

Each shingle is thrown into one of the sketch's bins, round after round; a bin keeps the smallest value of the
first round that reaches it. In as many further rounds as there are bins, round i throws all shingles into bin
i, so every coordinate of even the smallest set is filled. Bands of coordinates propose pairs, bitmaps and sketches
sort out pairs that are too far apart, and shared shingles of the full sets are counted for the rest.

Texts with equal sets are one class. Inside a bucket classes are first compared with one leader; links join
them to components, and only members of different components in one bucket go on being compared: with a
leader of its own for every bucket, and in the end all of them, in blocks. So a group of thousands of copies
costs its members, not its pairs, and no link between two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.components import components
from grainmill.llm.shelf import Shelf, lookup
from grainmill.llm.text import LOWER, mix, span_hashes, steps, word_spans

WIDTH = 5
SIMILARITY = 80
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Share of equal coordinates below which a pair is not verified; five standard deviations under 0.8.
SURE = 0.62
#: Bits onto which the shingles of a set are thrown. A bit that only one of two sets has stands for a shingle that
#: only one has, so bits that differ bound the shared shingles from above, without error.
BITS = 2048
#: Rounds with leaders of their own, before all remaining pairs of a bucket are compared.
ROUNDS = 2
#: Classes in one side of a block.
BLOCK = 512
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct hashes of the shingles) of every text. Words are runs of other than ASCII white
    space, A-Z lower-cased; fewer than `width` words are one shingle, no words an empty set."""
    for first, data, offsets in steps(texts):
        data = LOWER[data]
        start, end = word_spans(data, offsets)
        bounds = np.searchsorted(start, offsets)
        words = span_hashes(data, start, end)
        n = max(0, len(words) - width + 1)
        rolled = words[:n]
        for j in range(1, width):
            rolled = mix(rolled * _K + words[j : j + n])
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield first + i, np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix(np.array([short * _K + w]))[0]
                yield first + i, np.array([short])
            else:
                yield first + i, np.zeros(0, np.uint64)


def sketch(keys: np.ndarray) -> np.ndarray:
    """BINS filled coordinates of a non-empty set: round number in the upper, hash in the lower half."""
    out = np.full(BINS, _NONE)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    i = 0
    while i < 2 * BINS:
        most = BINS if i < BINS else 2 * BINS
        rounds = np.arange(i, min(most, i + max(1, 4 * BINS // len(keys))))
        h = mix(keys[None, :] + _SEEDS[rounds][:, None])
        if i < BINS:
            bins = ((h >> half) * np.uint64(BINS)) >> half
        else:
            bins = np.broadcast_to((rounds - BINS)[:, None], h.shape)
        values = (h & low) | (rounds.astype(np.uint64) << half)[:, None]
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        if (out != _NONE).all():
            return out
        i = int(rounds[-1]) + 1
    return out


def bitmap(keys: np.ndarray) -> bytes:
    out = np.zeros(BITS, bool)
    out[(keys % np.uint64(BITS)).astype(np.intp)] = True
    return np.packbits(out).tobytes()


SKETCHES = "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, bitmap binary"


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    other = np.uint64(0xA0761D6478BD642F)
    for batch in batches:
        n, s1, s2, sketches, bitmaps = [], [], [], [], []
        for _, keys in shingle_sets(batch.column(1), width):
            n.append(len(keys))
            s1.append(int(keys.sum(dtype=np.uint64).view(np.int64)))
            s2.append(int(mix(keys ^ other).sum(dtype=np.uint64).view(np.int64)))
            sketches.append(mix(sketch(keys)).astype(np.uint16).tobytes() if len(keys) else None)
            bitmaps.append(bitmap(keys) if len(keys) else None)
        arrays = [
            batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
            pa.array(sketches, pa.binary()), pa.array(bitmaps, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "s1", "s2", "sketch", "bitmap"])


def _band_keys(classes: DataFrame) -> DataFrame:
    """(rep, n, key), one row for each band of a sketch; a coordinate takes two bytes."""
    banded = classes.select("rep", F.col("n_shingles").alias("n"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    part = F.substring("sketch", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    return banded.select("rep", "n", F.xxhash64("band", part).alias("key"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, keys, held = [], [], 0
        for i, own in shingle_sets(batch.column(1), width):
            at.append(i)
            keys.append(own.view(np.int64))
            held += len(own)
            if held > 1 << 20 or i == batch.num_rows - 1:
                ids = batch.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.list_(pa.int64()))], names=["rep", "keys"])
                at, keys, held = [], [], 0


def _grid(column: pa.Array, kind: type) -> np.ndarray:
    """One row of numbers for each sketch or bitmap of a column."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if data else np.zeros((0, 1), kind)


def _may_link(n: np.ndarray, m: np.ndarray, bitmaps: tuple, sketches: tuple, similarity: int) -> np.ndarray:
    """Whether sets of `n` and `m` shingles may be linked, by bitmaps (without error) and then by sketches."""
    apart = np.bitwise_count(bitmaps[1] ^ bitmaps[0]).sum(1, dtype=np.int64)
    shared = (n + m - apart) // 2
    return (100 * shared >= similarity * (n + m - shared)) & ((sketches[1] == sketches[0]).sum(1) >= SURE * BINS)


def _close(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, an, b, bn) with bitmaps (ba, bb) and sketches (sa, sb), those that may be linked."""
    for batch in batches:
        sizes = [batch.column(x).to_numpy() for x in ("an", "bn")]
        pairs = [tuple(_grid(batch.column(x), kind) for x in y) for y, kind in ((("ba", "bb"), np.uint64), (("sa", "sb"), np.uint16))]
        yield batch.select(["a", "an", "b", "bn"]).filter(pa.array(_may_link(*sizes, *pairs, similarity)))


def _compared(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a block (rows sorted by block) that bitmaps allow, whose sketches are close and whose components differ."""
    names = ["a", "an", "b", "bn"]

    def pairs(block: dict) -> pa.RecordBatch | None:
        left, right = np.flatnonzero(block["side"] == 0), np.flatnonzero(block["side"] == 1)
        out = []
        for i in left:
            n, m = block["n"][i], block["n"][right]
            near = (block["label"][right] != block["label"][i]) & (
                100 * np.minimum(n, m) >= similarity * np.maximum(n, m)
            )
            near &= ~block["minor"][right] | (block["rep"][right] > block["rep"][i])
            found = right[near]
            for j in found[_may_link(n, m[near], *[(block[x][i], block[x][found]) for x in ("bitmap", "sketch")], similarity)]:
                a, b = (i, j) if block["rep"][i] < block["rep"][j] else (j, i)
                out.append((block["rep"][a], block["n"][a], block["rep"][b], block["n"][b]))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*out)], names=names)

    held = None
    for batch in batches:
        cols = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "i", "j", "side", "rep", "n", "label", "minor")}
        cols["sketch"], cols["bitmap"] = _grid(batch.column("sketch"), np.uint16), _grid(batch.column("bitmap"), np.uint64)
        if held is not None:
            cols = {x: np.concatenate([held[x], y]) for x, y in cols.items()}
        new = np.flatnonzero(np.any([cols[x][1:] != cols[x][:-1] for x in ("key", "i", "j")], axis=0)) + 1
        edges = [0, *new.tolist()]
        for a, b in zip(edges, edges[1:]):
            if (found := pairs({x: y[a:b] for x, y in cols.items()})) is not None:
                yield found
        held = {x: y[edges[-1] :] for x, y in cols.items()}
    if held is not None and (found := pairs(held)) is not None:
        yield found


def _sifted(pairs: DataFrame, marks: DataFrame, shelf: Shelf, similarity: int) -> DataFrame:
    """Pairs (a, an, b, bn) that may be linked, by the bitmaps and sketches in `marks`. `a` may be in any number of
    pairs, `b` in as many as there are bands."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    leaders = shelf.keep(counts.join(marks.toDF("a", "sa", "ba"), "a"), "leaders")
    both = lookup(pairs, leaders, ["a"], "c").join(marks.toDF("b", "sb", "bb"), "b")
    return both.mapInArrow(lambda it: _close(it, similarity), "a long, an long, b long, bn long")


def _links(pairs: DataFrame, sets: DataFrame, shelf: Shelf, similarity: int) -> DataFrame:
    """Pairs (a, an, b, bn) that hold on the full sets. The set of a frequent `a` meets its partners in parts."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = lookup(pairs, counts.withColumn("n", F.col("c")), ["a"], "n")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 64)))
    # Written, so that Spark knows how few they are and need not shuffle all sets for them.
    dealt = shelf.keep(dealt, "dealt")
    left = dealt.select("a", "part").distinct().join(sets.withColumnsRenamed({"rep": "a", "keys": "ka"}), "a")
    right = dealt.join(sets.withColumnsRenamed({"rep": "b", "keys": "kb"}), "b")
    both = right.join(left, ["a", "part"]).withColumn("common", F.size(F.array_intersect("ka", "kb")).cast("long"))
    close = F.col("common") * 100 >= (F.col("an") + F.col("bn") - F.col("common")) * similarity
    return both.where(close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`.

    Two documents are linked if their sets of `width`-word shingles share at least `similarity` percent of
    their union; component_id is the smallest doc_id that links lead to, kept marks that document itself. A pair
    at 80 percent shares a band with a chance of 1 - 5e-8 and more above; what bands propose is settled exactly.

    Null or empty text, or one of white space: an empty set, linked with nothing. Fewer words than `width`: one
    shingle of them all. Null doc_id: component_id null, kept. Rows that share a doc_id are linked. Other columns
    are not read. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    sketched = shelf.keep(texts.mapInArrow(lambda it: _sketched(it, width), SKETCHES), "sketched")
    of_set = ["s1", "s2", "n_shingles"]
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*of_set).agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("rows"),
        F.first("sketch").alias("sketch"),
        F.first("bitmap").alias("bitmap"),
    )
    classes = shelf.keep(classes, "classes")
    narrow = shelf.keep(sketched.select("doc_id", *of_set), "narrow")
    shelf.drop("sketched")
    reps = shelf.keep(classes.select(*of_set, "rep", "rows"), "reps")
    banded = _band_keys(classes)
    size_fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * similarity
    leader = lambda order: F.min(F.struct(order, "rep", "n")).alias("lead")
    buckets = banded.groupBy("key").agg(leader(F.col("rep").alias("o")), F.count(F.lit(1)).alias("c"))
    buckets = shelf.keep(buckets.where("c > 1"), "buckets")
    members = shelf.keep(lookup(banded, buckets, ["key"], "c"), "members")
    wanted = shelf.keep(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    marks = classes.select(F.col("rep").alias("doc_id"), "sketch", "bitmap").join(wanted, "doc_id", "left_semi")
    marks = shelf.keep(marks.withColumnRenamed("doc_id", "rep"), "marks")
    shelf.drop("classes", "buckets")
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, width), "rep long, keys array<long>")
    sets = shelf.keep(sets, "sets")

    def star(rows: DataFrame) -> DataFrame:
        led = rows.where("rep <> lead.rep").where(size_fits(F.col("n"), F.col("lead.n")))
        return led.select("lead.rep", "lead.n", "rep", "n").toDF("a", "an", "b", "bn").distinct()

    def linked(close: DataFrame, name: str) -> DataFrame:
        found = shelf.keep(_links(shelf.keep(close, "close"), sets, shelf, similarity), name)
        shelf.drop("close", "dealt")
        return found

    def linked_stars(rows: DataFrame, name: str) -> DataFrame:
        found = linked(_sifted(shelf.keep(star(rows), "stars"), marks, shelf, similarity), name)
        shelf.drop("stars", "leaders")
        return found

    links = linked_stars(members, "links0")
    bare = members.select("key", "rep", "n")

    def mixed(order) -> DataFrame:
        """Members of buckets with more than one component, with a leader of the bucket."""
        labels = components(links).withColumnsRenamed({"node": "rep", "component": "label"})
        rows = bare.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        rows = shelf.keep(rows, "labelled")
        open_ = rows.groupBy("key").agg(
            F.min(F.struct(order, "rep", "n", "label")).alias("lead"),
            F.count(F.lit(1)).alias("c"),
            F.min("label").alias("l1"),
            F.max("label").alias("l2"),
        )
        open_ = shelf.keep(open_.where("l1 < l2").drop("l1", "l2"), "open")
        return lookup(rows, open_, ["key"], "c")

    for i in range(1, ROUNDS + 1):
        rows = mixed(F.xxhash64("rep", "key", F.lit(i)).alias("o")).where("label <> lead.label")
        found = linked_stars(rows, f"links{i}")
        links = shelf.keep(links.union(found).distinct(), f"all{i}")

    rows = shelf.keep(mixed(F.lit(0).alias("o")).select("key", "rep", "n", "label"), "rest")
    groups = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("g"))
    major = groups.groupBy("key").agg(F.max(F.struct("g", "label")).alias("top"), F.sum("g").alias("total"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    major = major.select(
        "key", F.col("top.label").alias("major"), "total",
        blocks(F.col("total") - F.col("top.g")).alias("ni"), blocks(F.col("total")).alias("nj"),
    )
    rows = lookup(rows, shelf.keep(major, "major"), ["key"], "total").join(marks, "rep")
    rows = rows.withColumns({"minor": F.col("label") != F.col("major"), "h": F.xxhash64("rep")})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    data = ["rep", "n", "label", "minor", "sketch", "bitmap"]
    left = rows.where("minor").select("key", F.pmod("h", "ni").alias("i"), F.explode(upto("nj")).alias("j"), F.lit(0).alias("side"), *data)
    right = rows.select("key", F.explode(upto("ni")).alias("i"), F.pmod("h", "nj").alias("j"), F.lit(1).alias("side"), *data)
    dealt = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    close = dealt.mapInArrow(lambda it: _compared(it, similarity), "a long, an long, b long, bn long").distinct()
    links = shelf.keep(links.union(linked(close, "last")).distinct(), "all")
    labels = components(links).withColumnsRenamed({"node": "rep", "component": "label"})
    joined = reps.join(labels, "rep", "left")
    settled = shelf.keep(joined.select(*of_set, "rows", F.coalesce("label", "rep").alias("component")), "settled")
    judged = lookup(narrow.where("doc_id is not null"), settled, of_set, "rows", "left")
    judged = judged.unionByName(narrow.where("doc_id is null").withColumn("component", F.lit(None).cast("long")))
    component = F.coalesce("component", "doc_id")
    return judged.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """`docs` without the documents that are not the smallest of their component."""
    gone = near_duplicates(docs, width, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
