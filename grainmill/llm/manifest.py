"""Merkle manifest of a table: a hash tree per group, a tree over the groups' roots, a proof for every row.

Rows are dealt to leaf partitions of bounded size that hold whole aligned blocks of leaves, so a partition knows
every node below its blocks. Only block roots and the few levels above them become a table of nodes. Each
partition then works out the smallest set of node coordinates that all its proofs together lack, fetches
them with one join, derives the interiors that its proofs share, and spells the single proofs out on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, lookup, shuffle_parts
from grainmill.operators.scale import row_positions

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: A block has FAN ** LEVELS leaves; a leaf partition has PART leaves and a block more, at most.
LEVELS = 6
PART = 4096
#: The tree over the groups' roots; no group is spelled like this.
TOP = ""
PROOF = "array<struct<left binary, right binary>>"


def spelled(value: Column) -> Column:
    """A value with its byte count in front, `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(v) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex digest) and its proof lead to."""
    side = lambda x: F.lower(F.hex(x))
    return F.aggregate(
        proof, leaf, lambda acc, s: F.sha2(F.concat(side(s["left"]), acc, side(s["right"])), 256)
    )


def siblings(proof: Column) -> Column:
    """All digests of a proof as hex text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")


def widths(n: int, fan: int) -> list[int]:
    """Nodes at each level of a tree over n leaves, up to the single one at its top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def missing(known: set[int], n: int, fan: int) -> Iterator[tuple[int, int]]:
    """(level, number) of the nodes that lead from the `known` leaves of a tree of n to its root and that they do not give."""
    for level, width in enumerate(widths(n, fan)[:-1]):
        runs = {j // fan for j in known}
        for r in runs:
            for j in range(r * fan, min(r * fan + fan, width)):
                if j not in known:
                    yield level, j
        known = runs


def climb(known: dict[int, bytes], n: int, fan: int, fetched: Mapping[tuple[int, int], bytes]):
    """(digest of the root, per level the steps of its nodes): a step is what stands left and right of a node in its run."""
    steps = []
    for level, width in enumerate(widths(n, fan)[:-1]):
        above, step = {}, {}
        for r in dict.fromkeys(j // fan for j in known):
            members = range(r * fan, min(r * fan + fan, width))
            run = [known[j] if j in known else fetched[level, j] for j in members]
            above[r] = sha256(b"".join([x.hex().encode() for x in run])).digest()
            for i, j in enumerate(members):
                if j in known:
                    step[j] = b"".join(run[:i]), b"".join(run[i + 1 :])
        steps.append(step)
        known = above
    return known[0], steps


def paths(steps: list[dict], behind: list, fan: int) -> dict[int, list]:
    """The steps from each leaf to the root, then `behind`."""
    out = {0: behind}
    for step in reversed(steps):
        out = {j: [s, *out[j // fan]] for j, s in step.items()}
    return out


class Part:
    """The leaves of one partition, in order: stretches of one tree each."""

    def __init__(self, leaves: pa.StructArray):
        self.leaves = leaves
        get = lambda name: leaves.field(name).to_numpy(zero_copy_only=False)
        self.index, self.top = get("index"), get("top")
        cuts = np.flatnonzero(np.diff(self.top)) + 1
        self.spans = list(zip([0, *cuts], [*cuts, len(self.top)]))
        self.names = leaves.field("tree")
        self.sizes = get("size")

    def trees(self):
        """(tree, number of the tree, its size, first leaf here, end leaf here, first row, end row)"""
        for a, b in self.spans:
            yield self.names[a].as_py(), int(self.top[a]), int(self.sizes[a]), int(self.index[a]), int(self.index[b - 1]) + 1, a, b


def _parts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            leaves = batch.column(batch.schema.names.index("leaves"))
            yield batch, i, Part(leaves.slice(i, 1).flatten())


def _rows(part: Part, name: str) -> list[bytes]:
    return part.leaves.field(name).to_pylist()


def _block_roots(batches: Iterator[pa.RecordBatch], fan: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Roots of the blocks of each partition; of a tree below a block's size its own root."""
    for _, _, part in _parts(batches):
        out = []
        digests = _rows(part, "leaf")
        for tree, top, n, first, _, a, b in part.trees():
            wide = widths(n, fan)
            level = min(levels, len(wide) - 1)
            own = digests[a:b]
            for _ in range(level):
                own = [sha256(b"".join([x.hex().encode() for x in own[i : i + fan]])).digest() for i in range(0, len(own), fan)]
            out += [(tree, top, level, first // fan**level + i, wide[level], x) for i, x in enumerate(own)]
        cols = list(zip(*out))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["tree", "top", "level", "node", "width", "digest"]
        )


def _requests(batches: Iterator[pa.RecordBatch], fan: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The coordinates that the proofs of a partition lack, each once."""
    for batch, i, part in _parts(batches):
        number = batch.column(0)[i].as_py()
        out, tops = [], set()
        for tree, top, n, first, end, _, _ in part.trees():
            tops.add(top)
            out += [(number, tree, level, j) for level, j in missing(set(range(first, end)), n, fan)]
        out += [(number, TOP, level, j) for level, j in missing(tops, groups, fan)]
        if out:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "tree", "level", "node"]
            )


def _expand(batches: Iterator[pa.RecordBatch], fan: int, groups: int, kept: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per leaf with its proof."""
    for batch, i, part in _parts(batches):
        got: dict[str, dict] = {}
        for x in batch.column(batch.schema.names.index("fetched"))[i].as_py() or ():
            got.setdefault(x["tree"], {})[x["level"], x["node"]] = x["digest"]
        digests = _rows(part, "leaf")
        below = []
        for tree, top, n, first, end, a, b in part.trees():
            known = dict(zip(range(first, end), digests[a:b]))
            below.append((top, first, end, *climb(known, n, fan, got.get(tree, {}))))
        root, steps = climb({x[0]: x[3] for x in below}, groups, fan, got.get(TOP, {}))
        tops = paths(steps, [], fan)
        flat, offsets, subroots = [], [0], []
        for top, first, end, subroot, own in below:
            found = paths(own, tops[top], fan)
            for j in range(first, end):
                flat += found[j]
                offsets.append(len(flat))
            subroots += [subroot.hex()] * (end - first)
        sides = pa.StructArray.from_arrays(
            [pa.array([x[k] for x in flat], pa.binary()) for k in (0, 1)], names=["left", "right"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                *[part.leaves.field(c) for c in kept],
                pa.array([x.hex() for x in digests]),
                pa.array(subroots, pa.string()),
                pa.array([root.hex()] * len(digests)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sides),
            ],
            names=[*kept, "leaf", "subroot", "root", "proof"],
        )


def _above(nodes: DataFrame, fan: int) -> DataFrame:
    """The level above nodes of trees that still have several at this one."""
    run = F.sort_array(F.collect_list(F.struct("node", "digest")))
    joined = F.array_join(F.transform(run, lambda x: F.lower(F.hex(x["digest"]))), "")
    grouped = nodes.where("width > 1").groupBy(
        "tree", "top", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan).alias("above"),
        F.ceil(F.col("width") / fan).alias("width"),
    )
    return grouped.agg(F.unhex(F.sha2(joined, 256)).alias("digest")).select(
        "tree", "top", "level", F.col("above").alias("node"), "width", "digest"
    )


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "source",
    id_: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
    fan: int = FAN,
    levels: int = LEVELS,
    part: int = PART,
) -> DataFrame:
    """(id_, carried columns, leaf, subroot, root, proof), one row per row of `docs`; digests are lower-case hex.

    A leaf is the SHA-256 of the row's `columns`, each spelled with its byte count. The leaves of a `group` in
    ascending order of `id_` make a tree of runs of `fan`; the trees' roots, ordered by group, make another one.
    `proof` lists for each level what stands left and right of the node in its run (empty for a run of one),
    so that `folded(leaf, proof)` is the root. `carry` adds narrow columns computed from the row.

    A null group is a group of its own and comes first; null ids come first in their group. Equal ids are ordered
    by leaf, so repeated rows change nothing but the number of leaves. Empty and null texts differ. Columns that
    are not named are not read, whatever they are called. An empty table gives an empty result.
    """
    shelf, spark = Shelf(docs.sparkSession), docs.sparkSession
    column = lambda c: F.col(f"`{c}`")
    carry = carry or {}
    rows = docs.select(
        column(group).cast("string").alias("name"),
        spelled(column(group)).alias("tree"),
        column(id_).alias("id"),
        F.unhex(leaf_digest([column(c) for c in columns])).alias("leaf"),
        *[c.alias(f"carried{i}") for i, c in enumerate(carry.values())],
    )
    rows = shelf.keep(rows, "leaves")
    order = ["name", "id", "leaf"]
    # the last key only keeps rows that are equal in all others from falling into one range
    dealt = rows.withColumn("twin", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(shuffle_parts(spark), *order, "twin").sortWithinPartitions(*order)
    ordered = shelf.keep(dealt.drop("twin", "name").withColumn("at", F.monotonically_increasing_id()), "ordered")
    shelf.drop("leaves")
    piece = F.shiftright("at", 33)
    sizes = ordered.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as many as there are shuffle partitions
    starts = sizes.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    placed = ordered.withColumn("piece", piece).join(F.broadcast(starts), "piece")
    placed = placed.withColumn("place", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("piece", "start", "at")
    groups = placed.groupBy("tree").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("weight")
    )
    groups = shelf.keep(row_positions(shelf.keep(groups, "sized"), ["first"], name="top", stored=True), "groups")
    shelf.drop("sized")
    n_groups = groups.count()
    longest = groups.agg(F.max("size")).first()[0] or 0
    block = fan**levels
    placed = lookup(placed, groups, ["tree"], "weight").withColumn("index", F.col("place") - F.col("first"))
    head = F.col("first") + F.floor(F.col("index") / block) * block
    kept = ["id", *[f"carried{i}" for i in range(len(carry))]]
    entry = F.struct("place", "tree", (F.col("top") - 1).alias("top"), "size", "index", "leaf", *kept)
    parts = placed.groupBy(F.floor(head / part).alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("leaves"))
    parts = shelf.keep(parts, "parts")
    shelf.drop("ordered", "groups")

    fields = "tree string, top long, level int, node long, width long, digest binary"
    nodes = [shelf.keep(parts.mapInArrow(lambda it: _block_roots(it, fan, levels), fields), "roots")]
    for _ in range(max(0, len(widths(longest, fan)) - 1 - levels) if longest else 0):
        nodes.append(shelf.keep(_above(nodes[-1], fan), f"above{len(nodes)}"))
    subroots = reduce(DataFrame.unionByName, [x.where("width = 1") for x in nodes])
    tops = subroots.select(
        F.lit(TOP).alias("tree"), F.lit(0).cast("long").alias("top"), F.lit(0).alias("level"), F.col("top").alias("node"),
        F.lit(n_groups).cast("long").alias("width"), "digest",
    )
    nodes.append(shelf.keep(tops, "tops0"))
    for i in range(len(widths(n_groups, fan)) - 1 if n_groups else 0):
        nodes.append(shelf.keep(_above(nodes[-1], fan), f"tops{i + 1}"))
    every = reduce(DataFrame.unionByName, [x.select("tree", "level", "node", "digest") for x in nodes])
    asked = parts.mapInArrow(lambda it: _requests(it, fan, n_groups), "part long, tree string, level int, node long")
    found = asked.join(every, ["tree", "level", "node"]).groupBy("part")
    found = found.agg(F.collect_list(F.struct("tree", "level", "node", "digest")).alias("fetched"))
    joined = parts.join(shelf.keep(found, "fetched"), "part", "left")
    shelf.drop(*[x for x in shelf.paths if x in ("roots",) or x.startswith(("above", "tops"))])
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in kept) + f", leaf string, subroot string, root string, proof {PROOF}"
    proofs = joined.mapInArrow(lambda it: _expand(it, fan, n_groups, kept), out)
    return proofs.withColumnsRenamed({"id": id_} | {f"carried{i}": c for i, c in enumerate(carry)})
