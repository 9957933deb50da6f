"""Connected components by contraction: every node points to its smallest neighbour, the trees that form
shrink to their roots, and the edges between roots go into the next round. Each round leaves at most half of
the nodes that still have edges. A node with a third of all edges is joined by broadcast of its one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, lookup


def _roots(parents: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, parent, degree) with every parent replaced by the root of its tree; doubles the steps each time."""
    step = 0
    while True:
        up = parents.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        held = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        chain = shelf.keep(up.join(held, "parent"), f"{name}chain{step}")
        if chain.isEmpty():
            shelf.drop(f"{name}chain{step}")
            return parents
        jumped = lookup(parents, chain, ["parent"], "n", "left")
        jumped = jumped.select("node", F.coalesce("above", "parent").alias("parent"), "degree")
        parents = shelf.keep(jumped, f"{name}jump{step}")
        shelf.drop(f"{name}chain{step}", f"{name}jump{step - 1}" if step else f"{name}parents")
        step += 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): component is the smallest node it is connected to.

    Null ends, loops, repeated and reversed edges change nothing. Nodes may be numbers or strings.
    An empty table gives an empty result.
    """
    shelf = Shelf(edges.sparkSession)
    pairs = edges.where("a is not null and b is not null").select("a", "b")
    nodes = shelf.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")
    found = nodes.select("node", F.col("node").alias("component"))
    turn, kept = 0, ["nodes"]
    edges = shelf.keep(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        parents = shelf.keep(near.select("node", F.least("node", "m").alias("parent"), "degree"), f"t{turn}parents")
        parents = _roots(parents, shelf, f"t{turn}")
        to = lambda end: parents.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_root"), "degree")
        half = shelf.keep(lookup(edges, to("a"), ["a"], "degree").select(F.col("a_root").alias("a"), "b"), "half")
        whole = lookup(half, to("b"), ["b"], "degree").where("a <> b_root")
        shrunk = whole.select(F.least("a", "b_root").alias("a"), F.greatest("a", "b_root").alias("b")).distinct()
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        moved = parents.where("node <> parent").select(F.col("node").alias("component"), "parent")
        moved = shelf.keep(moved.join(sizes, "component"), "moved")
        found = lookup(found, moved, ["component"], "n", "left")
        found = shelf.keep(found.select("node", F.coalesce("parent", "component").alias("component")), f"found{turn}")
        turn += 1
        edges = shelf.keep(shrunk, f"edges{turn}")
        shelf.drop("half", "moved", *kept, *[x for x in shelf.paths if x.startswith(f"t{turn - 1}")], f"edges{turn - 1}")
        kept = [f"found{turn - 1}"]
    shelf.drop(f"edges{turn}")
    return found
