"""Exact top-k search by inner product: a ball tree per shard, branch and bound over its nodes.

Rows are dealt to shards of bounded size by a hash of their id and place. Each shard becomes one row: its vectors in tree
order. A query is first searched in its own shard; the k-th score found there goes with it to every other shard
and cuts off the balls that cannot reach it. Queries travel in blocks, so a shard is opened once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf

K = 5
#: Vectors of a shard, about; and of a leaf, at most.
SHARD = 8192
LEAF = 128


class BallTree:
    """Balls around halves of halves of the rows; rows lie in tree order, so that a ball is a range of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.arange(len(ids))
        nodes: list[tuple[int, int, int]] = []  # first row, end row, index of the left child (0: a leaf)

        def cut(a: int, b: int) -> None:
            waiting = [(a, b, len(nodes))]
            nodes.append((a, b, 0))
            while waiting:
                a, b, at = waiting.pop()
                if b - a <= leaf:
                    continue
                own = vectors[order[a:b]]
                far = own[np.argmax(((own - own[0]) ** 2).sum(1))]
                other = own[np.argmax(((own - far) ** 2).sum(1))]
                order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
                mid, left = (a + b) // 2, len(nodes)
                nodes[at] = (a, b, left)
                nodes.extend([(a, mid, 0), (mid, b, 0)])
                waiting += [(a, mid, left), (mid, b, left + 1)]

        cut(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes = np.array(nodes, np.int64)
        self.measure()

    def measure(self) -> None:
        self.centers = np.array([self.vectors[a:b].mean(0) for a, b, _ in self.nodes])
        self.radii = np.array(
            [np.sqrt(((self.vectors[a:b] - c) ** 2).sum(1).max()) for (a, b, _), c in zip(self.nodes, self.centers)]
        )

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No vector in the ball has a higher inner product; a little is added for rounding."""
        reach = norms * self.radii[node]
        return queries @ self.centers[node] + reach + 1e-9 * (norms * np.linalg.norm(self.centers[node]) + reach) + 1e-6

    def search(self, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """Per query its best k (ids, scores), -1 where there are none; `kth`: scores known to be reached by k others."""
        n = len(queries)
        norms = np.linalg.norm(queries, axis=1)
        best = np.full((n, k), -np.inf)
        found = np.full((n, k), -1, np.int64)
        kth = kth.copy()

        def visit(leaf: int, rows: np.ndarray) -> None:
            a, b, _ = self.nodes[leaf]
            scores = queries[rows] @ self.vectors[a:b].T
            scores[own[rows][:, None] == self.ids[None, a:b]] = -np.inf
            some = (scores >= kth[rows][:, None]).any(1)
            rows, scores = rows[some], scores[some]
            if not len(rows):
                return
            scores = np.concatenate([best[rows], scores], 1)
            ids = np.concatenate([found[rows], np.broadcast_to(self.ids[a:b], (len(rows), b - a))], 1)
            first = np.lexsort((ids, -scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(scores, first, 1)
            found[rows] = np.take_along_axis(ids, first, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])

        leaves: list[tuple[int, np.ndarray, np.ndarray]] = []
        waiting = [(0, np.arange(n))]
        while waiting:
            node, rows = waiting.pop()
            bounds = self.bound(node, queries[rows], norms[rows])
            alive = bounds >= kth[rows]
            rows, bounds = rows[alive], bounds[alive]
            if not len(rows):
                continue
            left = self.nodes[node, 2]
            if left:
                waiting += [(left, rows), (left + 1, rows)]
            else:
                leaves.append((node, rows, bounds))
        # Each query sees the ball of its highest bound first; what it finds there spares it most of the others.
        top = np.full(n, -np.inf)
        for _, rows, bounds in leaves:
            top[rows] = np.maximum(top[rows], bounds)
        for node, rows, bounds in leaves:
            visit(node, rows[bounds == top[rows]])
        for node, rows, bounds in sorted(leaves, key=lambda x: -x[2].max()):
            open_ = (bounds >= kth[rows]) & (bounds != top[rows])
            if open_.any():
                visit(node, rows[open_])
        found[np.isneginf(best)] = -1
        return found, best


def whole_units(embedding: Column, unit: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(unit)) * x.cast("double")).cast("double"))


def _sharded(part: pd.DataFrame, every: int, k: int, leaf: int) -> pd.DataFrame:
    part = part.sort_values(["vec_id", "row"])
    ids = part["vec_id"].to_numpy(np.int64)
    vectors = np.array(part["vector"].tolist(), np.float64).reshape(len(ids), -1)
    tree = BallTree(ids, vectors, leaf)
    own = ids % every == 0
    kth = np.full(own.sum(), -np.inf)
    if len(kth):
        kth = tree.search(ids[own], vectors[own], kth, k)[1][:, -1]
    return pd.DataFrame(
        {
            "shard": [part["shard"].iloc[0]],
            "width": [vectors.shape[1]],
            "ids": [tree.ids.tobytes()],
            "vectors": [tree.vectors.tobytes()],
            "nodes": [tree.nodes.tobytes()],
            "q_ids": [ids[own].tobytes()],
            "q_vectors": [vectors[own].tobytes()],
            "q_kth": [kth.tobytes()],
        }
    )


def _opened(row: dict) -> BallTree:
    tree = BallTree.__new__(BallTree)
    tree.ids = np.frombuffer(row["ids"], np.int64)
    tree.vectors = np.frombuffer(row["vectors"]).reshape(len(tree.ids), row["width"])
    tree.nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
    tree.measure()
    return tree


def top_k(rows: DataFrame, every: int, unit: int = 256, k: int = K, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with every other row.

    `rows` has vec_id and embedding; each component x counts as floor(unit * x). Queries are the rows whose
    vec_id is divisible by `every`. Equal scores: the smaller vec_id first. Fewer than k others: all of them.

    No part take rows with null vec_id, a null vector, or a component that is null or not finite. Rows that share
    a vec_id, equal ones too, are candidates of their own, but not for a query of that vec_id; queries that share one
    have one list, the k best scores of any of them. Only vectors of equal length are compared. Scores are exact
    below 2 ** 53. Other columns are not read. An empty table gives an empty result.
    """
    shelf = Shelf(rows.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = rows.where("vec_id is not null and embedding is not null").where(finite)
    units = sound.select(F.col("vec_id").cast("long").alias("vec_id"), whole_units(F.col("embedding"), unit).alias("vector"))
    vectors = shelf.keep(units.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-vectors.count() // shard))
    number = F.size("vector").cast("long") * shards + F.pmod(F.xxhash64("vec_id", "row"), F.lit(shards))
    binary = "shard long, width int, ids binary, vectors binary, nodes binary, q_ids binary, q_vectors binary, q_kth binary"
    trees = shelf.keep(
        vectors.withColumn("shard", number).groupBy("shard").applyInPandas(lambda p: _sharded(p, every, k, leaf), binary),
        "trees",
    )
    shelf.drop("vectors")
    first = F.col("width") * F.lit(shards).cast("long")
    blocks = trees.where(F.length("q_ids") > 0).select(
        F.explode(F.sequence(first, first + (shards - 1))).alias("shard"), "q_ids", "q_vectors", "q_kth"
    )
    grid = trees.select("shard", "width", "ids", "vectors", "nodes").join(blocks, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != opened:
                    opened, tree = row["shard"], _opened(row)
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_vectors"]).reshape(len(q_ids), row["width"])
                ids, scores = tree.search(q_ids, queries, np.frombuffer(row["q_kth"]), k)
                real = ids >= 0 if (tree.ids >= 0).all() else ~np.isneginf(scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, k).reshape(-1, k)[real]),
                        pa.array(ids[real]),
                        pa.array(scores[real].astype(np.int64)),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    found = grid.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
