"""Hard negatives by a cover tree per shard, over candidates that an extra coordinate lifts to one norm.

With that coordinate all candidates lie on a sphere, so the angle that a node's covering radius spans bounds the
inner products below it from both sides. Rows are dealt to shards by label; small labels share one. Anchors first
search the shards of their label for positives. Each positive gives a window of scores; the anchors of a shard then
visit all other shards as one block, best node first, skip nodes outside all windows and score leaves exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.shelf import Shelf, lookup, shuffle_parts
from grainmill.operators.scale import running_weight

#: Rows of a shard: at most and, on tables with few rows for each shuffle partition, at least.
SHARD = 8192
LEAST = 512
#: Covering radii shrink by this factor from level to level; leaves hold at most LEAF rows.
SHRINK = 1.3
LEAF = 256
#: Children below this many rows are left to the leaves of their parent.
SMALL = 24
#: Anchors searched together.
BLOCK = 128


class CoverTree:
    """Nodes cover their rows within a radius around one of them, which is also the centre of their first child.

    Siblings' centres lie further apart than the radius that their level allows; a row belongs to the first centre
    that covers it. Rows that no sizeable child takes are leaves of the parent, in order of their distance.
    Rows lie in tree order. A node: (centre, radius, smallest distance, first child, end child, first row, end row);
    only leaves have rows, only inner nodes have children.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        norms = (vectors**2).sum(1)
        self.reach = float(np.sqrt(norms.max(initial=0)))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.reach**2 - norms, 0))[:, None]], 1)
        away = lambda c, rows: np.sqrt(((lifted[rows] - lifted[c]) ** 2).sum(1))
        nodes: list[list] = []
        order: list[np.ndarray] = []
        placed = 0
        everything = np.arange(len(vectors))
        start = away(0, everything) if len(vectors) else np.zeros(0)
        nodes.append([0, float(start.max(initial=0)), 0.0, 0, 0, 0, 0])
        waiting = [(0, everything, start)]
        while waiting:
            at, rows, dist = waiting.pop()
            centre, radius = nodes[at][:2]
            cells, rest = self._cells(centre, rows, dist, radius / SHRINK, away) if len(rows) > LEAF else ([], [rows])
            if len(cells) == 1 and not rest:  # all rows lie closer than the next radius
                nodes[at][1] = float(cells[0][2].max())
                waiting.append((at, rows, cells[0][2]))
                continue
            first = len(nodes)
            for c, own, d in cells:
                nodes.append([c, float(d.max()), 0.0, 0, 0, 0, 0])
                waiting.append((len(nodes) - 1, own, d))
            if rest:
                left = np.concatenate(rest)
                d = away(centre, left)
                by = np.argsort(d, kind="stable")
                left, d = left[by], d[by]
                for a in range(0, len(left), LEAF):
                    b = min(a + LEAF, len(left))
                    nodes.append([centre, float(d[b - 1]), float(d[a]), 0, 0, placed + a, placed + b])
                order.append(left)
                placed += len(left)
            nodes[at][3:5] = first, len(nodes)
        self.nodes = np.array(nodes)
        self.order = np.concatenate(order) if order else everything

    @staticmethod
    def _cells(centre, rows, dist, radius, away):
        """Cells of at least SMALL rows around centres more than `radius` apart, and the rows left over."""
        if dist.max() == 0:
            return [], [rows]
        cells, rest, missed = [], [], 0
        c, d = centre, dist
        while len(rows):
            inside = d <= radius
            if inside.sum() >= SMALL:
                cells.append((c, rows[inside], d[inside]))
                missed = 0
            else:
                rest.append(rows[inside])
                missed += 1
            rows, dist = rows[~inside], dist[~inside]
            if missed > 8:  # distances are much alike here: nodes would hold next to nothing
                rest.append(rows)
                break
            if len(rows):
                c = rows[np.argmax(dist)]
                d = away(c, rows)
        return cells, [x for x in rest if len(x)]

    def bounds(self, node_ids: np.ndarray, queries: np.ndarray, norms: np.ndarray):
        """(lowest, highest) inner product that a row below each node can have with each query."""
        centres = self.vectors[self.nodes[node_ids, 0].astype(np.int64)]
        top = norms * self.reach
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(np.nan_to_num(queries @ centres.T / top[:, None]), -1, 1))
            spans = [2 * np.arcsin(np.clip(np.nan_to_num(self.nodes[node_ids, k] / (2 * self.reach)), 0, 1)) for k in (1, 2)]
        wide, narrow = spans
        nearest = np.maximum(0, np.maximum(angle - wide, narrow - angle))
        high = top[:, None] * np.cos(nearest)
        low = top[:, None] * np.cos(np.minimum(np.pi, angle + wide))
        slack = 1e-6 * top[:, None] + 1e-6
        return low - slack, high + slack

    def search(self, ids, labels, queries, wanted, own, low, high, k, same):
        """Per query and window its best k (ids, scores, rows); scores -inf where there are none.

        `ids`, `labels`: of the rows in tree order. `wanted`: the query's label; `same`: whether rows must share it.
        `own`: the query's own row or -1. `low`, `high`: windows, one row per query.
        """
        n, w = low.shape
        norms = np.linalg.norm(queries, axis=1)
        best = np.full((n, w, k), -np.inf)
        found = np.zeros((n, w, k), np.int64)
        kth = low.astype(float).copy()

        def open_(rows, least, most):
            """Which windows of the rows a span of scores can still improve."""
            return (most[:, :, None] >= kth[rows][:, None, :]) & (least[:, :, None] <= high[rows][:, None, :])

        def verify(node, rows):
            a, b = int(self.nodes[node, 5]), int(self.nodes[node, 6])
            scores = queries[rows] @ self.vectors[a:b].T
            barred = (labels[None, a:b] == wanted[rows][:, None]) != same
            barred |= own[rows][:, None] == np.arange(a, b)[None, :]
            scores[barred] = -np.inf
            for v in range(w):
                fits = (scores >= kth[rows, v][:, None]) & (scores <= high[rows, v][:, None]) & ~barred
                hit = np.flatnonzero(fits.any(1))
                if not len(hit):
                    continue
                sub = rows[hit]
                s = np.concatenate([best[sub, v], np.where(fits[hit], scores[hit], -np.inf)], 1)
                i = np.concatenate([found[sub, v], np.broadcast_to(ids[a:b], (len(hit), b - a))], 1)
                first = np.lexsort((i, -s), axis=1)[:, :k]
                best[sub, v] = np.take_along_axis(s, first, 1)
                found[sub, v] = np.take_along_axis(i, first, 1)
                kth[sub, v] = np.maximum(kth[sub, v], best[sub, v, -1])

        everyone = np.arange(n)
        heap = [(0.0, 0, everyone, np.full(n, -np.inf), np.full(n, np.inf))] if len(ids) else []
        while heap:
            _, node, rows, least, most = heapq.heappop(heap)
            alive = open_(rows, least[:, None], most[:, None]).any((1, 2))
            rows = rows[alive]
            if not len(rows):
                continue
            if self.nodes[node, 6] > self.nodes[node, 5]:
                verify(node, rows)
                continue
            kids = np.arange(int(self.nodes[node, 3]), int(self.nodes[node, 4]))
            least, most = self.bounds(kids, queries[rows], norms[rows])
            for j, kid in enumerate(kids):
                some = open_(rows, least[:, j : j + 1], most[:, j : j + 1]).any((1, 2))
                if some.any():
                    ends = np.minimum(most[some, j], high[rows[some]].max(1))
                    heapq.heappush(heap, (-float(ends.max()), int(kid), rows[some], least[some, j], most[some, j]))
        return found, best


def whole_units(embedding: Column, unit: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(unit)) * x.cast("double")).cast("double"))


TREE = (
    "shard long, width int, first long, parts long, ids binary, labels binary, vectors binary, nodes binary, reach double, "
    "centre array<double>, span double, "
    "anchors array<struct<row long, id long, label long, vector binary>>"
)


def _planted(part: pd.DataFrame, every: int) -> pd.DataFrame:
    """The tree of one shard as one row."""
    vectors = np.array(part["vector"].tolist(), np.float64).reshape(len(part), -1)
    ids, labels = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
    by = np.lexsort((*vectors.T[::-1], labels, ids))  # an order that does not depend on the shuffle
    ids, labels, vectors = ids[by], labels[by], vectors[by]
    tree = CoverTree(vectors)
    nodes = tree.nodes.copy()
    back = np.empty(len(ids), np.int64)
    back[tree.order] = np.arange(len(ids))
    nodes[:, 0] = back[nodes[:, 0].astype(np.int64)]
    ids, labels, vectors = ids[tree.order], labels[tree.order], vectors[tree.order]
    anchors = [
        {"row": int(r), "id": int(ids[r]), "label": int(labels[r]), "vector": vectors[r].tobytes()}
        for r in np.flatnonzero(ids % every == 0)
    ]
    row = {
        "shard": part["shard"].iloc[0], "width": vectors.shape[1], "first": part["first"].iloc[0], "parts": part["parts"].iloc[0],
        "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes(), "nodes": nodes.tobytes(),
        "reach": tree.reach, "centre": vectors[int(nodes[0, 0])],
        "span": float(2 * np.arcsin(min(1, nodes[0, 1] / (2 * tree.reach)))) if tree.reach else np.pi, "anchors": anchors,
    }
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _opened(row: dict):
    """(tree, ids, labels) of a written shard."""
    tree = CoverTree.__new__(CoverTree)
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    tree.vectors = np.frombuffer(row["vectors"]).reshape(len(ids), row["width"])
    tree.nodes = np.frombuffer(row["nodes"]).reshape(-1, 7)
    tree.reach = row["reach"]
    return tree, ids, labels


ASKED = "asked array<struct<row long, label long, vector binary, low array<double>, high array<double>>>"
CONE = "axis array<double>, spread double, least double, most double"


def _coned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each block of anchors the cone they lie in, and the lowest and highest score they want, by unit of norm."""
    for batch in batches:
        cones = []
        for asked in batch.column(batch.schema.names.index("asked")).to_pylist():
            vectors = np.frombuffer(b"".join([x["vector"] for x in asked])).reshape(len(asked), -1)
            norms = np.linalg.norm(vectors, axis=1)
            if not len(asked) or not norms.all():
                cones.append((np.zeros(vectors.shape[1] if len(asked) else 0), np.pi, -np.inf, np.inf))
                continue
            units = vectors / norms[:, None]
            axis = units.mean(0)
            length = np.linalg.norm(axis)
            axis = axis / length if length else axis
            spread = float(np.arccos(np.clip(units @ axis, -1, 1)).max()) if length else np.pi
            least = min(min(x["low"]) / n for x, n in zip(asked, norms))
            most = max(max(x["high"]) / n for x, n in zip(asked, norms))
            cones.append((axis, spread, least, most))
        kinds = [pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(list(c), k) for c, k in zip(zip(*cones), kinds)]],
            names=[*batch.schema.names, "axis", "spread", "least", "most"],
        )


def _reachable() -> Column:
    """Whether a shard's root can hold a score that some anchor of the block wants; angles between axis and centre decide."""
    dot = F.aggregate(F.zip_with("axis", "centre", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot, F.col("reach")), F.lit(0.0))))
    angle, wide = F.acos(cosine), F.col("span") + F.col("spread")
    slack = F.col("reach") * 1e-6 + 1e-6
    high = F.col("reach") * F.cos(F.greatest(F.lit(0.0), angle - wide)) + slack
    low = F.col("reach") * F.cos(F.least(F.lit(np.pi), angle + wide)) - slack
    return (high >= F.col("least")) & (low <= F.col("most"))


def _searched(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors against the shard beside them; one row per window and place."""
    opened, tree = None, None
    names = ["shard", "width", "ids", "labels", "vectors", "nodes", "reach", "home", "asked"]
    for batch in batches:
        at = {n: batch.schema.names.index(n) for n in names}
        for i in range(batch.num_rows):
            get = lambda n: batch.column(at[n])[i].as_py()
            if (get("shard"), get("width")) != opened:
                opened = get("shard"), get("width")
                tree, ids, labels = _opened({n: get(n) for n in names[:7]})
            asked = get("asked")
            queries = np.frombuffer(b"".join([x["vector"] for x in asked])).reshape(len(asked), -1)
            for a in range(0, len(asked), BLOCK):
                part = asked[a : a + BLOCK]
                slots = max(len(x["low"]) for x in part)
                low, high = np.full((len(part), slots), np.inf), np.full((len(part), slots), -np.inf)
                for j, x in enumerate(part):
                    low[j, : len(x["low"])], high[j, : len(x["low"])] = x["low"], x["high"]
                home = get("home") == opened[0]
                own = np.array([x["row"] if home else -1 for x in part])
                wanted = np.array([x["label"] for x in part], np.int64)
                found, best = tree.search(ids, labels, queries[a : a + BLOCK], wanted, own, low, high, k, same)
                j, v, p = np.nonzero(best > -np.inf)
                rows = np.array([x["row"] for x in part], np.int64)[j]
                cols = [np.full(len(j), get("home")), np.full(len(j), opened[1]), rows, v, found[j, v, p], best[j, v, p]]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int64)).cast(t) for c, t in zip(cols, kinds)],
                    names=["home", "width", "row", "window", "vec_id", "score"],
                )


FOUND = "home long, width int, row long, window int, vec_id long, score long"


def hard_negatives(
    rows: DataFrame, every: int, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, unit: int = 256,
    shard: int = SHARD, least: int = LEAST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vec_id, embedding, label.

    Components x count as floor(unit * x), scores are inner products, exact below 2 ** 53. Anchors are the rows whose
    vec_id is divisible by `every`. An anchor's positives are its `positives` best other rows of its label. For each
    of them: the `negatives` best rows of other labels that score `low` to `high` percent of the positive's score. Equal scores:
    smaller vec_id first. A negative positive score leaves no window, so it has no negatives; zero has those that score zero.

    No part take rows with a null vec_id, label or vector, or a component that is null or not finite. Only vectors
    of equal length are compared. Rows that share a vec_id are rows of their own: each one that is an anchor has
    its own result, and each may be the other's positive. Other columns are not read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    sound = sound.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.size("embedding").alias("width"), whole_units(F.col("embedding"), unit).alias("vector"),
    )
    vectors = shelf.keep(sound, "vectors")
    total = vectors.count()
    size = min(shard, max(least, total // shuffle_parts(spark)))
    counted = shelf.keep(vectors.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n")), "counted")
    # a label of a quarter of a shard or more has shards of its own, all others share some by hash
    large = counted.where(F.col("n") * 4 >= size).withColumn("parts", F.ceil(F.col("n") / size))
    numbered = running_weight(large, ["width", "label"], weight="parts", before="first")
    numbered = shelf.keep(numbered.select("width", "label", "n", "parts", "first"), "numbered")
    taken, held = numbered.agg(F.sum("parts"), F.sum("n")).first()
    taken, pooled = taken or 0, -(-(total - (held or 0)) // size)
    shared = counted.where(F.col("n") * 4 < size).select(
        "width", "label", "n", F.lit(1).cast("long").alias("parts"),
        (F.lit(taken) + F.pmod(F.xxhash64("width", "label"), F.lit(max(1, pooled)))).alias("first"),
    )
    homes = shelf.keep(numbered.unionByName(shared), "homes")
    dealt = lookup(vectors, homes, ["width", "label"], "n")
    dealt = dealt.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")))
    trees = shelf.keep(
        dealt.groupBy("shard", "width").applyInPandas(lambda p: _planted(p, every), TREE), "trees"
    )
    shelf.drop("vectors", "counted", "numbered", "homes")

    free = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    asking = lambda a, low, high: F.named_struct(
        *[x for c in ("row", "label", "vector") for x in (F.lit(c), a[c])], F.lit("low"), low, F.lit("high"), high
    )
    blocks = trees.where(F.size("anchors") > 0).select(F.col("shard").alias("home"), "width", "first", "parts", "anchors")
    blocks = shelf.keep(blocks, "blocks")
    shards = trees.select("shard", "width", "ids", "labels", "vectors", "nodes", "reach")
    # a label's own shards are all of its shards; one shared by small labels is the only one of each
    everything = blocks.select(
        "home", "width", F.transform("anchors", lambda a: asking(a, *free)).alias("asked"),
        F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard"),
    )
    near = shards.join(everything, ["shard", "width"]).mapInArrow(lambda it: _searched(it, positives, True), FOUND)
    order = Window.partitionBy("home", "width", "row").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    own = near.groupBy("home", "width", "row").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("vec_id").alias("id"), "score"))).alias("positives")
    )
    own = shelf.keep(own, "positives")
    by_home = own.groupBy("home", "width").agg(F.map_from_entries(F.collect_list(F.struct("row", "positives"))).alias("windows"))
    ends = lambda a, share, whole: F.transform(
        F.col("windows")[a["row"]], lambda p: whole(p["score"] * share / 100).cast("double")
    )
    # anchors without a positive have no window and stay behind
    windows = F.transform(
        F.filter("anchors", lambda a: F.col("windows")[a["row"]].isNotNull()),
        lambda a: asking(a, ends(a, low, F.ceil), ends(a, high, F.floor)),
    )
    last = taken + max(1, pooled) - 1
    targets = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    single = (F.col("first") < taken) & (F.col("shard") >= F.col("first")) & (F.col("shard") < F.col("first") + F.col("parts"))
    asked = blocks.join(by_home, ["home", "width"]).select("home", "width", "first", "parts", windows.alias("asked"))
    asked = shelf.keep(asked.mapInArrow(_coned, f"home long, width int, first long, parts long, {ASKED}, {CONE}"), "asked")
    # only cones and roots meet here; the vectors of a block go where its pair is left
    pairs = asked.drop("asked").withColumn("shard", F.explode(targets)).where(~single)
    pairs = pairs.join(trees.select("shard", "width", "reach", "centre", "span"), ["shard", "width"]).where(_reachable())
    pairs = shelf.keep(pairs.select("home", "width", "shard"), "pairs")
    pairs = pairs.join(asked.select("home", "width", "asked"), ["home", "width"])
    far = shards.join(pairs, ["shard", "width"]).mapInArrow(lambda it: _searched(it, negatives, False), FOUND)
    order = Window.partitionBy("home", "width", "row", "window").orderBy(F.desc("score"), "vec_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = blocks.select("home", "width", F.inline("anchors")).select("home", "width", "row", F.col("id").alias("anchor_id"))
    told = own.join(named, ["home", "width", "row"]).select(
        "home", "width", "row", "anchor_id", F.posexplode("positives").alias("window", "p")
    )
    return far.join(told, ["home", "width", "row", "window"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
