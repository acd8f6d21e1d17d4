"""Exact top-k inner products by dual-tree search over cover trees.

Level 0 is built over all rows: points of a bounded sample, far from each other, are the centers, every
vector (query or data) belongs to the nearest one, and large nodes are cut into blocks. For each pair of
blocks a bound from centers and covering radii says how large an inner product can be at most; the pair
is left out if the worst kth score of the query block, known from searching its own and near nodes, is
above it. Inside a pair of blocks both sides are indexed by cover trees, and node pairs are
pruned in the same way. Pairs that remain are computed in whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.llm.tables import settle

# Vectors sampled to find the centers of level 0, and how many centers at most.
SAMPLE = 4_096
CENTERS = 64
# Rows of a block, and of a leaf of a tree within a block.
QUERY_BLOCK = 1_024
DATA_BLOCK = 2_048
LEAF = 256
# A node's radius is divided by this from level to level.
SHRINK = 1.3
SEED = 5

# Sums of products below this are exact in doubles.
EXACT = float(1 << 53)

# Stand for "nothing found".
NO_SCORE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max

FOUND = "query_id long, id long, score long"


class Tree:
    """Cover tree of the rows of ``points``: nodes with center, covering radius and either children or
    rows. Centers of a node's children are further apart than the radius aimed at for their level."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            self._node(np.arange(len(points)), points.mean(axis=0))

    def _node(self, rows: np.ndarray, center: np.ndarray) -> int:
        distance = np.sqrt(((self.points[rows] - center) ** 2).sum(axis=1))
        radius, at = float(distance.max()), len(self.radii)
        self.centers.append(center)
        self.radii.append(radius)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= self.leaf or radius == 0:
            return at
        aim = radius / SHRINK
        nearest, best = np.zeros(len(rows), int), np.full(len(rows), np.inf)
        heads = 0
        # Farthest points become centers until all rows are covered or there are enough of them.
        while best.max() > aim and heads < 16:
            head = self.points[rows[int(np.argmax(best)) if heads else int(np.argmax(distance))]]
            d = np.sqrt(((self.points[rows] - head) ** 2).sum(axis=1))
            nearest[d < best] = heads
            best = np.minimum(best, d)
            heads += 1
        for head in range(heads):
            part = rows[nearest == head]
            if 0 < len(part) < len(rows):
                self.children[at].append(self._node(part, self.points[part].mean(axis=0)))
        return at


def bound(center_a, radius_a, center_b, radius_b) -> float:
    """Largest inner product that members of two nodes can have, with room for rounding."""
    size_a, size_b = np.linalg.norm(center_a), np.linalg.norm(center_b)
    most = center_a @ center_b + size_a * radius_b + size_b * radius_a + radius_a * radius_b
    return most + 1e-9 * (1 + (size_a + radius_a) * (size_b + radius_b))


class Search:
    """Best k of every query so far; ties go to the smaller id. Ids are unique.

    ``least`` are scores known to be reached k times: what is below them need not be found.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.largest = np.abs(vectors.astype(float)).max(initial=0)
        self.scores = np.full((len(ids), k), NO_SCORE)
        if least is not None:
            # One less than the known kth score, so that ties with it are still found.
            self.scores[:] = np.where(least == NO_SCORE, least, least - (least > NO_SCORE))[:, None]
        self.found = np.full((len(ids), k), NO_ID)

    def take(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates ``ids`` with their scores, a row per query."""
        k = self.k
        scores = np.where(self.ids[queries][:, None] == ids[None, :], NO_SCORE, scores)
        # Scores equal to the kth one stay, as ids settle ties.
        wanted = (scores >= self.scores[queries, -1][:, None]) & (scores > NO_SCORE)
        some = wanted.any(axis=1)
        if not some.any():
            return
        queries, scores, wanted = queries[some], scores[some], wanted[some]
        if scores.shape[1] > k:
            wanted &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]
        columns = wanted.any(axis=0)
        scores, ids = scores[:, columns], ids[columns]
        scores = np.hstack([self.scores[queries], scores])
        ids = np.hstack([self.found[queries], np.broadcast_to(ids, (len(queries), len(ids)))])
        ids = np.where(scores == NO_SCORE, NO_ID, ids)
        # ~score falls where score rises and cannot overflow.
        order = np.lexsort((ids, ~scores))[:, :k]
        self.scores[queries] = np.take_along_axis(scores, order, axis=1)
        self.found[queries] = np.take_along_axis(ids, order, axis=1)

    def run(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Dual-tree traversal: near pairs first, pairs below the worst kth score pruned."""
        if not len(self.ids) or not len(ids):
            return
        queries, data = Tree(self.vectors.astype(float)), Tree(vectors.astype(float))
        largest = self.largest * np.abs(data.points).max(initial=0) * max(vectors.shape[1], 1)
        # Sums within doubles are exact there, others are computed in 64 bits.
        left, right = (queries.points, data.points) if largest < EXACT else (self.vectors, vectors)
        stack = [(0, 0)]
        while stack:
            q, d = stack.pop()
            rows = queries.rows[q]
            most = bound(queries.centers[q], queries.radii[q], data.centers[d], data.radii[d])
            if most < self.scores[rows, -1].min():
                continue
            below_q, below_d = queries.children[q], data.children[d]
            if not below_q and not below_d:
                at = data.rows[d]
                self.take(rows, ids[at], (left[rows] @ right[at].T).astype(np.int64))
            elif below_q and (not below_d or queries.radii[q] > data.radii[d]):
                stack += [(c, d) for c in below_q]
            else:
                # The best pair goes on top of the stack.
                most = [queries.centers[q] @ data.centers[c] for c in below_d]
                stack += [(q, below_d[i]) for i in np.argsort(most)]

    def result(self) -> pd.DataFrame:
        rows, places = np.nonzero(self.found != NO_ID)
        return pd.DataFrame(
            {
                "query_id": self.ids[rows],
                "id": self.found[rows, places],
                "score": self.scores[rows, places],
            }
        )


def _centers(points: DataFrame, dim: int) -> np.ndarray:
    """Far points of a bounded seeded sample: the heads of level 0."""
    rows = (
        points.filter(F.size("vec") == dim)
        .orderBy(F.xxhash64(F.lit(SEED), "id"))
        .limit(SAMPLE)
        .select("vec")
        .collect()
    )
    sample = np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), dim)
    heads: list[np.ndarray] = []
    distance = np.full(len(sample), np.inf)
    while len(heads) < CENTERS and len(sample) and distance.max() > 0:
        heads.append(sample[int(np.argmax(distance))])
        distance = np.minimum(distance, ((sample - heads[-1]) ** 2).sum(axis=1))
    return np.array(heads).reshape(len(heads), dim)


def _nodes(points: DataFrame, heads: dict[int, np.ndarray], size: int) -> DataFrame:
    """Adds the nearest head (``node``), the distance to it and ``block``, the part of the node that a
    row belongs to. There are as many heads as blocks are needed, and parts of about ``size`` rows."""
    sizes = {r[0]: r[1] for r in points.groupBy(F.size("vec")).count().collect()}
    near = {dim: heads[dim][: max(1, -(-n // size))] for dim, n in sizes.items()}

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                x, center = np.vstack(part["vec"].to_numpy()).astype(np.float64), near[dim]
                nodes, distances = [], []
                for i in range(0, len(x), 256):
                    d = ((x[i : i + 256, None, :] - center[None]) ** 2).sum(axis=2)
                    nodes.append(np.argmin(d, axis=1))
                    distances.append(np.sqrt(d.min(axis=1)))
                yield pd.DataFrame(
                    {
                        "id": part["id"],
                        "vec": part["vec"],
                        "dim": dim,
                        "node": np.concatenate(nodes),
                        "distance": np.concatenate(distances),
                    }
                )

    schema = "id long, vec array<long>, dim int, node int, distance double"
    rows = settle(points.select("id", "vec").mapInPandas(nearest, schema))
    # A row per node: no more than there are heads.
    counts = rows.groupBy("dim", "node").agg(F.ceil(F.count("*") / size).alias("parts"))
    spread = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(counts), ["dim", "node"])
    return settle(rows.withColumn("block", spread).drop("parts"))


def _searched(
    queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int, worst: DataFrame | None
) -> DataFrame:
    """Best k of every query in each of the given pairs of blocks."""
    nothing = F.lit(None).cast("long").alias("least")
    sent_q = queries.join(pairs, ["dim", "node", "block"])
    sent_q = sent_q.join(worst, "id", "left") if worst is not None else sent_q.withColumn("least", nothing)
    sent_d = data.withColumnsRenamed({"node": "d_node", "block": "d_block"}).join(
        pairs, ["dim", "d_node", "d_block"]
    )
    columns = ("dim", "pair", "id", "vec", "least")
    sent = sent_q.select(*columns, F.lit(True).alias("asked")).unionByName(
        sent_d.withColumn("least", nothing).select(*columns, F.lit(False).alias("asked"))
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        asked = group["asked"].to_numpy(dtype=bool)
        vectors, ids = np.vstack(group["vec"].to_numpy()), group["id"].to_numpy()
        least = group["least"].astype("Int64").to_numpy(dtype="int64", na_value=NO_SCORE)
        found = Search(ids[asked], vectors[asked], k, least[asked])
        found.run(ids[~asked], vectors[~asked])
        return found.result()

    return sent.groupBy("dim", "pair").applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bounded(pairs: DataFrame, heads: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``most``, the largest inner product possible in a pair of blocks."""

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[["dim", "node", "radius", "d_node", "d_radius"]].itertuples(index=False)
            yield batch.assign(
                most=[bound(heads[n][a], ra, heads[n][b], rb) for n, a, ra, b, rb in rows]
            )

    schema = "dim int, node int, block int, n long, radius double, d_node int, d_block int, d_radius double, pair string, most double"
    return pairs.mapInPandas(bounds, schema)


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``id`` and ``score``: the k largest inner products of each query
    with the other rows of ``data``, all if there are fewer; ties go to the smaller id.

    Both tables have ``id`` (long) and ``vec`` (whole numbers, no nulls); ``queries`` are rows of
    ``data``. Vectors of different lengths are not compared. Of repeated ids the largest vector counts.
    An empty table, and a query alone in it, gives no rows. Scores must fit in 64 bits.
    """
    points = settle(data.groupBy("id").agg(F.max("vec").alias("vec")))
    dims = [r[0] for r in points.select(F.size("vec")).distinct().collect()]
    heads = {dim: _centers(points, dim) for dim in dims}
    asked = _nodes(points.join(queries.select("id").distinct(), "id", "semi"), heads, QUERY_BLOCK)
    held = _nodes(points, heads, DATA_BLOCK)

    radius = F.max("distance").alias("radius")
    q_blocks = asked.groupBy("dim", "node", "block").agg(F.count("*").alias("n"), radius)
    d_blocks = held.groupBy("dim", "node", "block").agg(radius)
    d_blocks = d_blocks.withColumnsRenamed({"node": "d_node", "block": "d_block", "radius": "d_radius"})
    pair = F.concat_ws("/", "node", "block", "d_node", "d_block").alias("pair")
    columns = ("dim", "node", "block", "n", "radius", "d_node", "d_block", "d_radius")
    pairs = settle(_bounded(q_blocks.join(d_blocks, "dim").select(*columns, pair), heads))

    # The most promising block first: its kth scores let others be left out.
    order = Window.partitionBy("dim", "node", "block").orderBy(F.desc("most"), "d_node", "d_block")
    pairs = settle(pairs.withColumn("turn", F.row_number().over(order)))
    first = settle(_best(_searched(asked, held, pairs.filter("turn = 1"), k, None), k))
    least = first.filter(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("least")
    )
    group = asked.join(least, "id", "left").groupBy("dim", "node", "block")
    worst = group.agg(F.min("least").alias("worst"), F.count("least").alias("known"))
    rest = pairs.filter("turn > 1").join(worst, ["dim", "node", "block"], "left")
    rest = settle(rest.filter("known < n OR most >= worst").select(pairs.columns))
    more = _searched(asked, held, rest, k, least)
    both = first.select("query_id", "id", "score").unionByName(more)
    return _best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
