"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and joins over the edges; nothing is gathered in one task or the
driver. Nodes with a large share of all edges (a bounded number, by counting) are joined by
broadcast, so that no task receives all the edges of such a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import dropped, map_batches, written

#: A node with more than 1/HOT of all edges is hot; there are at most 2 * HOT of them.
HOT = 256
LEAST_HOT = 2000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its class), for nodes other than the smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect the same nodes: each Arrow batch is reduced to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(edges.select("a", "b"), run, "a long, b long")


def _with_least(rows: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """rows joined on node with least (node, least, n); hot nodes are joined without a shuffle."""
    cold = rows.join(least.where(F.col("n") <= hot), "node")
    heat = F.broadcast(least.where(F.col("n") > hot))
    return cold.unionByName(rows.join(heat, "node"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node that links reach.

    An empty table gives no rows; loops and repeated edges are allowed.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = written(flat, "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        hot = max(LEAST_HOT, 2 * before[0] // HOT)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n")).withColumn("least", F.least("least", "node"))
        large = _with_least(both, least, hot).where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()
        large = written(large, "large-star")
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        least = down.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n"))
        small = _with_least(down, least, hot)
        links = small.where("other != least").select(F.col("other").alias("a"), F.col("least").alias("b"))
        old, edges = edges, written(links.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct(), "small-star")
        dropped(old, large)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
