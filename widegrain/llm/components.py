"""Connected components: spanning forests inside a task, star contraction across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widegrain.llm.common import save


class Forest:
    """Union-find over 0..n-1 that keeps only the links which joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def _roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                p[x] = r
                return r
            r = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs; each round hooks every larger root to one smaller root."""
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            order = np.lexsort((low, high))
            first = np.ones(len(order), bool)
            first[1:] = high[order][1:] != high[order][:-1]
            pick = order[first]
            self.parent[high[pick]] = low[pick]
            self.links.append((a[pick], b[pick]))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in self.links]), np.concatenate([x[1] for x in self.links])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b longs); component is its least node.

    Alternates large-star and small-star contraction until nothing changes. Every round
    is aggregates and joins on node keys, and is written to the shared folder, so neither
    the driver nor one task holds a component; nodes without a link do not appear.
    """
    links = save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        links = save(_small_star(_large_star(links)))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lower neighbours all point to the least of those neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = links.join(least, F.col("a") == F.col("k"))
    return (
        moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        .distinct()
    )
