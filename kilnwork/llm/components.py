"""Connected components of a graph too large for one machine, by contraction to smallest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, small, written


class Forest:
    """Union-find over 0..n-1 inside a task; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root): for each node of the edges the smallest node reachable from it.

    Each round maps every node to the first of itself and its neighbours in a random order, drawn anew each round, and every edge to the
    ends' images: chains and stars alike lose a constant share of their nodes a round. A minimum is combined before the shuffle,
    so a hub with very many neighbours costs one row a task; the joins' hot keys are split by adaptive execution, for
    which each round's tables are written to the shared folder (this also cuts the lineage). Loops and repeated edges are harmless.
    """
    edges = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b"), "edges")
    labels = None
    for turn in range(rounds):
        n = edges.count()
        if not n:
            break
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("x")).select("x.*")
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        image = ends.groupBy("id").agg(F.min(ranked("to")).alias("m")).select("id", F.least("m", ranked("id"))["to"].alias("to"))
        image = written(sized(image, 2 * n), "image")
        of = lambda names: small(image.select(*[F.col(c).alias(x) for c, x in names.items()]), 2 * n)  # noqa: B023, E731
        if labels is None:
            labels, size = image.select("id", F.col("to").alias("root")), 2 * n
        else:
            labels = written(sized(labels.join(of({"id": "root", "to": "to"}), "root", "left").select("id", F.coalesce("to", "root").alias("root")), size), "labels")
        moved = edges.join(of({"id": "a", "to": "ta"}), "a").join(of({"id": "b", "to": "tb"}), "b")
        edges = written(sized(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct(), n), "edges")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    smallest = labels.groupBy("root").agg(F.min("id").alias("least"))
    return written(labels.join(small(smallest, size), "root").select("id", F.col("least").alias("root")), "labels")
