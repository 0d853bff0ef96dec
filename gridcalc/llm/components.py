"""Connected components of an edge table, by alternating stars; edges and labels stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import discard, written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indexes over the edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            return root


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v")


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not itself a root; root is the smallest node reached.

    Large and small stars alternate until the edges are stars. Each round is a written table, the one before goes.
    Null ends and loops are no edges; an empty table gives an empty result.
    """
    now = written(spark, edges.where("u != v").distinct(), "edges")
    for _ in range(rounds):
        nxt = written(spark, _small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(spark, now._gridcalc_path)
        now = nxt
        several = now.groupBy("u").count().where("count > 1").select("u")
        chained = now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi")
        if not several.union(chained).take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
