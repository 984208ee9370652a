"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import discard, staged, staged_folders, tasks


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component): same components as the links (a, b), one link a node at most."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], least)
        np.minimum.at(new, label[ib], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _towards(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Per edge (u, v) the least of u and its neighbours v."""
    n = tasks(edges.sparkSession)
    # Dealt anew, so that the join below shuffles both sides itself and a hub's edges can be split by AQE.
    least = edges.groupBy(F.col(u).alias("_u")).agg(F.least(F.min(v), F.first(u)).alias("_m")).repartition(n)
    return edges.join(least, F.col(u) == F.col("_u")).select(u, v, "_m")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long) other than the roots; root is the least node reachable.

    Large-star then small-star rounds; each written to the shared folder. Links meet in
    joins by node, never in one task or the driver; only two numbers a round (edge count
    and an order-free hash) reach the driver, to see that nothing changes any more.
    Self links and repeated links are allowed; an empty table gives an empty result.
    """
    edges = staged(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        old = len(staged_folders()) - 1  # this round reads the last folder only
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        large = _towards(both, "u", "v").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("_m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = staged(large, "large")
        star = _towards(large, "u", "v")
        small = star.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(
            star.select(F.col("u"), F.col("_m"))).where(F.col("u") != F.col("v")).distinct()
        edges = staged(small, "small")
        discard(links.sparkSession, old, -1)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
