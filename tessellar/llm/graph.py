"""Connected components: within a task in numpy, and of a whole edge table by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import discard, stored


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges (a, b) connect it to."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step: each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # An edge (u, v), u < v, is seen from u: v goes to the least of u's neighbourhood.
    return edges.join(least, edges["u"] == least["w"]).select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """One small-star step: a node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
    inner = edges.join(least, edges["v"] == least["w"]).select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v")
    outer = least.select(F.col("m").alias("u"), F.col("w").alias("v"))
    return inner.unionByName(outer).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, u): for each node v of edges(u, v) other than its component's least, that least node u.

    Every step is a few joins on node ids and ends in a written table; a node of very many edges is
    only ever aggregated by partial minima or joined.
    """
    now = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    seen = None
    while True:
        last, now = now, stored(_small(_stars(now)), "stars")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select("v", "u")
        seen = tuple(mark)
