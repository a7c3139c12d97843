"""Components of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links (u, v) lead to) of every node of a link.

    In a round every node takes its smallest neighbour, if that is smaller; chains of such choices are followed to their ends, and the
    links between the ends are left. At least half of the nodes that still have links go in each round.
    """
    left = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = written(left.select(F.col("u").alias("node")).union(left.select(F.col("v").alias("node"))).distinct().withColumn("label", F.col("node")))
    left = left.where("u <> v")
    while not left.isEmpty():
        parent = written(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("up")))
        while True:  # each pass doubles the steps that are followed
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            joined = written(parent.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            parent = joined.select("node", "up")
            if joined.where("moved").isEmpty():
                break
        end = lambda c: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_end"))  # noqa: B023, E731
        labels = written(labels.join(end("label"), "label", "left").select("node", F.coalesce("label_end", "label").alias("label")))
        moved = left.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("u_end", "u").alias("u"), F.coalesce("v_end", "v").alias("v"))
        left = written(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    return labels


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join what a matrix of links between left and right nodes joins: one for each node at most."""
    a, b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked = linked[np.ix_(a, b)]
    if not linked.size:
        return left[:0], right[:0]
    of_a, of_b = np.arange(len(a)), np.full(len(b), len(a))
    while True:  # the least label of the other side's neighbours
        new_b = np.where(linked, of_a[:, None], len(a)).min(0)
        new_a = np.where(linked, new_b[None, :], len(a)).min(1)
        if (new_a == of_a).all() and (new_b == of_b).all():
            break
        of_a, of_b = new_a, new_b
    top = left[a]
    return np.concatenate([top, right[b]]), np.concatenate([top[of_a], top[of_b]])
