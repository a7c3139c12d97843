"""Greedy one-to-one matching of detections with truths, and recall by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acquira.functions import boxes
from acquira.functions.numbers import ratio


def greedy(detections: DataFrame, truths: DataFrame, keys: list[str], *, overlap: float = 0.5, least_score: float | None = None) -> DataFrame:
    """Truths with recalled: each detection, by score descending (ties by position), takes the free truth that it overlaps most, if enough.

    detections: keys, pos, score, box (those under ``least_score`` take no part); truths: keys, pos, box. Groups are folded in the JVM; ties of overlap go to the smaller position.
    """
    if least_score is not None:
        detections = detections.where(F.col("score") >= least_score)
    d = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "pos", "box"))).alias("_d"))
    t = truths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "box"))).alias("_t"))
    both = t.join(d, keys, "left")
    free = lambda claimed: F.filter("_t", lambda x: ~F.array_contains(claimed, x["pos"]))
    score = lambda x, det: F.struct(boxes.iou(boxes.struct_corners(x["box"]), boxes.struct_corners(det["box"])).alias("v"), (-x["pos"]).alias("p"))

    def step(claimed, det):
        best = F.array_max(F.transform(free(claimed), lambda x: score(x, det)))
        return F.when(best["v"] >= overlap, F.array_append(claimed, -best["p"])).otherwise(claimed)

    claimed = F.aggregate(F.coalesce("_d", F.array().cast(both.schema["_d"].dataType)), F.array().cast("array<bigint>"), step)
    won = both.select(F.explode(claimed).alias("pos"), F.lit(True).alias("recalled"))
    return truths.join(won, "pos", "left").withColumn("recalled", F.coalesce("recalled", F.lit(False)))


def recall(matched: DataFrame, group: str) -> DataFrame:
    """Truths, recalled and recall of each group and of all."""
    out = matched.groupingSets([[group], []], group).agg(F.count("*").alias("truths"), F.count(F.when(F.col("recalled"), 1)).alias("recalled"))
    return out.select(F.coalesce(group, F.lit("all")).alias(group), "truths", "recalled", F.round(ratio(F.col("recalled"), F.col("truths")), 6).alias("recall"))
