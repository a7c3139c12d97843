"""Suppression, gates and populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import boxes, ranking
from acquira.sources.shared import written


def _folded(df: DataFrame, key: Column, threshold: float, *more: str) -> DataFrame:
    """image_id, kept: for each image its survivors (pos, and ``more`` of their columns), folded in the JVM after one shuffle by image."""
    x1, y1, x2, y2 = boxes.corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    item = F.struct((-key).alias("k"), F.col("pos").alias("pos"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), *more)
    arrays = df.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = arrays.schema["items"].dataType.simpleString()
    hit = lambda kept, b: F.exists(kept, lambda k: boxes.overlap_above(boxes.struct_corners(k), boxes.struct_corners(b), threshold))
    return arrays.select("image_id", F.aggregate("items", F.array().cast(kind), lambda kept, b: F.when(hit(kept, b), kept).otherwise(F.array_append(kept, b))).alias("kept"))


def suppress(df: DataFrame, key: Column, *, threshold: float = 0.6, candidate: Column | None = None) -> DataFrame:
    """Adds kept: greedy suppression within each image, by key descending, ties to the smaller position; overlap above goes.

    One shuffle by image; an image's boxes are folded in the JVM. Rows that aren't candidates are neither kept nor suppress.
    """
    folded = _folded(df if candidate is None else df.where(candidate), key, threshold)
    winners = folded.select(F.explode(F.transform("kept", lambda b: b["pos"])).alias("pos"), F.lit(True).alias("kept"))
    return df.join(winners, "pos", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def survivors(df: DataFrame, key: Column, columns: list[str], *, threshold: float = 0.6) -> DataFrame:
    """pos, image_id and ``columns`` of the rows that ``suppress`` keeps; these columns go through the fold, so no row is joined."""
    folded = _folded(df, key, threshold, *columns).select("image_id", F.explode("kept").alias("r"))
    return folded.select("r.pos", "image_id", *[f"r.{c}" for c in columns])


def admissible(df: DataFrame, key: str, share: float, name: str = "in_gate") -> DataFrame:
    """Adds whether a row is in the top share by key."""
    return ranking.top_share(df, key, "pos", share, name)


def gate_then_suppress(df: DataFrame, key: str, *, share: float, threshold: float = 0.6) -> DataFrame:
    """The gate, then suppression among the gated."""
    return suppress(admissible(df, key, share), F.col(key), threshold=threshold, candidate=F.col("in_gate"))


def suppress_then_gate(df: DataFrame, key: str, *, share: float, threshold: float = 0.6, suppress_key: str | None = None) -> DataFrame:
    """Survivors of suppression (by its own key, if it has one) with the gate by ``key`` among them."""
    return admissible(written(suppress(df, F.col(suppress_key or key), threshold=threshold).where("kept")), key, share)


def above_median(df: DataFrame, gate: Column, value: str) -> DataFrame:
    """Rows in the gate whose value is its median at least; none where the gate is empty."""
    inside = df.where(gate)
    return inside.where(F.col(value) >= F.lit(ranking.quantile(inside, value, 0.5)))


def below_quantile(df: DataFrame, value: Column, quantile: float, *, candidate: Column | None = None) -> DataFrame:
    """Candidates whose value is under the quantile of all candidates (without ``candidate``, of all rows)."""
    inside = (df if candidate is None else df.where(candidate)).withColumn("_v", value)
    return inside.where(F.col("_v") < F.lit(ranking.quantile(inside, "_v", quantile))).drop("_v")


def one_per_object(df: DataFrame, order: str) -> DataFrame:
    """The first row of each object by ``order`` and position; background rows (object -1) all stay."""
    real = df.where("object_id >= 0").withColumn("_rn", F.row_number().over(Window.partitionBy("object_id").orderBy(order, "pos"))).where("_rn = 1").drop("_rn")
    return real.unionByName(df.where("object_id < 0"))


def noise_gate(assign: DataFrame, *, minimum: int) -> DataFrame:
    """Adds gate: 0 for noise (-1) and members of clusters under the minimum size."""
    sizes = assign.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("_size"))
    return assign.join(sizes, "cluster", "left").withColumn("gate", F.when(F.coalesce("_size", F.lit(0)) >= minimum, 1).otherwise(0)).drop("_size")
