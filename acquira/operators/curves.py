"""Running costs and what a curve says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative_cost(df: DataFrame, arm: str, task: str, asked: str, name: str = "cost") -> DataFrame:
    return df.withColumn(name, F.sum(asked).over(Window.partitionBy(arm).orderBy(task).rowsBetween(Window.unboundedPreceding, 0)))


def cost_discrepancy(df: DataFrame, arm: str, recorded: str, real: str, tolerance: float = 1e-9) -> DataFrame:
    return df.where(F.abs(F.col(recorded) - F.col(real)) >= tolerance).withColumn("drift", F.col(recorded) - F.col(real))


def cost_to_reach(df: DataFrame, arm: str, cost: str, value: str, level: Column) -> DataFrame:
    """Cost at which each arm first has the level, between points by line; the first point's own cost; NULL if never."""
    w = Window.partitionBy(arm).orderBy(cost)
    d = df.where(F.col(value).isNotNull()).withColumns({"_c": F.lag(cost).over(w), "_v": F.lag(value).over(w), "_level": level})
    rise = F.col(value) - F.col("_v")
    at = F.when(F.col("_v").isNull() | (rise == 0), F.col(cost)).otherwise(F.col("_c") + (F.col(cost) - F.col("_c")) * (F.col("_level") - F.col("_v")) / F.nullif(rise, F.lit(0.0)))
    return d.groupBy(arm).agg(F.min_by(F.when(F.col(value) >= F.col("_level"), at), F.when(F.col(value) >= F.col("_level"), F.col(cost))).alias("cost_to_reach"))


def truncated(df: DataFrame, arm: str, task: str) -> DataFrame:
    """The first rows of each arm, as many as the shortest arm has."""
    depth = df.groupBy(arm).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_depth"))
    d = df.withColumn("_rn", F.row_number().over(Window.partitionBy(arm).orderBy(task)))
    return d.crossJoin(F.broadcast(depth)).where(F.col("_rn") <= F.col("_depth")).drop("_rn", "_depth")


def cumulative_discovery(picks: DataFrame, rounds: int) -> DataFrame:
    """Distinct objects up to each round (0-based): an object counts from its first round on."""
    first = picks.where("object_id >= 0").groupBy("object_id").agg(F.min("round").alias("round")).groupBy("round").agg(F.count("*").alias("new"))
    every = picks.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round"))
    d = every.join(F.broadcast(first), "round", "left")
    return d.select("round", F.coalesce(F.sum("new").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("objects"))


def efficiency(df: DataFrame, arm: str, cost: str, value: str, reference: str) -> DataFrame:
    """For each level of the reference's curve: every arm's cost to reach it and the saving against the reference."""
    levels = df.where((F.col(arm) == reference) & F.col(value).isNotNull()).select(F.col(value).alias("level"), F.col(cost).alias("reference_cost"))
    arms = df.select(arm, cost, value)
    pairs = arms.crossJoin(F.broadcast(levels)).withColumn("_key", F.concat_ws("|", F.col(arm), F.col("level").cast("string"), F.col("reference_cost").cast("string")))
    reach = cost_to_reach(pairs, "_key", cost, value, F.col("level"))
    keys = pairs.select("_key", arm, "level", "reference_cost").distinct()
    return keys.join(reach, "_key", "left").select(arm, "level", "reference_cost", "cost_to_reach", (1 - F.col("cost_to_reach") / F.nullif(F.col("reference_cost"), F.lit(0.0))).alias("saving"))
