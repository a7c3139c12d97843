"""Quotas and samples by hash order: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import text
from acquira.functions.numbers import schedule_weight


def objects(counts: DataFrame) -> DataFrame:
    """image_id, class_name, ordinal: every object that the counts hold."""
    return counts.where("n > 0").select("image_id", "class_name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal"))


def exact_quota(pool: DataFrame, demand: DataFrame, *, seed: object, held: DataFrame | None = None) -> DataFrame:
    """For each class as many objects as demanded: those held first, the others by a seeded hash. demand: class_name, quota.

    A class that the pool can't supply raises.
    """
    if missing := shortfall(pool, demand).collect():  # one row a class
        raise ValueError(f"objects are missing: {dict(map(tuple, missing))}")
    keys = ["image_id", "class_name", "ordinal"]
    d = pool if held is None else pool.join(held.select(*keys, F.lit(True).alias("held")), keys, "left")
    first = F.lit(0) if held is None else F.when(F.coalesce("held", F.lit(False)), 0).otherwise(1)
    order = Window.partitionBy("class_name").orderBy(first, text.ordered_hash(seed, F.col("class_name"), F.col("image_id"), F.col("ordinal")), *keys)
    d = d.join(F.broadcast(demand), "class_name").withColumn("rn", F.row_number().over(order))  # one row a class
    return d.where(F.col("rn") <= F.col("quota")).select(*keys, "rn")


def shortfall(pool: DataFrame, demand: DataFrame) -> DataFrame:
    """Classes that the pool can't supply, with what is missing."""
    have = pool.groupBy("class_name").agg(F.count("*").alias("have"))
    return demand.join(have, "class_name", "left").withColumn("missing", F.col("quota") - F.coalesce("have", F.lit(0))).where("missing > 0").select("class_name", "missing")


def evaluation_subset(counts: DataFrame, *, cap: int, remainder: float, seed: object) -> DataFrame:
    """Images for evaluation: up to cap of each class by hash, and ``remainder`` times as many of the others by hash."""
    order = Window.partitionBy("class_name").orderBy(text.ordered_hash(seed, F.col("class_name"), F.col("image_id")), "image_id")
    required = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).select("image_id").distinct()
    n = required.count()
    others = counts.select("image_id").distinct().join(required, "image_id", "left_anti").orderBy(text.ordered_hash(seed, F.col("image_id")), "image_id").limit(int(n * remainder))
    return required.withColumn("required", F.lit(True)).unionByName(others.withColumn("required", F.lit(False)))


def cluster_cap(df: DataFrame, cluster: str, key: str, *, cap: int, limit: int) -> DataFrame:
    """The greatest by key, no more than cap of a cluster."""
    order = Window.partitionBy(cluster).orderBy(F.desc(key), "pos")
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).orderBy(F.desc(key), "pos").limit(limit).drop("rn")


def cluster_rounds(df: DataFrame, cluster: str, key: str, *, limit: int) -> DataFrame:
    """The best of every cluster, then the second of every cluster, and so on."""
    order = Window.partitionBy(cluster).orderBy(F.desc(key), "pos")
    return df.withColumn("rn", F.row_number().over(order)).orderBy("rn", cluster).limit(limit)


def largest_remainder(weights: DataFrame, total: Column, *, weight: str = "weight", order: str = "rank") -> DataFrame:
    """Adds share: whole parts of the total by weight, the rest to the largest fractions (ties by order). One row a class."""
    every = Window.partitionBy()
    d = weights.withColumn("_raw", F.col(weight) / F.sum(weight).over(every) * total).withColumn("_floor", F.floor("_raw"))
    d = d.withColumn("_left", total - F.sum("_floor").over(every)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), order)))
    return d.withColumn("share", (F.col("_floor") + F.when(F.col("_rn") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_raw", "_floor", "_left", "_rn")


def long_tail_targets(groups: DataFrame, ratio: float) -> DataFrame:
    """class_name, n, rank, weight, feasible: the greatest total that the schedule allows, and its target for each class."""
    w = Window.orderBy(F.desc("n"), "class_name")
    every = Window.partitionBy()
    d = groups.withColumn("rank", F.row_number().over(w) - 1).withColumn("weight", schedule_weight(F.col("rank").cast("double"), F.count("*").over(every), ratio))
    d = d.withColumn("feasible", F.floor(F.min(F.col("n") / F.col("weight")).over(every) * F.sum("weight").over(every)))
    return largest_remainder(d, F.col("feasible")).withColumnRenamed("share", "target")


def quotas(sizes: DataFrame, *, budget: float) -> DataFrame:
    """cluster, candidates, references -> rarity and quota: log of the smoothed ratio, positive parts sharing the budget."""
    r = F.ln((1 + F.col("candidates")) / (1 + F.col("references")))
    d = sizes.withColumn("rarity", r).withColumn("_up", F.greatest(r, F.lit(0.0)))
    return d.withColumn("quota", F.lit(float(budget)) * F.col("_up") / F.nullif(F.sum("_up").over(Window.partitionBy()), F.lit(0.0))).drop("_up")


def balanced(pool: DataFrame, *, cap: int, seed: object) -> DataFrame:
    """Up to ``cap`` objects of each class in the order of a seeded hash, with balanced: whether the class had so many.

    A smaller cap takes the first of the same order.
    """
    if cap < 1:
        raise ValueError("a class gives one object at least")
    keys = ["image_id", "class_name", "ordinal"]
    have = pool.groupBy("class_name").agg((F.count("*") >= cap).alias("balanced"))
    order = Window.partitionBy("class_name").orderBy(text.ordered_hash(seed, F.col("class_name"), F.col("image_id"), F.col("ordinal")), *keys)
    d = pool.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    return d.join(F.broadcast(have), "class_name").select(*keys, "rn", "balanced")  # one row a class


def matched_total(groups: DataFrame, ratios: list[float]) -> DataFrame:
    """rho, feasible, matched: the greatest total for each severity without an object twice, and the least of these."""
    w = Window.orderBy(F.desc("n"), "class_name")
    d = groups.withColumn("rank", F.row_number().over(w) - 1).withColumn("c", F.count("*").over(Window.partitionBy()))  # one row a class
    d = d.withColumn("rho", F.explode(F.array(*map(F.lit, ratios)))).withColumn("w", F.pow(F.col("rho"), -F.col("rank").cast("double") / (F.col("c") - 1)))
    f = d.groupBy("rho").agg(F.floor(F.min(F.col("n") / F.col("w")) * F.sum("w")).alias("feasible"))
    return f.withColumn("matched", F.min("feasible").over(Window.partitionBy()))


def achieved_ratio(targets: DataFrame, value: str = "target") -> DataFrame:
    """rho: greatest over least target; a class without any raises when it is read."""
    low = F.min(value)
    return targets.agg(F.when(low > 0, F.max(value) / low).otherwise(F.raise_error(F.lit("every class needs an object")).cast("double")).alias("rho"))


def class_states(classes: DataFrame, groups: DataFrame, *, known: int, declared: int) -> DataFrame:
    """class_name, state (known, declared, unknown) by place in the order of classes, tail_band: unknown and in the tail."""
    p = F.col("class_pos")
    state = F.when(p < known, "known").when(p < known + declared, "declared").otherwise("unknown")
    d = classes.select("class_name", state.alias("state")).join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # one row a class
    return d.select("class_name", "state", F.coalesce((F.col("state") == "unknown") & (F.col("grp") == "tail"), F.lit(False)).alias("tail_band"))
