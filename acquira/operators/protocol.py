"""Chains of tasks, epochs and splits: what is declared when, what is trained on next, what may be evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import ranking, text

COHERENCE = ("off", "binary", "density", "continuous")


def chain(classes: DataFrame, *, tasks: int, start: int) -> DataFrame:
    """task (from 1), new_class, previous, current, known (names in order, by semicolons): one new class a task after the first.

    classes: class_name, class_pos. More tasks than there are classes for raise.
    """
    spark = classes.sparkSession
    names = [r.class_name for r in classes.orderBy("class_pos").collect()]  # one row a class
    if tasks < 1 or len(names) < start + tasks - 1:
        raise ValueError(f"{len(names)} classes don't make {tasks} tasks from {start} on")
    rows = [(1, None, 0, start, ";".join(names[:start]))]
    rows += [(k + 2, names[start + k], start + k, start + k + 1, ";".join(names[:start + k + 1])) for k in range(tasks - 1)]
    return spark.createDataFrame(rows, "task int, new_class string, previous int, current int, known string")


def epoch_order(df: DataFrame, key: str, *, size: int, seed: object, epoch: int) -> DataFrame:
    """key, place (from 0): ``size`` rows of the table without repeats, in an order of their own for each epoch."""
    d = df.select(key, text.ordered_hash(seed, F.lit(epoch), F.col(key)).alias("_h"))
    n = d.count()
    if n < size:
        raise ValueError(f"{n} rows are fewer than an epoch's {size}")
    last = ranking.value_at(d.withColumn("_v", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")), "_v", size, size=n)[0]
    first = d.where(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long") <= last)  # no more than an epoch and its ties
    return ranking.row_numbers(first, ["_h", key], "_rn").where(F.col("_rn") <= size).select(key, (F.col("_rn") - 1).alias("place"))


def remaining_batches(order: DataFrame, key: str, *, batch: int, steps: int) -> DataFrame:
    """key, batch, slot of the batches of an epoch that are left after ``steps`` of them."""
    place = F.col("place")
    return order.select(key, F.floor(place / batch).alias("batch"), (place % batch).alias("slot")).where(F.col("batch") >= steps)


def evaluation_split(counts: DataFrame, *, scope: str, declared: list[str], trained: DataFrame | None = None) -> DataFrame:
    """image_id of the images to evaluate: all, or those that hold a declared class. Images that were trained on raise."""
    if scope not in ("full", "declared"):
        raise ValueError(f"unknown scope {scope!r}")
    d = (counts if scope == "full" else counts.where(F.col("class_name").isin(declared))).select("image_id").distinct()
    if trained is not None and (n := d.join(trained.select("image_id").distinct(), "image_id", "left_semi").count()):
        raise ValueError(f"{n} images were trained on")
    return d


def coherence(df: DataFrame, method: str, *, minimum: int = 5, eps: float = 0.25, share: float = 0.3, k: int = 5, key: str = "pos", score: str = "a") -> DataFrame:
    """key, g: whether a row has support around it.

    off: 1 for all; binary: in a cluster of the minimum size; density: in a DBSCAN cluster of the top share by ``score`` (rows outside
    it have 0); continuous: 1 / (1 + distance to the k-th neighbour over its median), 1 for all where there are k rows or fewer.
    """
    from acquira.operators import clusters, gates, terms
    from acquira.sources.shared import written

    if method == "off":
        return df.select(key, F.lit(1.0).alias("g"))
    if method == "binary":
        return gates.noise_gate(df, minimum=minimum).select(key, F.col("gate").cast("double").alias("g"))
    if method == "continuous":
        if df.count() <= k:
            return df.select(key, F.lit(1.0).alias("g"))
        d = written(terms.kth_distance(df, df, k=k, itself=True, key=key))
        return d.select(key, (1 / (1 + F.col("distance") / (ranking.quantile(d, "distance", 0.5) or 1.0))).alias("g"))
    if method == "density":
        d = written(ranking.top_share(df, score, key, share, "_in"))
        found = clusters.dbscan(d.where("_in"), eps=eps, minimum=minimum, key=key)
        return d.select(key).join(found, key, "left").select(key, F.when(F.coalesce("status", F.lit("noise")) == "noise", 0.0).otherwise(1.0).alias("g"))
    raise ValueError(f"{method!r} isn't one of {COHERENCE}")


def anchor_summary(per_class: DataFrame, groups: DataFrame, reported: float, tolerance: float = 1e-4) -> DataFrame:
    """grp, mean of the values by group and over all (grp "all"); a reported mean that differs from that of the classes raises when read."""
    d = per_class.join(F.broadcast(groups.select("class_name", "grp")), "class_name")  # one row a class
    out = d.groupingSets([["grp"], []], "grp").agg(F.avg("ap").alias("mean")).withColumn("grp", F.coalesce("grp", F.lit("all")))
    wrong = (F.col("grp") == "all") & (F.abs(F.col("mean") - reported) > tolerance)
    return out.withColumn("mean", F.when(wrong, F.raise_error(F.lit("the reported mean isn't that of the classes")).cast("double")).otherwise(F.col("mean")))


def condition_forgetting(anchor: DataFrame, final: DataFrame) -> DataFrame:
    """condition, class_name, absolute and relative loss of a class under one condition; a class that either lacks raises when read."""
    d = anchor.select("condition", "class_name", F.col("ap").alias("_a")).join(final.select("condition", "class_name", F.col("ap").alias("_f")), ["condition", "class_name"], "full")
    lost = F.when(F.col("_a").isNull() | F.col("_f").isNull(), F.raise_error(F.concat(F.lit("no value of "), "class_name")).cast("double")).otherwise(F.col("_a") - F.col("_f"))
    return d.select("condition", "class_name", lost.alias("absolute"), (lost / (F.col("_a") + 1e-12)).alias("relative"))


def trained_boxes(handed: DataFrame, counts: DataFrame, declared: DataFrame, groups: DataFrame) -> DataFrame:
    """task, images, trained, total, dropped and trained by group: boxes on the images handed to each task whose class it declares.

    handed: task, image_id; declared: task, class_name.
    """
    d = handed.distinct().join(counts, "image_id", "left").join(F.broadcast(declared.withColumn("_d", F.lit(True))), ["task", "class_name"], "left")
    d = d.join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # a row a class, and a row a task and class
    told = F.coalesce("_d", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = d.groupBy("task").agg(F.countDistinct("image_id").alias("images"), total(told).alias("trained"), total(F.lit(True)).alias("total"), *[total(told & (F.col("grp") == g)).alias(f"trained_{g}") for g in ("head", "medium", "tail")])
    return out.withColumn("dropped", F.col("total") - F.col("trained"))


def paired_identity(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, pairs, differing, largest: in how many pairs of rows two runs differ in each figure, and by how much at most."""
    d = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields]), key)
    gap = lambda f: F.abs(F.col(f"_a_{f}") - F.col(f"_b_{f}")).cast("double")
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), gap(f).alias("gap")) for f in fields])).alias("r")).select("r.*")
    return rows.groupBy("field").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("gap") > 0, 1)).alias("differing"), F.max("gap").alias("largest"))


def rarity(size: Column, total: Column, method: str = "log_inverse") -> Column:
    """How rare a cluster's class is taken to be: log of the table over the cluster, or one over the cluster."""
    n = F.greatest(size.cast("double"), F.lit(1.0))
    if method == "log_inverse":
        return -F.ln(n / F.greatest(total.cast("double"), F.lit(1.0)))
    if method == "inverse":
        return 1.0 / n
    raise ValueError(f"unknown rarity {method!r}")


def band_ledger(counts: DataFrame, images: DataFrame, groups: DataFrame, *, known: list[str]) -> DataFrame:
    """grp, boxes, classes, images of what opened images hold of classes that aren't known; classes without a group are "none"."""
    d = counts.join(images.select("image_id").distinct(), "image_id", "left_semi").where(~F.col("class_name").isin(list(known)))
    d = d.join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # one row a class
    return d.groupBy(F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.sum("n").alias("boxes"), F.countDistinct("class_name").alias("classes"), F.countDistinct("image_id").alias("images"))


def ranked_product(df: DataFrame, consistency: str, limit: int) -> DataFrame:
    """pos, score, rn: the first ``limit`` rows by admissibility times consistency."""
    d = df.withColumn("score", F.round(F.col("a") * F.col(consistency), 9)).orderBy(F.desc("score"), "pos").limit(limit)
    return d.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "pos"))).select("pos", "score", "rn")
