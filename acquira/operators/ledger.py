"""Prices, budgets and what a purchase contained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import ranking
from acquira.functions.numbers import ratio
from acquira.sources.shared import written


#: Budgets whose walk is summed in one task.
FEW = 100_000


def spend(df: DataFrame, key: str, cost: DataFrame, *, budget: int, excluded: DataFrame | None = None) -> DataFrame:
    """image_id, anchor_pos, seq, cost, cum_cost of the images that a walk down ``key`` (ties by position) opens.

    An image is charged at its first row; the walk stops at the first that can't be paid. Costs are 1 at least, so a budget
    opens as many images as it has units at most, and the running cost within the budget is what the walk opens.
    """
    first = df.groupBy("image_id").agg(F.min(F.struct((-F.col(key)).alias("k"), F.col("pos").alias("pos"))).alias("a"))
    if excluded is not None:
        first = first.join(excluded.select("image_id"), "image_id", "left_anti")
    priced = first.join(cost, "image_id").select("image_id", F.col("a.k").alias("k"), F.col("a.pos").alias("anchor_pos"), "cost")
    if budget <= FEW:  # rows after the budget-th can't be paid, and so few are summed in one task
        in_order = Window.orderBy("k", "anchor_pos").rowsBetween(Window.unboundedPreceding, 0)
        walk = priced.orderBy("k", "anchor_pos").limit(max(budget, 0)).withColumns({"seq": F.count("*").over(in_order), "cum_cost": F.sum("cost").over(in_order)})
        return written(walk.where(F.col("cum_cost") <= budget).select("image_id", "anchor_pos", "seq", "cost", "cum_cost"))
    priced = written(priced)
    n = priced.count()
    if n > budget >= 1:  # rows after the budget-th can't be paid; ties of its key stay
        priced = priced.where(F.col("k") <= ranking.value_at(priced, "k", budget, size=n)[0])
    walk = ranking.running_sums(priced, {"seq": F.lit(1).cast("long"), "cum_cost": F.col("cost")}, ["k", "anchor_pos"])
    return walk.where(F.col("cum_cost") <= budget).select("image_id", "anchor_pos", "seq", "cost", "cum_cost")


def round_budgets(budget: int, rounds: int) -> list[int]:
    """An even split, the remainder first."""
    return [budget // rounds + (r < budget % rounds) for r in range(rounds)]


def spend_in_rounds(df: DataFrame, key: str, cost: DataFrame, *, budget: int, rounds: int) -> DataFrame:
    """spend, with the 1-based round whose allowance (unspent money is carried) pays for an image.

    After r rounds budget * r // rounds may be spent. A static order is resumed where it stopped, so an image belongs to the
    first round whose allowance holds its running cost.
    """
    opened = spend(df, key, cost, budget=budget)
    return opened.withColumn("round", F.ceil(F.col("cum_cost") * rounds / F.lit(float(budget))).cast("int"))


def discovery(picked: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: distinct objects and proposals, overall, unknown, and unknown by band; proposals for each object (NULL if none)."""
    real = F.col("object_id") >= 0
    unknown = F.col("kind") == "unknown"
    d = picked.join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")
    band = lambda g: F.count_distinct(F.when(unknown & (F.col("grp") == g), F.col("object_id"))).alias(f"{g}_objects")
    return d.agg(
        F.count("*").alias("proposals"), F.count_distinct(F.when(real, F.col("object_id"))).alias("objects"), F.count_distinct(F.when(unknown, F.col("object_id"))).alias("unknown_objects"),
        F.count(F.when(unknown, 1)).alias("unknown_proposals"), F.count_distinct(F.when(unknown, F.col("class_name"))).alias("unknown_classes"), band("head"), band("medium"), band("tail"),
        F.count(F.when(F.col("kind") == "background", 1)).alias("background"), F.count_distinct("image_id").alias("images"),
    ).withColumn("proposals_per_object", ratio(F.col("unknown_proposals"), F.col("unknown_objects")))


def supervision(counts: DataFrame, images: DataFrame, declared: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: boxes labelled, supervised (of declared classes), banked, by band, and images without any declared class."""
    d = images.select("image_id").distinct().join(counts, "image_id", "left").join(F.broadcast(declared.select("class_name", F.lit(True).alias("declared"))), "class_name", "left").join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    told = F.coalesce("declared", F.lit(False))
    per = d.groupBy("image_id").agg(F.max(told.cast("int")).alias("usable"), n(F.lit(True)).alias("labelled"), n(told).alias("supervised"), *[n(told & (F.col("grp") == g)).alias(g) for g in ("head", "medium", "tail")])
    s = per.agg(F.count("*").alias("images"), F.count(F.when(F.col("usable") == 0, 1)).alias("images_barren"), *[F.sum(c).alias(f"boxes_{c}") for c in ("labelled", "supervised", "head", "medium", "tail")])
    return s.withColumn("boxes_banked", F.col("boxes_labelled") - F.col("boxes_supervised")).withColumn("supervised_share", ratio(F.col("boxes_supervised"), F.col("boxes_labelled")))


def acquisition(counts: DataFrame, images: DataFrame, tasks: DataFrame, task: int) -> DataFrame:
    """A row for each fate of the bought boxes: known now, new with this task, known at a later task, never."""
    d = images.select("image_id").distinct().join(counts, "image_id").join(F.broadcast(tasks), "class_name", "left")
    fate = F.when(F.col("task") < task, "known").when(F.col("task") == task, "new").when(F.col("task") > task, "later").otherwise("never")
    return d.groupBy(fate.alias("fate")).agg(F.sum("n").alias("boxes"), F.countDistinct("class_name").alias("classes"))


def usable_images(counts: DataFrame, images: DataFrame, declared: DataFrame, *, barren: bool = False) -> DataFrame:
    """Images with a declared class, or (barren) without any."""
    has = counts.join(F.broadcast(declared), "class_name", "left_semi")
    return images.select("image_id").distinct().join(has, "image_id", "left_anti" if barren else "left_semi")


def cost_aware(df: DataFrame, value: str) -> DataFrame:
    """Adds rn: images by the sum of their values, then id; within an image by value."""
    w = Window.partitionBy("image_id")
    d = df.withColumn("_sum", F.round(F.sum(value).over(w), 9)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(value), "pos"))).withColumn("_size", F.count("*").over(w))
    images = d.where("_n = 1").select("image_id", "_sum", "_size")
    images = ranking.running_sum(images, F.col("_size"), ["_sum", "image_id"], "_upto", descending=True).select("image_id", (F.col("_upto") - F.col("_size")).alias("_before"))
    return d.join(images, "image_id").withColumn("rn", F.col("_before") + F.col("_n")).drop("_sum", "_n", "_size", "_before")


def price(policy: str, n: Column) -> Column:
    """An image costs its boxes, one at least; or one, if the policy pays for images."""
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(0))) if policy == "boxes" else F.lit(1)
