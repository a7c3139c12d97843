"""Labelling policies: what a purchase teaches as object, background or nothing, and the role of every object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acquira.functions import boxes

REGION_POLICIES = ("box_only", "full_image", "known_plus_selected")
OBJECT_POLICIES = ("selected_box_only", "full_image", "known_plus_selected_ignore_rest")


def annotate(oracle: DataFrame, picks: DataFrame, *, policy: str, known: DataFrame) -> DataFrame:
    """pos, object_id, kind, chosen, role (labelled, background, ignored) of every row on an opened image."""
    if policy not in REGION_POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    marked = oracle.join(picks.select("pos", F.lit(True).alias("chosen")), "pos", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    on = marked.join(marked.where("chosen").select("image_id").distinct(), "image_id", "left_semi")
    on = on.join(F.broadcast(known.select("class_name", F.lit(True).alias("is_known"))), "class_name", "left")
    thing, chosen = F.col("kind") != "background", F.col("chosen")
    labelled = {"box_only": chosen & thing, "full_image": thing, "known_plus_selected": thing & (F.coalesce("is_known", F.lit(False)) | chosen)}[policy]
    rest = F.lit("background") if policy == "box_only" else F.when(thing, "ignored").otherwise("background")
    return on.select("pos", "image_id", "object_id", "kind", "chosen", F.when(labelled, "labelled").otherwise(rest).alias("role"))


def annotation_cost(annotated: DataFrame, policy: str) -> DataFrame:
    """One row: cost, rows of each role, and the share of taught background that is an object (0 without background)."""
    chosen = F.count(F.when(F.col("chosen"), 1))
    if policy == "full_image":
        cost = F.count_distinct(F.when(F.col("object_id") >= 0, F.col("object_id"))) + F.count(F.when(F.col("chosen") & (F.col("kind") == "background"), 1))
    else:
        cost = chosen
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    wrong = F.count(F.when((F.col("role") == "background") & (F.col("kind") != "background"), 1))
    return annotated.agg(cost.alias("cost"), n("labelled").alias("labelled"), n("background").alias("background"), n("ignored").alias("ignored"), F.coalesce(wrong / F.nullif(n("background"), F.lit(0)), F.lit(0.0)).alias("half_labelled"))


def matched(objects: DataFrame, selected: DataFrame, *, overlap: float = 0.5) -> DataFrame:
    """Adds matched: whether a selected box of the same image overlaps the object's by as much. Both have box (corners)."""
    s = selected.groupBy("image_id").agg(F.collect_list("box").alias("_bought"))
    hit = F.exists("_bought", lambda b: boxes.iou(boxes.struct_corners(F.col("box")), boxes.struct_corners(b)) >= overlap)
    return objects.join(s, "image_id", "left").withColumn("matched", F.coalesce(hit, F.lit(False))).drop("_bought")


def roles(objects: DataFrame, *, policy: str, known: Column, declared: Column) -> DataFrame:
    """Adds role (supervised, banked, ignored) and free to matched objects, by policy."""
    m, d, k = F.col("matched"), declared, known
    if policy == "selected_box_only":
        role, free = F.when(m & d, "supervised").when(m, "banked").otherwise("ignored"), ~m
    elif policy == "full_image":
        role, free = F.when(d, "supervised").otherwise("banked"), ~m
    elif policy == "known_plus_selected_ignore_rest":
        role, free = F.when(k | (m & d), "supervised").when(m, "banked").otherwise("ignored"), k | ~m
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return objects.withColumn("role", role).withColumn("free", free)


def training_target(objects: DataFrame, *, marker: str, position: Column, previous: int, current: int) -> DataFrame:
    """Adds target: the class that a split of this name trains on, "unknown" (test only), or NULL if the object is dropped."""
    known = position < previous + current
    if "train" in marker:
        target = F.when(known & (position >= previous), F.col("class_name"))
    elif "test" in marker:
        target = F.when(known, F.col("class_name")).otherwise("unknown")
    elif "ft" in marker:
        target = F.when(known, F.col("class_name"))
    else:
        raise ValueError(f"no branch for split {marker!r}")
    return objects.withColumn("target", target)


def false_background(objects: DataFrame, positives: DataFrame, suppressed: DataFrame | None = None, *, overlap: float = 0.5) -> DataFrame:
    """Objects that neither a positive nor a suppressed region overlaps: real, but taught as background."""
    out = matched(objects, positives, overlap=overlap).where("NOT matched").drop("matched")
    return out if suppressed is None else matched(out, suppressed, overlap=overlap).where("NOT matched").drop("matched")
