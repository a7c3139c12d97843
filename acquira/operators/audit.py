"""Report rows: what a task reached, what an arm bought, how classes were forgotten, what runs cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.operators import stats

GROUPS = ("head", "medium", "tail")


def looked_up(table: Column, *keys: str) -> Column:
    """The entry of nested maps; a key that is missing raises and names itself."""
    for k in keys:
        table = F.when(F.map_contains_key(table, k), F.element_at(table, F.lit(k))).otherwise(F.raise_error(F.lit(f"no entry {k}")))
    return table


def membership(classes: DataFrame) -> DataFrame:
    """grp, members: names of each group's classes in order, joined by semicolons; a group without any has an empty list."""
    have = classes.where(F.col("grp").isin(*GROUPS)).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("class_name")), ";").alias("members"))
    every = classes.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string")
    return every.join(have, "grp", "left").select("grp", F.coalesce("members", F.lit("")).alias("members"))


def forgetting(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, forgetting: before less after; NULL where either is missing."""
    d = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full")
    return d.select(key, (F.col("_b") - F.col("_a")).alias("forgetting"))


def task_rows(per_class: DataFrame, summary: DataFrame, groups: DataFrame, *, anchor: float | None = None) -> DataFrame:
    """A row a task: summary's columns, the new class's value, the drop of the previous classes since the task before and from the
    anchor, and means by group.

    per_class: task, class_name, ap; summary: task, new_class, known, previous, new, recall.
    """
    named = per_class.join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # one row a class
    means = named.groupBy("task").pivot("grp", list(GROUPS)).agg(F.avg("ap")).select("task", *[F.col(g).alias(f"map_{g}") for g in GROUPS])
    own = summary.join(per_class.select("task", F.col("class_name").alias("new_class"), F.col("ap").alias("new_ap")), ["task", "new_class"], "left")
    before = F.lag("known").over(Window.orderBy("task"))  # one row a task
    out = own.join(means, "task", "left").withColumn("forgetting", before - F.col("previous"))
    return out.withColumn("drop_from_anchor", F.lit(anchor) - F.col("known"))


def exchange(forgot: Column, new: Column, new_ap: Column) -> Column:
    """Points lost for each point gained; NULL without a gain."""
    return forgot / F.nullif(F.coalesce(F.nullif(new, F.lit(0.0)), new_ap), F.lit(0.0))


def purchase_row(opened: DataFrame, counts: DataFrame, groups: DataFrame, held: DataFrame, *, known: list[str], new: str, future: list[str]) -> DataFrame:
    """One row on what opened images hold: breadth, share of barren images, objects of the new class now and before, later ones, by group."""
    d = opened.select("image_id").distinct().join(counts, "image_id", "left").join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # one row a class
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    name, out = F.col("class_name"), ~F.col("class_name").isin(list(known))
    row = d.agg(
        F.countDistinct("image_id").alias("images_opened"), F.countDistinct(F.when(name.isNull(), F.col("image_id"))).alias("_barren"), F.countDistinct(F.when(out, name)).alias("class_breadth"),
        total(name.isNotNull()).alias("objects_total"), total(name == new).alias("new_objects"), total(name.isin(list(future))).alias("future_objects"),
        *[total(F.col("grp") == g).alias(f"{g}_objects") for g in GROUPS], total(out).alias("unknown_objects"),
    )
    before = held.where(F.col("class_name") == new).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("banked"))
    row = row.crossJoin(before).withColumn("held_at_declaration", F.col("new_objects") + F.col("banked"))  # one row each
    return row.withColumn("barren_share", F.round(F.col("_barren") / F.greatest("images_opened", F.lit(1)), 4)).drop("_barren")


def vulnerability(df: DataFrame) -> DataFrame:
    """statistic, value: whether forgetting goes with log frequency or with the anchor, from (class_name, pos, grp, frequency, anchor, final).

    Relative forgetting only where the anchor is 1 or more. Classes without both figures take no part; fits need five classes.
    """
    d = df.where("anchor IS NOT NULL AND final IS NOT NULL").withColumns({"_f": F.ln("frequency"), "_d": F.col("anchor") - F.col("final")})
    d = d.withColumn("_r", F.when(F.col("anchor") >= 1, F.col("_d") / F.col("anchor")))
    long = lambda x, name, c: x.select(F.lit(name).alias("statistic"), F.col(c).cast("double").alias("value"))
    parts = [long(d.agg(F.count("*").alias("n")), "classes", "n"), long(stats.spearman(d, "_f", "_d"), "rho_frequency", "rho"), long(stats.spearman(d, "anchor", "_d"), "rho_anchor", "rho"), long(stats.spearman(d.where("_r IS NOT NULL"), "_f", "_r"), "rho_relative", "rho")]
    if d.count() >= 5:
        parts += [long(stats.least_squares(d, "_d", "_f"), "r2_frequency", "r2"), long(stats.least_squares(d, "_d", "anchor"), "r2_anchor", "r2"), long(stats.least_squares(d, "_d", "_f", "anchor"), "r2_both", "r2")]
    parts.append(d.groupBy("grp").agg(F.avg("_d").alias("v")).select(F.concat(F.lit("mean_"), F.col("grp")).alias("statistic"), F.col("v").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def per_class(df: DataFrame, recall: DataFrame, baseline: str) -> DataFrame:
    """run, class_name, final, recall, forgetting, relative and gain over the baseline run, from (run, class_name, anchor, final).

    Relative forgetting only from an anchor of 1 on; recall (run, class_name, recall) is the independent check of the final value.
    """
    base = df.where(F.col("run") == baseline).select("class_name", F.col("final").alias("_b"))
    d = df.join(recall, ["run", "class_name"], "left").join(base, "class_name", "left")
    lost = F.col("anchor") - F.col("final")
    return d.select("run", "class_name", "final", "recall", lost.alias("forgetting"), F.when(F.col("anchor") >= 1, lost / F.col("anchor")).alias("relative"), F.when(F.col("run") != baseline, F.col("final") - F.col("_b")).alias("gain"))


def replay_composition(df: DataFrame, groups: DataFrame) -> DataFrame:
    """run, objects by group, least, median and greatest quota, the three most represented, from (run, class_name, quota)."""
    d = df.join(F.broadcast(groups.select("class_name", "grp")), "class_name", "left")  # one row a class
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("quota")).alias("k"), F.col("class_name").alias("c")))), 1, 3)
    part = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("quota"))), F.lit(0)).alias(f"{g}_objects")
    return d.groupBy("run").agg(
        *[part(g) for g in GROUPS], F.min("quota").alias("quota_min"), F.percentile("quota", 0.5).alias("quota_median"), F.max("quota").alias("quota_max"),
        F.array_join(F.transform(best, lambda s: F.concat(s["c"], F.lit(":"), (-s["k"]).cast("string"))), ", ").alias("most_represented"),
    )


def minutes(*, candidates: Column, train: Column, evaluated: Column, crops: Column, epochs: int, batch: int, basis: dict[str, float]) -> dict[str, Column]:
    """Minutes of prediction, training, evaluation (two passes) and embedding, and their sum, from measured rates."""
    steps = F.floor(train / max(batch, 1)) * epochs
    parts = {
        "predict": candidates / 1000 * basis["predict_per_1000"], "train": basis["train_fixed"] + steps * basis["train_seconds"] / 60,
        "evaluate": basis["evaluate_fixed"] + 2 * (evaluated / 1000 * basis["evaluate_per_1000"]), "embed": crops / basis["crops_per_minute"],
    }
    return parts | {"iterations": steps.cast("double"), "total": parts["predict"] + parts["train"] + parts["evaluate"] + parts["embed"]}


def prefix_overlap(df: DataFrame, a: str, b: str, marks: list[int]) -> DataFrame:
    """mark, both, jaccard, entering, leaving and the same of images, for the first rows by a and by b at each mark."""
    spark, out = df.sparkSession, None
    top = lambda c: df.orderBy(F.desc(c), "pos").limit(max(marks)).select("pos", "image_id", c)
    rank = lambda c, n: top(c).withColumn(n, F.row_number().over(Window.orderBy(F.desc(c), "pos"))).drop(c)  # noqa: E731  marks rows at most
    both = rank(a, "_a").join(rank(b, "_b"), ["pos", "image_id"], "full")
    m = spark.createDataFrame([(x,) for x in marks], "mark int")
    d = both.join(F.broadcast(m), (F.col("_a") <= F.col("mark")) | (F.col("_b") <= F.col("mark")))
    x, y = F.coalesce(F.col("_a") <= F.col("mark"), F.lit(False)), F.coalesce(F.col("_b") <= F.col("mark"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    rows = d.groupBy("mark").agg(n(x & y).alias("both"), n(y & ~x).alias("entering"), n(x & ~y).alias("leaving"), (n(x & y) / F.count("*")).alias("jaccard"))
    images = d.groupBy("mark", "image_id").agg(F.max(x).alias("x"), F.max(y).alias("y")).groupBy("mark").agg(n(F.col("x") & F.col("y")).alias("images_both"), (n(F.col("x") & F.col("y")) / F.count("*")).alias("images_jaccard"))
    out = rows.join(images, "mark")
    return out


def depth(df: DataFrame, arm: str, task: str, cost: str) -> DataFrame:
    """arm, tasks, cost at the last one, tasks that a comparison up to the shortest arm drops, last task."""
    d = df.groupBy(arm).agg(F.count("*").alias("tasks"), F.max_by(cost, task).alias("oracle_cost"), F.max(task).alias("last_task"))
    return d.withColumn("dropped", F.col("tasks") - F.min("tasks").over(Window.partitionBy()))  # one row an arm


def held_per_image(df: DataFrame, arm: str, held: str, images: str, tasks: list) -> DataFrame:
    """arm, tail_per_image over the named tasks and mean of held over all."""
    share = F.when(F.col("task").isin(tasks), F.col(held) / F.greatest(images, F.lit(1)))
    return df.groupBy(arm).agg(F.avg(share).alias("tail_per_image"), F.avg(held).alias("mean_held"))


def early_purchases(df: DataFrame) -> DataFrame:
    """seed, first_at_2, second_at_2, second_at_3, bought_early: what tasks 2 and 3 bought of the classes of tasks 3 and 4.

    df: arm, seed, task (2, 3, 4), banked, future. The figures have to agree with what task 2 reports, else it raises when read.
    """
    at = lambda c, k: F.max(F.when(F.col("task") == k, F.col(c)))
    d = df.groupBy("arm", "seed").agg(at("banked", 3).alias("first_at_2"), at("future", 3).alias("second_at_3"), at("banked", 4).alias("_b4"), at("future", 2).alias("_f2"))
    d = d.withColumn("second_at_2", F.col("_b4") - F.col("second_at_3"))
    fits = (F.abs(F.col("first_at_2") + F.col("second_at_2") - F.col("_f2")) <= 1e-6) & (F.col("second_at_2") >= 0)
    total = F.when(fits, F.col("first_at_2") + F.col("second_at_2") + F.col("second_at_3")).otherwise(F.raise_error(F.lit("banked and future objects don't agree")))
    return d.select("arm", "seed", "first_at_2", "second_at_2", "second_at_3", total.alias("bought_early"))


def introduced(values: DataFrame, previous: Column, current: Column, tolerance: float = 1e-3) -> DataFrame:
    """previous, current: how many first values average to the one target and how many after them to the other, each if it is unique.

    values: vector id, place (from 1), value; a short vector for each id. candidates of both are reported, joined by commas.
    """
    w = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = values.withColumns({"_sum": F.sum("value").over(w), "_n": F.count("*").over(Window.partitionBy("id"))})
    one = d.where((F.abs(F.col("_sum") / F.col("place") - previous) <= tolerance) & (F.col("place") < F.col("_n"))).groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("p"))
    k = F.when(F.size("p") == 1, F.col("p")[0])
    at = d.select("id", F.col("place").alias("k"), F.col("_sum").alias("s0"))
    only = one.withColumn("k", k).join(at, ["id", "k"], "left")
    after = d.join(only.select("id", "k", "s0"), "id").where((F.col("place") > F.col("k")) & (F.abs((F.col("_sum") - F.col("s0")) / (F.col("place") - F.col("k")) - current) <= tolerance))
    two = after.groupBy("id").agg(F.array_sort(F.collect_list(F.col("place") - F.col("k"))).alias("c"))
    names = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    out = values.select("id").distinct().join(only, "id", "left").join(two, "id", "left")
    return out.select("id", F.col("k").alias("previous"), F.when(F.size("c") == 1, F.col("c")[0]).alias("current"), names("p").alias("previous_candidates"), names("c").alias("current_candidates"))


def recall_check(ap: DataFrame, recall: DataFrame, *, apart: float = 50.0) -> DataFrame:
    """class_name, ap, recall, disagree: classes whose value and recall (in hundredths) lie further apart than stated."""
    d = ap.join(recall, "class_name", "full")
    return d.select("class_name", "ap", "recall", F.coalesce(F.abs(F.col("ap") - F.col("recall")) > apart, F.lit(True)).alias("disagree"))


def first_seen(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, of one key the row of the first part that has it (ties within a part: all columns in order)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c not in (key, "_part"))
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_part", *rest))).where("_rn = 1").drop("_rn", "_part")


