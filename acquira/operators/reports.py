"""Comparisons of runs: tables, differences, agreement and mechanical verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acquira.functions import ranking
from acquira.sources.shared import written


def task_comparison(df: DataFrame, run: str, task: str, value: str, runs: list[str]) -> DataFrame:
    """A row a task, a column a run; missing is NULL."""
    return df.groupBy(task).pivot(run, runs).agg(F.first(value))


def delta(df: DataFrame, run: str, task: str, values: list[str], baseline: str) -> DataFrame:
    """Each run less the baseline on the tasks that either has."""
    base = df.where(F.col(run) == baseline).select(task, *[F.col(v).alias(f"_{v}") for v in values])
    names = df.where(F.col(run) != baseline).select(run).distinct()
    every = names.crossJoin(F.broadcast(df.select(task).distinct()))
    d = every.join(df.select(run, task, *values), [run, task], "left").join(base, task, "left")
    return d.select(run, task, *[(F.col(v) - F.col(f"_{v}")).alias(f"delta_{v}") for v in values])


def compatibility(df: DataFrame, run: str, fields: list[str], reference: str) -> DataFrame:
    """The fields in which each run differs from the reference; a field that only one has differs."""
    base = df.where(F.col(run) == reference).select(*[F.col(f).alias(f"_{f}") for f in fields])
    differs = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return df.where(F.col(run) != reference).crossJoin(F.broadcast(base)).select(run, F.array_join(differs, ";").alias("differs"), (F.size(differs) == 0).alias("compatible"))


def protocol_agreement(declared: DataFrame, frozen: DataFrame) -> DataFrame:
    """name, state (missing, extra, differing) of (name, value) pairs that don't agree."""
    d = declared.select("name", F.col("value").alias("a"), F.lit(1).alias("ina")).join(frozen.select("name", F.col("value").alias("b"), F.lit(1).alias("inb")), "name", "full")
    state = F.when(F.col("ina").isNull(), "missing").when(F.col("inb").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "differing")
    return d.select("name", state.alias("state")).where("state IS NOT NULL")


def prefix_counts(values: DataFrame, target: Column, tolerance: float = 1e-3) -> DataFrame:
    """The k for which the mean of the first k values (by place) is the target, and whether it is the only one."""
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = values.withColumns({"mean": F.avg("value").over(w), "k": F.count("*").over(w)}).where(F.abs(F.col("mean") - target) <= tolerance)
    return d.agg(F.when(F.count("*") == 1, F.min("k")).alias("k"), F.count("*").alias("solutions"))


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """jaccard, both, added, dropped of two id sets."""
    d = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return d.agg(n(x & y).alias("both"), n(y & ~x).alias("added"), n(x & ~y).alias("dropped"), (n(x & y) / F.nullif(F.count("*"), F.lit(0))).alias("jaccard"))


def gaps(df: DataFrame, value: str) -> DataFrame:
    """Differences between consecutive distinct values: how many, least, median, greatest."""
    d = written(ranking.row_numbers(df.where(F.col(value).isNotNull()).select(value).distinct(), [value], "_rn"))
    after = d.select((F.col("_rn") - 1).alias("_rn"), F.col(value).alias("_next"))
    d = written(d.join(after, "_rn").select((F.col("_next") - F.col(value)).alias("_gap")))
    median = ranking.quantile(d, "_gap", 0.5)
    return d.agg(F.count("*").alias("gaps"), F.min("_gap").alias("least"), F.lit(median).cast("double").alias("median"), F.max("_gap").alias("greatest"))


def discordant_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of groups' values that a and b order differently. For short tables: pairs grow with the square of the rows."""
    d = df.select("pos", a, b)
    o = d.select(F.col("pos").alias("p2"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    sign = lambda x, y: F.signum(x.cast("double") - y.cast("double"))
    return d.join(o, F.col("pos") < F.col("p2")).agg(F.count("*").alias("pairs"), F.count(F.when(sign(F.col(a), F.col("a2")) * sign(F.col(b), F.col("b2")) < 0, 1)).alias("discordant"))


def verdicts(df: DataFrame, arm: str, clauses: dict[str, tuple[str, str, float]]) -> DataFrame:
    """For each arm, whether each clause (statistic, column, threshold) holds over its seeds, and GO if all do; no figure fails."""
    stat = {"min": F.min, "max": F.max, "mean": F.avg}
    hold = {n: F.coalesce((stat[s](c) if s != "max" else stat[s](c)) >= t if s != "max" else stat[s](c) <= t, F.lit(False)).alias(n) for n, (s, c, t) in clauses.items()}
    d = df.groupBy(arm).agg(*hold.values())
    every = F.lit(True)
    for n in clauses:
        every = every & F.col(n)
    return d.withColumn("verdict", F.when(every, "GO").otherwise("NO-GO"))


def knn_agreement(pairs: DataFrame, *, k: int) -> DataFrame:
    """Mean share of each row's k nearest with its class; pairs (a, b, similarity, same_class) leave out pairs of one object."""
    near = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("rn") <= k)
    return near.groupBy("a").agg(F.avg(F.col("same_class").cast("double")).alias("share")).agg(F.count("*").alias("rows"), F.avg("share").alias("agreement"))
